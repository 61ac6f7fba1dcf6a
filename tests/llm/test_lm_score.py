import math
import re
import zlib
from collections import Counter

import numpy as np

from pathweave.llm import lm_score
from pathweave.llm.lm_score import Network, op4_lm_scoring, score_documents, score_likelihood
from tests.llm.conftest import as_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def check_base(texts, got):
    count = Counter(w for i, t in enumerate(texts) if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for r in got:
        ws = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(ws), n)
        assert r.n_known == sum(count[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_base_matches_brute_force(spark, docs, texts, tmp_path):
    check_base(texts, op4_lm_scoring(spark, as_dir(docs, tmp_path)).collect())


def test_counts_that_are_joined(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 200)
    monkeypatch.setattr(lm_score, "VOCABULARY", 50)
    check_base(texts, score_likelihood(docs.select("doc_id", "text")).collect())


def test_gradients():
    rng = np.random.RandomState(0)
    net = Network(np.array([5.0] * 70), 3.0, units=4)
    net.p = {k: v.astype(np.float64) + 0.2 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    net.p["b"].reshape(-1)[70:] = -30
    ids, target = rng.randint(0, 71, (5, 3)), rng.randint(0, 71, (5, 3))
    reset = rng.rand(5, 3) < 0.3
    h = rng.standard_normal((3, 4))
    _, g, _ = net.gradients(ids, target, reset, h)
    rows = np.zeros_like(net.p["e"])
    rows[g.pop("rows")] = g["e"]
    g["e"] = rows
    for name in net.p:
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in rng.randint(0, len(flat), 6):
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = net.gradients(ids, target, reset, h)[0]
            flat[i] = old - eps
            down = net.gradients(ids, target, reset, h)[0]
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grad[i]) < 1e-6, name


def test_scores_match_one_by_one(monkeypatch):
    """Streams, windows and classes against a plain pass over each document."""
    rng = np.random.RandomState(1)
    monkeypatch.setattr(lm_score, "STREAMS", 4)
    monkeypatch.setattr(lm_score, "WINDOW", 7)
    net = Network(rng.randint(1, 50, 100).astype(float), 9.0, units=8)
    documents = [np.append(rng.randint(0, 101, rng.randint(0, 60)), 17) for _ in range(23)]
    got = score_documents(net, documents, 17)
    for doc, value in zip(documents, got, strict=True):
        h, last, want = np.zeros((1, 8), np.float32), 17, 0.0
        for t in doc:
            h = net.step(net.p["e"][[last]], h)[0]
            logits = (h @ net.p["c"] + net.p["d"])[0].astype(float)
            group = net.classes if t == 100 else t // 64
            want += logits[group] - np.log(np.exp(logits).sum())
            if t < 100:
                z = (h @ net.p["w"][group] + net.p["b"][group] + net.void[group])[0].astype(float)
                want += z[t % 64] - np.log(np.exp(z).sum())
            last = t
        assert abs(value - want) < 1e-3 * max(1, abs(want))


def test_better_than_base_on_held_out(spark, monkeypatch):
    got = [r for r in op4_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_query_score_matches_a_plain_pass(spark, docs, texts, monkeypatch):
    """Every score again from the trained weights and the corpus's counts; every training token taught."""
    seen = {}

    def train(encoded, net, end, real=lm_score.train):
        seen.update(net=net, end=end, tokens=real(encoded, net, end))
        return seen["tokens"]

    monkeypatch.setattr(lm_score, "train", train)
    monkeypatch.setattr(lm_score, "VOCABULARY", 60)
    got = score_likelihood(docs.select("doc_id", "text")).collect()
    count = Counter(w for i, t in enumerate(texts) if not held(i) for w in tokens(t))
    net, end = seen["net"], seen["end"]
    assert seen["tokens"] == sum(count.values()) == got[0].train_tokens
    assert net.size == 60
    inside = sum(sorted(count.values(), reverse=True)[:60])
    other_n, other_v = sum(count.values()) - inside, len(count) - 60
    short = [r for r in got if r.n_tokens <= 2 and texts[r.doc_id] in (None, "", " \n\t ")]
    for r in short:
        want = score_documents(net, [np.array([end])], end)[0] / math.log(10)
        assert math.isclose(r.score, want, rel_tol=1e-5)
    odd = next(r for r in got if texts[r.doc_id] == "k" * 5000)
    want = score_documents(net, [np.array([60, end])], end)[0] / math.log(10) + math.log10((count["k" * 5000] + 1) / (other_n + other_v + 1))
    assert math.isclose(odd.score, want, rel_tol=1e-4)


def test_every_token_teaches():
    rng = np.random.RandomState(3)
    documents = [np.append(rng.randint(0, 20, n), 5) for n in [3000, 1, 700, *rng.randint(0, 90, 400)]]
    net = Network(np.ones(20), 1.0, units=4)
    n, losses = net.fit(documents, 5)
    assert n == sum(map(len, documents)) and all(np.isfinite(losses))
    flow = lm_score.Streams(documents, 5, 16)
    places = np.concatenate([p[live] for p, live in flow.windows(7, 50)])
    assert sorted(places) == list(range(n))
    for i, d in enumerate(documents):
        assert flow.target[flow.document == i].tolist() == d.tolist()


def test_a_very_long_text_beside_short_ones():
    """Two million tokens take memory in proportion, not a matrix of streams."""
    rng = np.random.RandomState(3)
    net = Network(np.ones(64), 1.0, units=4)
    flow = lm_score.Streams([rng.randint(0, 60, 2_000_000), *[np.array([1, 2])] * 255], 5, 256)
    assert sum(x.nbytes for x in (flow.ids, flow.target, flow.reset, flow.document)) < 60e6
    assert max(p.size for p, _ in flow.windows(48, 3000)) <= 256 * 48
    long = rng.randint(0, 60, 100_000)
    assert math.isclose(score_documents(net, [long, np.array([5])], 5)[0], score_documents(net, [long], 5)[0], rel_tol=1e-6)


def test_many_null_ids(spark):
    rows = spark.createDataFrame([(None, f"a b w{i % 7}") for i in range(10_000)], "doc_id long, text string")
    got = score_likelihood(rows)
    assert got.count() == 10_000 and got.first().train_tokens == 40_000


def test_equal_scores_on_two_runs(spark, docs):
    one, two = ({r.doc_id: r.score for r in score_likelihood(docs).collect()} for _ in range(2))
    assert all(math.isclose(one[i], two[i], rel_tol=1e-6) for i in one)


def test_edge_cases(spark, empty, nulls):
    assert score_likelihood(empty).count() == 0
    rows = score_likelihood(nulls).collect()
    assert len(rows) == 5 and sorted(r.n_tokens for r in rows) == [1, 1, 1, 3, 3]
    only = spark.createDataFrame([(i, "a b") for i in range(60) if held(i)], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in score_likelihood(only).collect())
