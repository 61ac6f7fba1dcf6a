import random
import zlib

from pathweave.llm import toxicity
from pathweave.llm.toxicity import DECAY, REACH, _padded, disguises, features, op3_toxicity, score_toxicity, train, train_on

import numpy as np


def brute_features(span):
    s, out = span.decode(), {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                if k - i <= REACH and all(c.isalnum() for c in (s[i], s[j], s[k])):
                    u = s[i] + s[j] + s[k]
                    out[u] = out.get(u, 0) + DECAY ** (k - i + 1)
    return out


def test_features_match_brute_force():
    classes = lambda u: [int(x) for x in _padded([u.encode()])[0][:3]]
    for span in (b"stupid", b"s.t-upid", b"abcabcabc"):
        want = brute_features(span)
        ids = {u: (classes(u)[0] << 12) | (classes(u)[1] << 6) | classes(u)[2] for u in want}
        known = np.array(sorted(ids.values()))
        got = features([span], known)[0]
        scale = got[0] / next(want[u] for u in want if ids[u] == known[0])
        for u, v in want.items():
            assert abs(got[np.searchsorted(known, ids[u])] / scale - v) < 1e-4


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = op3_toxicity(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    caught = sum(p for p, t in held if t) / sum(t for _, t in held)
    false = sum(p for p, t in held if not t) / sum(1 - t for _, t in held)
    # some insults of this table are joined from ordinary syllables and occur in clean texts too
    assert caught >= 0.8 and false <= 0.02, (caught, false)


def test_disguised_insults(spark, words):
    rng = random.Random(9)
    insults = [b"worthless", b"pathetic", b"disgusting", b"stupid", b"moron", b"scumbag"]
    prose = lambda: [rng.choice(words) for _ in range(rng.randint(20, 60))]
    clean = [" ".join(prose()) + "." for _ in range(600)]
    toxic = []
    for _ in range(300):
        text = prose()
        for _ in range(rng.randint(1, 3)):
            text.insert(rng.randrange(len(text)), rng.choice(insults).decode())
        toxic.append(" ".join(text))
    model = train(toxic, clean)
    bad = [f"of the lanter {x.decode()} and mi that." for w in insults for x in [w, *disguises(w, rng)[1:]]]
    bad.append("of the p a t h e t i c lan")
    good = [*clean[:50], "", None, "a a a a a a a a", "l o n g"]
    frame = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(frame, model).collect()}
    assert sum(got[i].predicted for i in range(len(bad))) >= 0.75 * len(bad), [bad[i] for i in range(len(bad)) if not got[i].predicted]
    assert sum(got[len(bad) + i].predicted for i in range(len(good))) <= 1


def test_edge_cases(spark, docs, empty, nulls):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = train_on(docs, no_labels)
    assert score_toxicity(empty, model).count() == 0
    assert len(score_toxicity(nulls, model).collect()) == 5
    odd = spark.createDataFrame([(None, 1), (1, None), (12, 1), (12, 0), (14, 0)], "doc_id long, toxic int")
    assert train_on(docs, odd) is not None
    assert len(score_toxicity(docs, train_on(docs, odd)).collect()) == docs.count()


def test_the_sample_does_not_depend_on_task_order(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOXIC", 5)
    monkeypatch.setattr(toxicity, "TRAIN_CLEAN", 7)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bad, good: seen.append((sorted(bad), sorted(good))))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    for parts in (1, 7):
        toxicity.train_on(docs.repartition(parts), labels.repartition(parts))
    assert seen[0] == seen[1] and (len(seen[0][0]), len(seen[0][1])) == (5, 7)
