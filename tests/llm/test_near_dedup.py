import random
import re

import pytest
from pyspark.sql import functions as F

from pathweave.llm import near_dedup
from pathweave.llm.near_dedup import components, near_duplicates, one_of_each, op6_minhash_near_dedup
from tests.llm.conftest import as_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(ws) < 5:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    edges = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                edges.append((a, b))
    return roots([i for i, _ in rows], edges), {i: len(x) for i, x in sets}


@pytest.fixture(scope="module")
def family(words):
    """Chains of drifting copies, a hot group of near copies, and a passage that many share."""
    rng = random.Random(8)
    out = []
    for _ in range(5):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(12):
            base = list(base)
            base[rng.randrange(80)] = f"w{rng.random()}"
            out.append(" ".join(base))
    hot = [rng.choice(words) for _ in range(120)]
    for k in range(150):
        out.append(" ".join([*hot[:60], f"x{k}", *hot[61:]]))
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(120):
        own = [rng.choice(words) for _ in range(rng.randint(15, 40))]
        out.append(" ".join(passage + own))
    return out


def test_query_matches_brute_force(spark, docs, texts, family, tmp_path):
    every = [*texts, *family]
    frame = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(6)
    root, sizes = brute(list(enumerate(every)))
    got = op6_minhash_near_dedup(spark, as_dir(frame, tmp_path)).collect()
    assert len(got) == len(every)
    assert {r.doc_id: r.component_id for r in got} == root
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_a_large_bucket(spark, family, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 12_000)
    rows = list(enumerate(family))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)[0]


def test_more_ids_than_the_bitmap_holds(spark, family, monkeypatch):
    monkeypatch.setattr(near_dedup, "MAX_BITS", 64)
    rows = list(enumerate(family))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)[0]


def test_open_buckets_give_out_fewer_links_than_members(spark, words, tmp_path):
    """Unlike texts that share a passage agree in pairs, but no pair leaves a task."""
    rng = random.Random(4)
    passage = [rng.choice(words) for _ in range(60)]
    rows = [(i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(10, 30))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = near_dedup.sketches(docs)
    reps = sketched.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    labels = spark.createDataFrame([], "node long, component long")
    links = near_dedup._cross_links(docs, near_dedup._bands(reps), labels, reps, "test").collect()
    root = roots(range(300), [(r.a, r.b) for r in links])
    assert root == brute(rows)[0]
    # a member of 32 buckets brings at most one link to each block of theirs
    assert len(links) < 32 * 300 < sum(1 for a in rows for b in rows if a < b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500, k) for k in range(501, 700)] + [(k, k + 1) for k in range(800, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: c for n, c in roots({x for e in edges for x in e}, edges).items() if n != c}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark, docs, empty, nulls):
    assert near_duplicates(empty).count() == 0
    out = one_of_each(docs)
    assert out.columns == docs.columns
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(nulls).collect()}
    assert rows == {(None, 0, None), (1, 0, 1), (1, 1, 1), (2, 1, 1)}
