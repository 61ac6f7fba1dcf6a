from collections import Counter, defaultdict
from fractions import Fraction

from pathweave.llm import mixing
from pathweave.llm.mixing import earliest_deadlines, mix, mixed, op10_mixing_sources
from tests.llm.conftest import as_dir


def frame(spark, sizes):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string")


def test_every_prefix_is_within_a_block(spark):
    weights = {"a": 5, "b": 3, "c": 1.5, "d": 0.5}
    out = mix(frame(spark, {"a": 900, "b": 400, "c": 300, "d": 90}), weights, block=4).collect()
    place = {(r["_row"].source, r.block): r.place for r in out}
    assert all(r.in_mix == (r.place is not None) for r in out)
    inside = sorted((p, s) for (s, b), p in place.items() if p is not None)
    assert [p for p, _ in inside] == list(range(len(inside))) and len(inside) > 100
    done = Counter()
    for t, (_, s) in enumerate(inside, 1):
        done[s] += 1
        for source, w in weights.items():
            assert abs(done[source] - t * w / 10) < 1
    # the mixture ends where a source's next block is missing
    blocks = {"a": 225, "b": 100, "c": 75, "d": 23}
    assert any(done[s] == blocks[s] for s in weights) and len(out) == 1690


def test_earliest_deadline_first(spark):
    """The schedule equals a plain simulation."""
    w = {"a": 7, "b": 2, "c": 1}
    out = mix(frame(spark, {"a": 70, "b": 20, "c": 10}), w, block=1).collect()
    done, order = Counter(), []
    for t in range(100):
        s = min((-(-(done[s] + 1) * 10 // w[s]), s) for s in w if done[s] * 10 // w[s] <= t)[1]
        order.append(s)
        done[s] += 1
    assert [r["_row"].source for r in sorted(out, key=lambda r: r.place)] == order


def test_shares_that_no_period_holds(spark):
    """Shares like 1/3 and 0.0003 deviate by less than a block at every slot."""
    weights = {"third": 1 / 3, "rare": 0.0003, "rest": 1 - 1 / 3 - 0.0003}
    out = mix(frame(spark, {"third": 3000, "rare": 3, "rest": 6000}), weights, block=1)
    order = [r.source for r in out.where("in_mix").orderBy("place").select("_row.source").collect()]
    done, total = Counter(), sum(map(Fraction, weights.values()))
    for t, s in enumerate(order, 1):
        done[s] += 1
        for source, w in weights.items():
            assert abs(done[source] - t * Fraction(w) / total) < 1
    assert len(order) > 8000 and done["rare"] in (2, 3)


def test_longer_blocks_bound_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 10)
    out = mix(frame(spark, {"a": 300, "b": 100}), block=16).collect()
    assert max(r.block for r in out if r["_row"].source == "a") == 7 and len(out) == 400


def test_query_keeps_every_row(spark, docs, tmp_path):
    got = op10_mixing_sources(spark, as_dir(docs, tmp_path)).collect()
    assert len(got) == docs.count()
    ranks = defaultdict(list)
    for r in got:
        ranks[r.source].append(r.rank)
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_edge_cases(spark, docs, empty, nulls):
    assert mix(empty).count() == 0 and mixed(empty).columns == empty.columns
    assert mixed(docs).columns == docs.columns
    rows = mix(nulls).collect()
    assert len(rows) == 5 and sorted(r.rank for r in rows) == [0, 1, 2, 3, 4] and all(r.in_mix for r in rows)
    none = mix(docs, {"src0": 1}).collect()
    assert {r["_row"].source for r in none if r.in_mix} == {"src0"}
    assert all(r.place is None for r in none if r["_row"].source != "src0")


def test_source_of_one_row_keeps_its_share(spark):
    """A rare source is not raised to a slot of a period, which would end the mixture early."""
    sizes = {"hot": 60_000, None: 1} | {f"s{i:02}": 6000 for i in range(20)}
    shares = {s: round(n**0.8 * 2**20) for s, n in sizes.items()}
    ends = min(-(-n // 16) / (shares[s] / sum(shares.values())) for s, n in sizes.items())
    names = ["hot"] * 60_000 + [f"s{i % 20:02}" for i in range(120_000)] + [None]
    rows = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    out = mix(rows)
    places = [(r.place, r.source) for r in out.where("in_mix").select("place", "_row.source").distinct().collect()]
    assert sorted(p for p, _ in places) == list(range(len(places))) and abs(len(places) - ends) < 2 * len(sizes)
    done = Counter()
    for t, (_, s) in enumerate(sorted(places, key=lambda p: p[0]), 1):
        done[s] += 1
        for source, share in shares.items():
            assert abs(done[source] - t * share / sum(shares.values())) < 1 + 1e-9
    assert mixed(rows).count() > 0.9 * 16 * ends
    assert out.count() == len(names) and out.where("place is null and in_mix").count() == 0


def test_exact_weights():
    assert list(earliest_deadlines([], [])) == []
    order = earliest_deadlines([Fraction(2.0**60), Fraction(1.0)], [1000, 1])
    assert list(order) == [0] * 1000


def test_any_number_of_sources(spark, tmp_path):
    sizes = {f"host{i:04}": 1 + i % 3 for i in range(1500)} | {"hot": 400}
    rows = frame(spark, sizes)
    got = op10_mixing_sources(spark, as_dir(rows, tmp_path)).collect()
    assert Counter(r.source for r in got) == sizes
    first = [r.place for r in got if r.block == 0 and r.in_mix]
    assert len(set(first)) == len({(r.source, r.place) for r in got if r.block == 0 and r.in_mix}) > 0
    kept = Counter(r.source for r in mixed(rows).collect())
    assert sum(kept.values()) > 0 and all(kept[s] <= n for s, n in sizes.items())
