"""Subgraphs as one row each give what those of nodes and edges give, and shuffle less."""

import pytest

from pathweave.plans.pattern import larger, line, trees
from pathweave.plans.templates import TEMPLATES
from pathweave.queries import graph
from pathweave.sources.tpch_graph import load
from tests.test_shared_paths import key

SF = "/root/testdata/sf0.001"
NAMES = ["bfs_distance", "subgraph_prune", "policy_comparison"]


def odd(spark, g):
    """Ids of which one is another's beginning, one exclusion of two coverages, double edges, a
    coverage of two policies, a missing vertex, and a policy with more coverages than a budget."""
    e = [(f"Policy#{p}", f"Coverage#{c}", "HAS_COVERAGE") for p, c in ((2, 5), (2, 50), (2, 51), (2, 51), (3, 51), (3, 99), (4, 7), (5, 8))]
    e += [("Policy#5", f"Coverage#{c}", "HAS_COVERAGE") for c in range(100, 140)]
    e += [(f"Coverage#{c}", f"Exclusion#{x}", "EXCLUDED_IF") for c, x in ((5, 1), (50, 1), (50, 10), (51, 10), (7, 404), (101, 1), (101, 3), (139, 10))]
    e += [(f"Exclusion#{x}", f"Exception#{y}", "EXCEPTION_ALLOWED") for x, y in ((1, 1), (1, 11), (10, 1), (3, 2))]
    v = {("Policy", p) for p in (2, 3, 4, 5, 6)} | {("Coverage", c) for c in (5, 50, 51, 7, 8, *range(100, 140))} | {("Exclusion", x) for x in (1, 10, 3)} | {("Exception", y) for y in (1, 11, 2)}
    g.vertices = spark.createDataFrame([(f"{t}#{k}", t, "", "") for t, k in v], "id string, type string, label string, source_text string")
    g.edges = spark.createDataFrame(e, "src string, dst string, type string")
    return g


@pytest.mark.parametrize("name, tables, limit", [*((n, "odd", 8) for n in NAMES), ("policy_comparison", "sf0.001", 0)])
def test_as_by_nodes_and_edges(spark, monkeypatch, name, tables, limit):
    if tables == "odd":
        monkeypatch.setattr(graph, "load", lambda spark, sf_dir: odd(spark, load(spark, sf_dir)))
    monkeypatch.setattr(graph.packed, "PIECE_BYTES", 1 << 14)
    got = key(graph.QUERIES[name](spark, SF).collect())
    # policies with more places are too large for a tree
    monkeypatch.setattr(graph, "LARGEST", limit)
    assert got and key(graph.QUERIES[name](spark, SF).collect()) == got
    spark.catalog.clearCache()


def written(spark, run):
    """The records that the run's stages wrote to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    # old stages are forgotten meanwhile
    last = max((s.stageId() for s in stages()), default=-1)
    run()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > last)


@pytest.mark.parametrize("name", NAMES)
def test_shuffles_no_paths(spark, name):
    wrote, paths = written(spark, lambda: graph.QUERIES[name](spark, SF).collect()), graph.QUERIES["coverage_lookup"](spark, SF).count()
    # single hops pass a few times; before, paths, their elements, nodes and edges in both directions did
    assert wrote < 3 * paths


def test_larger(spark):
    g = odd(spark, load(spark, SF))
    steps, policies = line(g, TEMPLATES["coverage_lookup"]), g.vertices.where("type = 'Policy'")
    assert larger(g, steps, policies, 10_000) is None
    assert {r.id for r in larger(g, steps, policies, 40).collect()} == {"Policy#5"}
    assert {r.id for r in trees(g, steps, policies).collect()} == {"Policy#2", "Policy#3", "Policy#4", "Policy#5"}


def test_no_line(spark):
    g = load(spark, SF)
    assert line(g, TEMPLATES["regulation_lookup"]) is None and line(g, TEMPLATES["comprehensive_lookup"]) is None
    g.ends = {}
    assert line(g, TEMPLATES["coverage_lookup"]) is None
