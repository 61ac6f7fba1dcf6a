"""What the queries at a hub shuffle: customers times suppliers of a nation are rows, not shuffled rows."""

import pytest

from pathweave.operators import traversal
from pathweave.plans.templates import classes
from pathweave.queries import graph
from pathweave.sources.tpch_graph import load

SF = "/root/testdata/sf0.01"


def shuffled(spark, frame):
    """The frame's rows and the records that its stages wrote to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    total = lambda: sum(s.shuffleWriteRecords() for s in stages())

    def stages():
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    before = total()
    rows = frame().collect()
    sc.listenerBus().waitUntilEmpty()
    return rows, total() - before


def key(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", ["path_nodes", "timeline_player", "timeline", "merge_overlay"])
def test_shuffles_less_than_the_paths(spark, name):
    _, wrote = shuffled(spark, lambda: graph.QUERIES[name](spark, SF))
    # every policy passes a few times (8,487 records at most); before, its paths and elements did as well (15,322 at least)
    assert wrote < 7 * spark.read.parquet(f"{SF}/customer.parquet").count()


def test_classes_stand_for_all_policies(spark):
    members, seeds = classes(load(spark, SF), "regulation_lookup")
    assert seeds.count() == 25 and members.count() == 1500
    assert key(graph.QUERIES["path_nodes"](spark, SF).collect()) == key(traversal.nodes(graph._paths(spark, SF)).collect())
    assert key(graph.QUERIES["timeline"](spark, SF).collect()) == key(traversal.timeline(graph._paths(spark, SF)).collect())


def test_each_root_its_own_class_where_paths_may_come_back(spark):
    g = load(spark, SF)
    g.ends = {}
    _, seeds = classes(g, "regulation_lookup")
    assert seeds.count() == 1500
