import hashlib
from collections import defaultdict

from pathweave.llm.exact_dedup import drop_copies, new_index, op9_exact_dedup
from tests.llm.conftest import as_dir


def test_query_matches_brute_force(spark, docs, texts, tmp_path):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = op9_exact_dedup(spark, as_dir(docs, tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == len(texts) and {tuple(r) for r in got} == want


def test_second_batch_loses_against_the_index(spark):
    index = new_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (10, "c"), (11, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_copies(first, index).collect()) == [2, 3]
    assert sorted(r.doc_id for r in drop_copies(second, index).collect()) == [11]
    assert spark.table(index.table).count() == 3


def test_hot_group(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS text")
    out = new_index(spark).add(many)
    assert out.where("kept").count() == 5000 - 1666
    assert out.where("group_size > 1").select("keep_id").distinct().collect()[0][0] == 4998


def test_edge_cases(spark, empty, nulls):
    assert drop_copies(empty).columns == empty.columns and drop_copies(empty).count() == 0
    rows = {(r["_row"].doc_id, r["_row"].text, r.kept) for r in new_index(spark).add(nulls).collect()}
    assert rows == {(None, None, False), (1, None, True), (1, "a b", False), (2, "a b", True)}
