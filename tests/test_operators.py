import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pathweave.functions import text as tx
from pathweave.functions.intents import RULES
from pathweave.operators import integrity, retrieval, subgraph, traversal
from pathweave.plans.pattern import Expand, compile_pattern, path_text, start
from pathweave.plans.templates import plan, run_template
from pathweave.sources import files
from pathweave.sources.tpch_graph import Graph
from pathweave.streaming import streams


def graph(spark, nodes, edges):
    n = spark.createDataFrame([("q", i, t, k) for k, (i, t) in enumerate(nodes)], "query_id string, id string, type string, ord int")
    e = spark.createDataFrame([("q", a, b, t) for a, b, t in edges], "query_id string, src string, dst string, type string")
    return n, e


def kept(spark, nodes, edges, roots, budget=30, depth=40):
    n, e = graph(spark, nodes, edges)
    near = subgraph.distances(e, spark.createDataFrame([("q", r) for r in roots], "query_id string, id string"), depth)
    return {r.id for r in subgraph.prune(n, e, near, budget).collect()}


def test_prune(spark):
    cov = lambda n: [(f"C{i}", "Coverage") for i in range(n)]
    assert len(kept(spark, cov(20), [], ["C0"], depth=1)) == 20
    # regulations have places of their own
    out = kept(spark, cov(28) + [(f"R{i}", "Regulation") for i in range(10)], [], ["C0"], depth=1)
    assert sum(i[0] == "R" for i in out) == 5 and len(out) == 30
    # protected nodes alone, if they fill the budget
    pairs = [(f"A{i}", f"B{i}", "EXCLUDED_IF") for i in range(17)]
    nodes = [(x, "Coverage") for p in pairs for x in p[:2]] + cov(4)
    assert kept(spark, nodes, pairs, ["A0"], depth=1) == {x for p in pairs for x in p[:2]}
    # the nearest of a chain
    chain = [(f"N{i}", "Coverage") for i in range(9)]
    assert kept(spark, chain, [(f"N{i}", f"N{i + 1}", "X") for i in range(8)], ["N0"], budget=5, depth=8) == {f"N{i}" for i in range(5)}


def test_distances(spark):
    _, e = graph(spark, [("A", "X")], [("A", "C", "t"), ("B", "C", "t"), ("C", "A", "u")])
    got = {r.id: r.distance for r in subgraph.distances(e, spark.createDataFrame([("q", "A"), ("q", "B")], "query_id string, id string")).collect()}
    assert got == {"A": 0, "B": 0, "C": 1}


def test_timeline(spark):
    objects = [("vertex", "Policy#test", "Policy", "p"), ("edge", "e1", "HAS_COVERAGE", "HAS_COVERAGE"), ("vertex", "Coverage#1", "Coverage", "c")]
    paths = spark.createDataFrame([("q", 0, 1, objects)], "query_id string, exec_no int, path_no int, objects array<struct<kind: string, id: string, type: string, label: string>>")
    events = [(r.event, r.delay_ms) for r in traversal.timeline(paths).orderBy("seq").collect()]
    assert events == [("node_activated", 0), ("edge_traversed", 200), ("node_activated", 500), ("traversal_complete", 700)]
    overlay = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query_id string, ord int, element string")
    merged = [r.delay_ms for r in traversal.merge_overlay(traversal.timeline(paths), overlay).orderBy("seq").collect()]
    assert merged[-3:] == [850, 1200, 1400]
    assert traversal.summary(paths).first().total_hops == 2


def test_rank_fusion(spark):
    hits = lambda ids: spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "query_id string, id string, place int")
    got = retrieval.rank_fusion([hits("AB"), hits("CA")], 3).orderBy("place").collect()
    assert [r.id for r in got] == ["A", "C", "B"]
    assert [round(r.score, 6) for r in got] == [0.032522, 0.016393, 0.016129]


def test_hybrid_score(spark):
    f = spark.createDataFrame([(0.9, 3.2, 1), (0.9, 3.2, 0)], "v double, h double, c int")
    assert [r.s for r in f.select(retrieval.hybrid_score(f.v, f.h, f.c).alias("s")).collect()] == [0.87, 0.67]


def test_entity_dedup(spark):
    rows = [("d", 0, "a", "Coverage", "MARTHA"), ("d", 1, "b", "Coverage", "MARHTA"), ("d", 2, "c", "Rider", "MARTHA"), ("d", 3, "e", "Coverage", "other"), ("d", 4, "f", "Coverage", "MARTHA"), ("x", 0, "g", "Coverage", "MARTHA")]
    frame = spark.createDataFrame(rows, "document_id string, ord int, id string, type string, label string")
    got = {(r.document_id, r.id): r.keep_id for r in integrity.dedup_entities(frame).collect()}
    assert got == {("d", "a"): "a", ("d", "b"): "a", ("d", "c"): "c", ("d", "e"): "e", ("d", "f"): "a", ("x", "g"): "g"}


def test_graph_documents(spark, tmp_path):
    entity = lambda i, t, **p: {"id": i, "type": t, "label": i, "properties": p, "provenance": {"source_section_id": "s", "source_text": "x" * 600, "confidence": 1.7}}
    doc = {"document_id": "d", "product_name": "p", "entities": [entity("P", "Policy"), entity("C", "Coverage"), entity("U", "Unknown")], "relations": [{"source_id": "P", "target_id": "C", "type": "HAS_COVERAGE", "properties": {}, "provenance": None}, {"source_id": "P", "target_id": "Z", "type": "HAS_COVERAGE", "properties": {}, "provenance": None}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    (tmp_path / "_manifest.json").write_text("{}")
    docs = files.read_graph_documents(spark, str(tmp_path))
    assert docs.count() == 1
    entities = integrity.valid_entities(files.entities(docs))
    assert {(r.id, len(r.source_text), r.confidence) for r in entities.collect()} == {("P", 500, 1.0), ("C", 500, 1.0)}
    relations = files.relations(docs).select("document_id", "src", "dst", "type")
    assert [r.dst for r in integrity.valid_relations(relations, entities).collect()] == ["C"]
    assert integrity.orphans(entities, relations).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t\nx")
    (tmp_path / "b.md").write_text("y")
    assert [r.text for r in files.read_markdown(spark, str(tmp_path), "a").collect()] == ["# t\nx"]
    assert files.list_binaries(spark, str(tmp_path), ".md", ["b[.]md"]).count() == 1
    tagged = spark.createDataFrame([('{"@type": "g:Int64", "@value": 5}',), (None,)], "r string")
    assert [r.r for r in files.decode_responses(tagged, "r").collect()] == ["5", None]
    assert files.health({"ok": tagged, "none": tagged.limit(0)}) == {"ok": True, "none": False}


def test_embedding_once_for_each_text(spark):
    frame = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    got = files.embed_distinct(frame, "t", lambda texts: [[float(len(t or ""))] for t in texts]).collect()
    assert sorted(r.embedding[0] for r in got) == [0.0, 3.0, 3.0]
    vector = frame.limit(1).select(files.hashed_embedding(frame.t).alias("v")).first().v
    assert len(vector) == 64 and sum(x * x for x in vector) == pytest.approx(1)


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, ts timestamp, v int"
    part = lambda *rows: spark.createDataFrame([(k, None, v) for k, v in rows], schema)
    part((1, 1), (2, 1)).write.parquet(source)
    load = lambda: streams.load_new_files(spark, source, schema, target, str(tmp_path / "cp"))
    load()
    load()
    assert spark.read.parquet(target).count() == 2
    part((1, 2)).write.mode("append").parquet(source)
    load()
    assert spark.read.parquet(target).count() == 3
    latest = str(tmp_path / "latest")
    streams.keep_latest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), latest, str(tmp_path / "cp2"), "k", "v")
    import os

    last = max(os.listdir(latest), key=lambda n: int(n[1:]))
    assert {(r.k, r.v) for r in spark.read.parquet(f"{latest}/{last}").collect()} == {(1, 2), (2, 1)}


def test_distances_have_no_limit(spark):
    e = spark.createDataFrame([("q", str(i), str(i + 1), "T") for i in range(7)], "query_id string, src string, dst string, type string")
    roots = spark.createDataFrame([("q", "0")], "query_id string, id string")
    assert {r.id: r.distance for r in subgraph.distances(e, roots).collect()} == {str(i): i for i in range(8)}
    assert subgraph.distances(e, roots, 2).count() == 3


def test_nested_optional_needs_its_first_step(spark):
    """A coverage without exclusion does not follow an exception edge of its own; a chained optional does."""
    vertices = spark.createDataFrame([(i, i.split("#")[0], i, "") for i in ("Policy#1", "Coverage#1", "Coverage#2", "Exclusion#1", "Exception#1")], "id string, type string, label string, source_text string")
    edges = [("Policy#1", "Coverage#1", "HAS_COVERAGE"), ("Policy#1", "Coverage#2", "HAS_COVERAGE"), ("Coverage#1", "Exception#1", "EXCEPTION_ALLOWED"), ("Coverage#2", "Exclusion#1", "EXCLUDED_IF"), ("Exclusion#1", "Exception#1", "EXCEPTION_ALLOWED")]
    graph = Graph(vertices, spark.createDataFrame(edges, "src string, dst string, type string"))
    got = {r.p for r in run_template(graph, "coverage_lookup").select(path_text().alias("p")).collect()}
    assert got == {"Policy#1>HAS_COVERAGE>Coverage#1", "Policy#1>HAS_COVERAGE>Coverage#2>EXCLUDED_IF>Exclusion#1>EXCEPTION_ALLOWED>Exception#1"}
    chained = compile_pattern(start(graph, F.col("type") == "Policy"), graph, (Expand(("HAS_COVERAGE",)), Expand(("EXCLUDED_IF",), optional=True), Expand(("EXCEPTION_ALLOWED",), optional=True)))
    assert "Policy#1>HAS_COVERAGE>Coverage#1>EXCEPTION_ALLOWED>Exception#1" in {r.p for r in chained.select(path_text().alias("p")).collect()}


def test_comparison_takes_two_policies_and_regulations_both_ways(spark):
    rows = [("c", "policy_comparison", ["Coverage#1", "Policy#1", "Policy#2", "Policy#1", "Policy#3"], None, None), ("r", "regulation_inquiry", ["Regulation#1", "Policy#1", "Policy#2", "Policy#3", "Policy#4"], None, None), ("n", "nonsense", None, None, None)]
    got = plan(spark.createDataFrame(rows, "query_id string, intent string, entries array<string>, products array<string>, keyword string")).collect()
    runs = {q: [(r.template, r.entry) for r in got if r.query_id == q] for q in "crn"}
    assert runs["c"] == [("comprehensive_lookup", "Policy#1"), ("comprehensive_lookup", "Policy#2")]
    assert runs["r"] == [("regulation_lookup", f"Policy#{k}") for k in (1, 2, 3)] + [("regulation_reverse_lookup", "Regulation#1")]
    assert runs["n"] == [("coverage_lookup", "Policy#unknown")]


def test_sections_are_split_and_joined_like_a_plain_loop(spark):
    def plain(text, size):
        at = [m.start() for m in re.finditer(r"^(?:### |## ■ )", text, re.M)]
        out, begin = [], 0
        for i, p in enumerate(at):
            end = at[i + 1] if i + 1 < len(at) else len(text)
            if end - begin > size and begin != p:
                if text[begin:p].strip():
                    out.append(text[begin:p].strip())
                begin = p
        return [*out, text[begin:].strip()] if out else [text]

    rng = random.Random(1)
    texts = ["", "none", "### a", "### a\n### b\n", *["".join(rng.choice(["### h\n", "## ■ r\n", "word word\n", "x" * 30 + "\n", "\n", " "]) for _ in range(rng.randint(1, 25))) for _ in range(60)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in frame.select("i", tx.sub_split(F.col("t"), 60).alias("p")).collect():
        assert r.p == plain(texts[r.i], 60)
    got = spark.createDataFrame([(["a" * 60, "b" * 60, "c"],), ([],)], "s array<string>").select(tx.within_budget(F.col("s"), 100, 10).alias("o")).collect()
    assert got[0].o == ["a" * 60, "b" * 40 + "..."] and got[1].o == []


def test_glossary_cut_and_three_products(spark):
    row = spark.createDataFrame([("배당금", "H종신보험 e정기보험 H암보험 알려줘")], "a string, b string")
    got = row.select(tx.expand_glossary(F.col("a"), {}, {"배당금": ["긴긴긴긴긴긴긴긴긴긴 이름"]}).alias("a"), tx.disambiguate(F.col("b"), F.lit("general"), RULES).alias("b")).first()
    assert got.a == "배당금 긴긴긴긴긴" and len(got.a) == 9 and got.b == "policy_comparison"
