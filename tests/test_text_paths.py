"""Paths as text, and fallbacks that are decided before paths are made."""

from pyspark.sql import functions as F

from pathweave.plans import templates
from pathweave.plans.pattern import hops, path_text
from pathweave.plans.templates import enriched, run_template
from pathweave.sources.tpch_graph import load

SF = "/root/testdata/sf0.001"


def key(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def test_text_is_that_of_the_elements(spark):
    g = load(spark, SF)
    text = run_template(g, "comprehensive_lookup", text=True).select("root", "cur", "path", "vertices")
    assert key(text) == key(run_template(g, "comprehensive_lookup").select("root", "cur", path_text(), hops().cast("long")))


def test_decided_as_by_counting(spark, monkeypatch):
    g = load(spark, SF)
    # policies without product categories, eligibility and orders are left to counting
    g.edges = g.edges.where("type NOT IN ('OWNS', 'REQUIRES_ELIGIBILITY') AND (type != 'GOVERNED_BY' OR src NOT LIKE '%3')")
    got = enriched(g, "dividend_eligibility_check", text=True).select("root", "chosen", "path")
    counted = templates._choices(g, "dividend_eligibility_check", g.vertices.where("type = 'Policy'").select(F.col("id").alias("root")))
    chosen = {r["root"]: r["chosen"] for r in counted.collect()}
    rows = got.collect()
    assert len(set(chosen.values())) > 1 and {r["chosen"] for r in rows} > {"primary"}
    assert all(chosen[r["root"]] == r["chosen"] for r in rows)
    monkeypatch.setattr(templates, "_reaching", lambda *_: None)
    assert key(got) == key(enriched(g, "dividend_eligibility_check", text=True).select("root", "chosen", "path"))


def test_no_policy_is_counted_where_types_decide(spark, monkeypatch):
    def counted(*_):
        raise AssertionError("counted")

    monkeypatch.setattr(templates, "_choices", counted)
    assert enriched(load(spark, SF), "dividend_eligibility_check").count() > 0
