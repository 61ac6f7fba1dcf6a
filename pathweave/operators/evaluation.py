"""Answer verification and scenario evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAITHFUL = 0.85


def match_claims(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """``claim_id, source_id, verified``: the first node (by ``ord``) whose text, or else label,
    the claim contains.  ``nodes`` is one answer's subgraph and is broadcast."""
    text = F.coalesce(F.expr("nullif(source_text, '')"), "label")
    keyed = nodes.select("query_id", "ord", F.col("id").alias("source_id"), text.alias("needle")).where("needle != ''")
    hits = claims.join(keyed, "query_id").where(F.contains("claim_text", "needle"))
    first = hits.groupBy("query_id", "claim_id").agg(F.min_by("source_id", "ord").alias("source_id"))
    return claims.join(first, ["query_id", "claim_id"], "left").withColumn("verified", F.col("source_id").isNotNull())


def coverage(queries: DataFrame, verified: DataFrame) -> DataFrame:
    """``query_id, source_coverage``: the share of verified claims; 1 without claims."""
    share = verified.groupBy("query_id").agg(F.avg(F.col("verified").cast("int")).alias("share"))
    return queries.select("query_id").join(share, "query_id", "left").select("query_id", F.round(F.coalesce("share", F.lit(1.0)), 6).alias("source_coverage"))


def first_edges(matched: DataFrame, edges: DataFrame) -> DataFrame:
    """The matched claims with ``edge_type``: the type of the first edge (by ``ord``, then type) into
    their source, null without one."""
    first = edges.groupBy("query_id", F.col("dst").alias("source_id")).agg(F.min(F.struct("ord", "type"))["type"].alias("edge_type"))
    return matched.join(first, ["query_id", "source_id"], "left")


def faithfulness(queries: DataFrame, asserted: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, faithfulness``: the share of distinct asserted (target, type) that the subgraph
    has; 1 without assertions."""
    there = edges.select("query_id", F.col("dst").alias("target"), "type").distinct().withColumn("hit", F.lit(1.0))
    share = asserted.select("query_id", "target", "type").distinct().join(there, ["query_id", "target", "type"], "left")
    share = share.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("faithfulness"))
    return queries.select("query_id").join(share, "query_id", "left").withColumn("faithfulness", F.round(F.coalesce("faithfulness", F.lit(1.0)), 6))


def confidence_label(score: Column, high: float = 0.95, medium: float = 0.85) -> Column:
    """``high``, ``medium`` or ``low``."""
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def verdict(scores: DataFrame, known_templates: list[str]) -> DataFrame:
    """``passed`` and ``confidence`` from ``faithfulness`` and ``template``."""
    only = F.col("template").isin(known_templates)
    return scores.withColumn("template_only", only).withColumn("passed", only & (F.col("faithfulness") >= FAITHFUL)).withColumn("confidence", confidence_label(F.col("faithfulness")))


def score_scenarios(runs: DataFrame) -> DataFrame:
    """``scenario_id, dimension, status`` for five dimensions.

    ``runs``: ``error, expected_intent, actual_intent, expected_policy, hit_ids, expected_templates,
    actual_templates, required_types, actual_types, verification, negative, answer``; lists are
    arrays, expectations may be null or empty.
    """
    missing = F.size(F.array_except("required_types", "actual_types"))
    lacking = F.filter("verification", lambda w: ~F.contains(F.col("answer"), w))
    forbidden = F.exists("negative", lambda w: F.contains(F.col("answer"), w))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    n = F.size("verification")
    tests = {
        "intent": F.when(F.col("expected_intent").isNull(), "SKIP").when(F.col("expected_intent") == F.col("actual_intent"), "PASS").otherwise("FAIL"),
        "vector": F.when(F.col("expected_policy").isNull(), "SKIP").when(F.exists("hit_ids", lambda h: F.contains(h, F.col("expected_policy"))), "PASS").otherwise("FAIL"),
        "template": F.when(none("expected_templates"), "SKIP").when(F.arrays_overlap("expected_templates", "actual_templates"), "PASS").otherwise("FAIL"),
        "subgraph": F.when(none("required_types"), "SKIP").when(missing == 0, "PASS").when(missing < F.size("required_types"), "PARTIAL").otherwise("FAIL"),
        "answer": F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "FAIL").when(~none("verification") & (F.size(lacking) == n), "FAIL").when(~none("verification") & (F.size(lacking) > 0), "PARTIAL").when(F.coalesce(forbidden, F.lit(False)), "FAIL").otherwise("PASS"),
    }
    scored = F.array(*[F.struct(F.lit(k).alias("dimension"), F.when(F.col("error"), "ERROR").otherwise(v).alias("status")) for k, v in tests.items()])
    return runs.select("scenario_id", F.explode(scored).alias("d")).select("scenario_id", "d.dimension", "d.status")


def summarise(results: DataFrame, by: str = "dimension", runs: DataFrame | None = None) -> DataFrame:
    """Counts of each status and the pass rate by a column; errors are not rated.  With ``runs``
    (``scenario_id, error``), scenarios that broke off are left out."""
    if runs is not None:
        results = results.join(runs.where("error").select("scenario_id"), "scenario_id", "left_anti")
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    out = results.groupBy(by).agg(*[count(s) for s in ("PASS", "FAIL", "PARTIAL", "SKIP", "ERROR")])
    rated = F.col("pass") + F.col("fail") + F.col("partial")
    return out.withColumn("pass_rate", F.when(rated > 0, F.round(100 * F.col("pass") / rated, 1)))


def summarise_scenarios(runs: DataFrame, results: DataFrame, by: str) -> DataFrame:
    """``by, total, pass, fail, error, avg_ms``: scenarios (``scenario_id, error, elapsed_ms`` and
    ``by``) that passed, failed or broke off; one passes if none of its dimensions fails, and the
    mean time is a whole number, rounded down."""
    # exact: a quotient of doubles may be rounded up to a whole number
    mean = F.expr("(sum(elapsed_ms) - pmod(sum(elapsed_ms), count(*))) div count(*)")
    failed = results.where("status = 'FAIL'").select("scenario_id").distinct().withColumn("failed", F.lit(True))
    each = runs.join(failed, "scenario_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return each.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(~F.col("error") & ~F.col("failed")).alias("pass"), F.count_if(~F.col("error") & F.col("failed")).alias("fail"),
        F.count_if("error").alias("error"), mean.cast("long").alias("avg_ms"),
    )


def failures(runs: DataFrame, results: DataFrame) -> DataFrame:
    """``category, scenario_id, dimension`` of every failed dimension of scenarios without error."""
    return results.where("status = 'FAIL'").join(runs.where(~F.col("error")).select("scenario_id", "category"), "scenario_id").select("category", "scenario_id", "dimension")


def judged(answer: Column, negative: Column, verdict: Column) -> Column:
    """A judge's verdict on an answer: an empty one fails, an unknown verdict fails, and a pass with
    a forbidden word fails."""
    forbidden = F.exists(negative, lambda w: F.contains(answer, w))
    known = F.when(F.upper(verdict).isin("PASS", "PARTIAL", "FAIL"), F.upper(verdict)).otherwise("FAIL")
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", "FAIL").when((known == "PASS") & F.coalesce(forbidden, F.lit(False)), "FAIL").otherwise(known)


def batches(items: DataFrame, order: str, size: int = 3) -> DataFrame:
    """``batch``: the items in batches of ``size`` by an order, counted within each group
    ``grp`` so that no task orders all of them."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy(order)) - 1
    return items.withColumn("batch", F.floor(place / size).cast("long"))
