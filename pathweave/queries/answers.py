"""Routing, decisions, answers' parts and their evaluation, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import text as tx
from pathweave.operators import answers, evaluation
from pathweave.plans.templates import aspect, plan
from pathweave.sources.tpch_graph import GRAPH_SQL, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# routing

_QUESTIONS = """SELECT o_orderkey AS query_id,
CASE o_orderkey % 7 WHEN 0 THEN 'regulation_inquiry' WHEN 1 THEN 'policy_comparison' WHEN 2 THEN 'dividend_check' WHEN 3 THEN 'exclusion_exception' WHEN 4 THEN 'coverage_inquiry' WHEN 5 THEN 'loan_inquiry' ELSE 'general' END AS intent,
CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN o_orderkey % 5 = 1 THEN concat('Rider#', o_orderstatus) ELSE concat('Policy#', o_custkey) END AS one, concat('Regulation#', o_custkey % 25) AS two,
CASE o_orderkey % 4 WHEN 0 THEN '한화생명 보험상품' WHEN 1 THEN 'H종신보험' END AS product, CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'a' END AS keyword FROM {orders}"""


@query("planned_runs", f"""WITH q AS ({_QUESTIONS.format(orders='orders')}),
p AS (SELECT query_id, keyword, CASE intent
WHEN 'regulation_inquiry' THEN CASE WHEN one LIKE 'Policy#%' THEN [['regulation_lookup', one], ['regulation_reverse_lookup', two]] WHEN one = 'none' THEN [['regulation_lookup', 'Policy#unknown']] ELSE [['regulation_reverse_lookup', two]] END
WHEN 'policy_comparison' THEN [['comprehensive_lookup', CASE WHEN one = 'none' THEN 'Policy#unknown' ELSE one END]]
WHEN 'dividend_check' THEN CASE WHEN product = 'H종신보험' THEN [['dividend_eligibility_check', CASE WHEN one = 'none' THEN 'Policy#unknown' ELSE one END]] ELSE [['dividend_portfolio_check', NULL]] END
WHEN 'exclusion_exception' THEN [[CASE WHEN keyword IS NULL THEN 'exclusion_full_traverse' ELSE 'exclusion_exception_traverse' END, CASE WHEN one = 'none' THEN 'Policy#unknown' ELSE one END]]
WHEN 'coverage_inquiry' THEN [['coverage_lookup', CASE WHEN one = 'none' THEN 'Policy#unknown' ELSE one END], [CASE WHEN keyword = 'a' THEN 'exclusion_exception_traverse' ELSE 'exclusion_full_traverse' END, CASE WHEN one = 'none' THEN 'Policy#unknown' ELSE one END]]
WHEN 'loan_inquiry' THEN [['comprehensive_lookup', CASE WHEN one = 'none' THEN 'Policy#unknown' ELSE one END]] ELSE [['coverage_lookup', CASE WHEN one = 'none' THEN 'Policy#unknown' ELSE one END]] END AS r FROM q)
SELECT query_id, CAST(i - 1 AS INTEGER) AS exec_no, r[i][1] AS template, r[i][2] AS entry, keyword FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM p)""")
def planned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order; some have no hit, some no policy among them."""
    q = spark.sql(_QUESTIONS.format(orders="{orders}"), orders=_read(spark, sf_dir, "orders"))
    entries = F.when(F.col("one") == "none", F.array().cast("array<string>")).otherwise(F.array("one", "two"))
    return plan(q.select("query_id", "intent", entries.alias("entries"), F.array_compact(F.array("product")).alias("products"), "keyword"))


@query("comparison_aspect", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'exclusion_exception_traverse' WHEN p_size % 4 = 1 THEN 'calculation_lookup' WHEN p_size % 4 = 2 THEN 'dividend_eligibility_check' ELSE 'comprehensive_lookup' END AS template FROM part""")
def comparison_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ["면책 기간", "계산식", "무배당 할인", "연금"])), F.col("p_size") % 4 + 1)
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), aspect(words).alias("template"))


@query("intent_decision", """WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN 'k' || o_orderkey % 2 END AS kw, CASE WHEN o_orderkey % 5 > 0 THEN 0.7 + 0.06 * (o_orderkey % 5) ELSE 0.0 END AS ks, 'k' || o_orderkey % 3 AS em, (o_orderkey % 10) / 10.0 AS es FROM orders)
SELECT id, CASE WHEN kw IS NOT NULL AND ks >= 0.95 THEN kw WHEN kw IS NOT NULL AND ks >= 0.8 THEN CASE WHEN em = kw THEN kw WHEN es >= 0.75 THEN 'general' ELSE kw END WHEN es >= 0.75 THEN em ELSE 'general' END AS intent,
CAST(round(CASE WHEN kw IS NOT NULL AND ks >= 0.95 THEN ks WHEN kw IS NOT NULL AND ks >= 0.8 THEN CASE WHEN em = kw THEN least(ks + 0.05, 1.0) WHEN es >= 0.75 THEN 0.5 ELSE ks END WHEN es >= 0.75 THEN es ELSE 0.5 END, 6) AS DOUBLE) AS confidence FROM q""")
def intent_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kw = F.when(k % 5 > 0, F.concat(F.lit("k"), (k % 2).cast("string")))
    ks = F.when(k % 5 > 0, F.round(0.7 + 0.06 * (k % 5), 6)).otherwise(0.0)
    fallback = F.struct(F.lit("general").alias("intent"), F.lit(0.5).alias("confidence"))
    best = tx.decide_intent(kw, ks, kw, F.concat(F.lit("k"), (k % 3).cast("string")), (k % 10) / 10.0, fallback)
    return _read(spark, sf_dir, "orders").select(k.alias("id"), best["intent"].alias("intent"), best["confidence"].cast("double").alias("confidence"))


# parts of answers


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's part vertices with properties, a question each; a vertex may stand there twice."""
    lines, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    texts = F.map_from_arrays(F.array(*map(F.lit, ["source_text", "source_article", "source_section_id", "secret", "id"])), F.array(F.repeat(F.col("p_name"), F.col("p_size")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_type"), F.lit("x"), F.lit("y")))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("Exclusion#"), "p_partkey").alias("id"), F.lit("Exclusion").alias("type"), F.col("p_name").alias("label"), texts.alias("properties"))


_NODES = "n AS (SELECT l_orderkey AS query_id, l_linenumber AS ord, concat('Exclusion#', p_partkey) AS id, p_name AS label, repeat(p_name, p_size) AS st, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS article FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("answer_sources", f"WITH {_NODES} SELECT DISTINCT query_id, id, 'Exclusion' AS type, label, article AS source_article, st AS source_text FROM n")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.sources(_nodes(spark, sf_dir))


@query("naive_sources", f"WITH {_NODES} SELECT query_id, id, CAST(min(ord) AS INTEGER) AS place, substr(any_value(st), 1, 200) AS source_text FROM n GROUP BY query_id, id")
def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nodes(spark, sf_dir).select("query_id", "id", F.col("ord").cast("int").alias("place"), F.col("properties")["source_text"].alias("text"))
    return answers.naive_sources(hits)


@query("prompt_properties", f"WITH {_NODES} SELECT query_id, ord, id, CASE WHEN length(st) > 500 THEN substr(st, 1, 500) || '...' ELSE st END AS source_text, 'source_article,source_section_id,source_text' AS kept, 'secret,source_article,source_section_id,source_text' AS own FROM n")
def prompt_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = answers.prompt_properties(F.col("properties"))
    names = lambda m: F.array_join(F.sort_array(F.map_keys(m)), ",")
    return _nodes(spark, sf_dir).select("query_id", "ord", "id", props["source_text"].alias("source_text"), names(props).alias("kept"), names(answers.properties(F.col("properties"))).alias("own"))


@query("view_elements", f"""WITH {GRAPH_SQL} SELECT 0 AS query_id, 'nodes' AS grp, id, type, label, NULL AS src, NULL AS dst FROM v WHERE type = 'Regulation'
UNION ALL SELECT 0, 'edges', src || '-' || dst || '-' || type, type, NULL, src, dst FROM e WHERE type = 'STRICTLY_PROHIBITED'""")
def view_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    zero = F.lit(0).alias("query_id")
    return answers.view_elements(g.vertices.where("type = 'Regulation'").select(zero, "id", "type", "label"), g.edges.where("type = 'STRICTLY_PROHIBITED'").select(zero, "src", "dst", "type"))


@query("element_classes", "SELECT user_id AS query_id, CAST(user_id AS VARCHAR) AS id, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS classes FROM events GROUP BY user_id")
def element_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = _read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("user_id").cast("string").alias("element"), F.col("event_type").alias("event"))
    return answers.element_classes(applied.select("query_id", F.col("element").alias("id")).distinct(), applied)


@query("request_problems", """SELECT conv_id, CASE WHEN count(*) > 50 THEN 'messages' WHEN bool_or(role = 'user' AND length(text) > 2000) THEN 'content' WHEN conv_id % 9 = 0 THEN 'persona' END AS problem FROM conversations GROUP BY conv_id""")
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests; every ninth has a persona that is no name."""
    talks = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    requests = talks.withColumn("persona", F.when(F.col("conv_id") % 9 == 0, "a b").otherwise("presenter")).withColumn("mode", F.lit("graph_rag"))
    return answers.valid_requests(requests).select("conv_id", "problem")


@query("corpus_totals", f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM v) AS entities, (SELECT count(*) FROM e) AS relations")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    both = g.vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionAll(g.edges.select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("v").cast("long").alias("entities"), F.sum("e").cast("long").alias("relations"))


# verification


@query("source_coverage", """WITH c AS (SELECT o_custkey AS q, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey AS query_id, round(coalesce(s, 1.0), 6) AS source_coverage FROM customer LEFT JOIN c ON q = c_custkey""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderstatus") == "F").alias("verified"))
    return evaluation.coverage(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")), claims)


@query("claim_edges", """SELECT o_orderkey AS claim_id, m.l_returnflag AS edge_type FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS l_returnflag FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) m ON l_orderkey = o_orderkey""")
def claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first large line of each order as the first edge into a claim's source."""
    key = F.col("o_orderkey")
    matched = _read(spark, sf_dir, "orders").select(key.alias("query_id"), key.alias("claim_id"), F.lit("s").alias("source_id"))
    edges = _read(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("query_id"), F.lit("s").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("ord"))
    return evaluation.first_edges(matched, edges).select("claim_id", "edge_type")


_SCENARIOS = "r AS (SELECT o_orderkey AS k, o_orderpriority AS category, o_orderkey % 50 = 0 AS err, CAST(o_totalprice AS BIGINT) AS ms, o_orderstatus = 'O' AND o_orderkey % 3 = 0 AS bad FROM orders)"


def _scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 50 == 0).alias("error"), F.rint("o_totalprice").cast("long").alias("elapsed_ms"))
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 == 0), "FAIL").otherwise("PARTIAL")
    one = o.select(F.col("o_orderkey").alias("scenario_id"), F.lit("intent").alias("dimension"), status.alias("status"))
    return runs, one.unionAll(one.withColumn("dimension", F.lit("answer")).withColumn("status", F.lit("PASS")))


@query("category_summary", f"WITH {_SCENARIOS} SELECT category, count(*) AS total, count(*) FILTER (WHERE NOT err AND NOT bad) AS pass, count(*) FILTER (WHERE NOT err AND bad) AS fail, count(*) FILTER (WHERE err) AS error, CAST(sum(ms) // count(*) AS BIGINT) AS avg_ms FROM r GROUP BY category")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarise_scenarios(*_scenarios(spark, sf_dir), "category")


@query("failed_dimensions", f"WITH {_SCENARIOS} SELECT category, k AS scenario_id, 'intent' AS dimension FROM r WHERE bad AND NOT err")
def failed_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(*_scenarios(spark, sf_dir))


@query("judged_answers", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN 'FAIL' WHEN o_orderkey % 3 = 0 THEN 'FAIL' WHEN o_orderkey % 3 = 1 THEN CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'FAIL' ELSE 'PASS' END ELSE 'PARTIAL' END AS verdict FROM orders")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    answer = F.when(k % 8 == 0, "  ").otherwise(F.col("o_orderpriority"))
    verdict = F.element_at(F.array(*map(F.lit, ["maybe", "pass", "Partial"])), (k % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "orders").select(k.alias("id"), evaluation.judged(answer, F.array(F.lit("URGENT")), verdict).alias("verdict"))


# texts


@query("law_files", "SELECT doc_id, doc_id % 4 < 2 AS law FROM documents")
def law_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ["보험업법_시행령.md", "암관리법.md", "H종신보험_1.md", "약관.md"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", tx.is_law(names).alias("law"))


@query("section_budget", """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 600 THEN 1 ELSE 0 END + CASE WHEN n <= 600 AND 2 * n <= 1000 THEN 1 WHEN n <= 600 AND 1000 - n > 450 THEN 1 WHEN n > 600 AND n <= 1000 THEN 1 WHEN n > 1000 THEN 1 ELSE 0 END AS kept FROM d""")
def section_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text twice against a budget of 1000 characters; a part of more than 450 is worth it."""
    sections = F.array(F.coalesce("text", F.lit("")), F.coalesce("text", F.lit("")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(tx.within_budget(sections, 1000, 450)).alias("kept"))
