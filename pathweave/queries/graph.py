"""Pattern, traversal and subgraph queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.operators import packed, subgraph, traversal
from pathweave.plans.pattern import hops, larger, line, path_text, reachable, trees
from pathweave.plans.templates import TEMPLATES, classes, discounts, enriched, fallback, keyword_exclusions, neighbourhood, ordered_by_label, representatives, resolve_policies, run_template, spread
from pathweave.schema import DELAYS, EDGE_EVENTS, EDGE_STYLES, PROTECTED_CONSTRAINTS, ROLE_SCOPES, role_scope
from pathweave.session import cut
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


# patterns


def _chain(*hops: str) -> str:
    """Paths of required hops (edge types, in order) from ``e`` and ``v``."""
    names = [f"e{i}" for i in range(len(hops))]
    path = "e0.src || " + " || ".join(f"'>{h}>' || {n}.dst" for n, h in zip(names, hops, strict=True))
    joins = " ".join(f"JOIN e {n} ON {n}.src = {m}.dst AND {n}.type = '{h}'" for m, n, h in zip(names, names[1:], hops[1:], strict=False))
    return f"SELECT e0.src AS root, {path} AS path, CAST({len(hops) + 1} AS BIGINT) AS vertices FROM e e0 {joins} WHERE e0.type = '{hops[0]}'"


# an exclusion may follow, and an exception may follow it
_EXCLUDED = """SELECT a.src AS root, a.src || '>{0}>' || a.dst || coalesce('>EXCLUDED_IF>' || x.dst || coalesce('>EXCEPTION_ALLOWED>' || y.dst, ''), '') AS path,
CAST(2 + (x.dst IS NOT NULL)::INT + (y.dst IS NOT NULL)::INT AS BIGINT) AS vertices
FROM e a LEFT JOIN e x ON x.src = a.dst AND x.type = 'EXCLUDED_IF' LEFT JOIN e y ON y.src = x.dst AND y.type = 'EXCEPTION_ALLOWED' WHERE a.type = '{0}'"""
_FULL = """SELECT a.src AS root, a.src || '>HAS_COVERAGE>' || a.dst || '>EXCLUDED_IF>' || x.dst || coalesce('>EXCEPTION_ALLOWED>' || y.dst, '') AS path, CAST(3 + (y.dst IS NOT NULL)::INT AS BIGINT) AS vertices
FROM e a JOIN e x ON x.src = a.dst AND x.type = 'EXCLUDED_IF' LEFT JOIN e y ON y.src = x.dst AND y.type = 'EXCEPTION_ALLOWED' WHERE a.type = 'HAS_COVERAGE'"""
_MAYBE = """SELECT a.src AS root, a.src || '>{0}>' || a.dst || coalesce('>{1}>' || x.dst, '') AS path, CAST(2 + (x.dst IS NOT NULL)::INT AS BIGINT) AS vertices
FROM e a LEFT JOIN e x ON x.src = a.dst AND x.type = '{1}' WHERE a.type = '{0}'"""
#: SQL of the templates' paths as ``root, path, vertices``, written by hand over ``v`` and ``e``.
PATTERN_SQL = {
    "coverage_lookup": _EXCLUDED.format("HAS_COVERAGE"),
    "dividend_eligibility_check": _chain("NO_DIVIDEND_STRUCTURE") + " UNION ALL " + _MAYBE.format("GOVERNED_BY", "EXCEPTIONALLY_ALLOWED"),
    "exclusion_full_traverse": _FULL,
    "surrender_value_lookup": _chain("SURRENDER_PAYS"),
    "discount_eligibility": _chain("HAS_DISCOUNT"),
    # the second optional step starts from where the first has led, or from the regulation
    "regulation_lookup": """SELECT a.src AS root, a.src || '>GOVERNED_BY>' || a.dst || coalesce('>STRICTLY_PROHIBITED>' || x.dst, '') || coalesce('>EXCEPTIONALLY_ALLOWED>' || y.dst, '') AS path,
CAST(2 + (x.dst IS NOT NULL)::INT + (y.dst IS NOT NULL)::INT AS BIGINT) AS vertices FROM e a LEFT JOIN e x ON x.src = a.dst AND x.type = 'STRICTLY_PROHIBITED'
LEFT JOIN e y ON y.src = coalesce(x.dst, a.dst) AND y.type = 'EXCEPTIONALLY_ALLOWED' WHERE a.type = 'GOVERNED_BY'""",
    "regulation_reverse_lookup": "SELECT dst AS root, dst || '>GOVERNED_BY>' || src AS path, CAST(2 AS BIGINT) AS vertices FROM e WHERE type = 'GOVERNED_BY'",
    "calculation_lookup": " UNION ALL ".join(_chain(t, "CALCULATED_BY") for t in ("HAS_COVERAGE", "SURRENDER_PAYS", "HAS_DISCOUNT", "HAS_RIDER")),
    "premium_waiver_lookup": _EXCLUDED.format("WAIVES_PREMIUM"),
    "eligibility_lookup": _chain("REQUIRES_ELIGIBILITY"),
    "rider_lookup": _chain("HAS_RIDER"),
    "dividend_portfolio_check": """SELECT p.id AS root, p.id || coalesce('>NO_DIVIDEND_STRUCTURE>' || x.dst, '') AS path, CAST(1 + (x.dst IS NOT NULL)::INT AS BIGINT) AS vertices
FROM (SELECT id FROM v WHERE starts_with(id, 'Policy#') ORDER BY id LIMIT 30) p LEFT JOIN e x ON x.src = p.id AND x.type = 'NO_DIVIDEND_STRUCTURE'""",
}
PATTERN_SQL["comprehensive_lookup"] = " UNION ALL ".join([
    PATTERN_SQL["coverage_lookup"], _MAYBE.format("HAS_COVERAGE", "CALCULATED_BY"), PATTERN_SQL["dividend_eligibility_check"],
    *map(_chain, ("SURRENDER_PAYS", "REQUIRES_ELIGIBILITY", "HAS_RIDER", "WAIVES_PREMIUM", "OWNS")),
])


def _flat(paths: DataFrame) -> DataFrame:
    return paths.select("root", path_text().alias("path"), hops().cast("long").alias("vertices"))


for _name in TEMPLATES:
    QUERIES[_name] = lambda spark, sf_dir, name=_name: run_template(load(spark, sf_dir), name, text=True).select("root", "path", "vertices")
    SQL[_name] = f"WITH {GRAPH_SQL} SELECT * FROM ({PATTERN_SQL[_name]})"


@query("exclusion_exception_traverse", f"WITH {GRAPH_SQL} SELECT * FROM ({_FULL} AND x.dst IN (SELECT id FROM v WHERE contains(label, 'a')))")
def exclusion_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(keyword_exclusions(load(spark, sf_dir), "a"))


@query("surrender_order", f"WITH {GRAPH_SQL} SELECT src AS root, dst AS id, CAST(row_number() OVER (PARTITION BY src ORDER BY label, dst) AS INTEGER) AS place FROM e JOIN v ON v.id = dst WHERE e.type = 'SURRENDER_PAYS'")
def surrender_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_by_label(run_template(load(spark, sf_dir), "surrender_value_lookup")).select("root", F.col("cur").alias("id"), "place")


@query("discount_details", f"WITH {GRAPH_SQL} SELECT src AS root, id, label, CAST(NULL AS VARCHAR) AS discount_rate_text, source_text FROM e JOIN v ON v.id = dst WHERE e.type = 'HAS_DISCOUNT'")
def discount_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discounts(load(spark, sf_dir))


@query("representative_policies", f"WITH {GRAPH_SQL} SELECT id FROM v WHERE type = 'Policy' ORDER BY id LIMIT 3")
def representative_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representatives(load(spark, sf_dir))


@query("enriched_dividends", f"""WITH {GRAPH_SQL}, o AS ({PATTERN_SQL["dividend_eligibility_check"]}), w AS ({PATTERN_SQL["comprehensive_lookup"]}),
n AS (SELECT src AS root, src || '>' || type || '>' || dst AS path FROM e WHERE src LIKE 'Policy#%' UNION ALL SELECT dst, dst || '>' || type || '>' || src FROM e WHERE dst LIKE 'Policy#%'),
ids AS (SELECT 'o' AS k, root, unnest(string_split(path, '>')) AS x FROM o UNION ALL SELECT 'w', root, unnest(string_split(path, '>')) FROM w),
f AS (SELECT p.id AS root, count(DISTINCT x) FILTER (WHERE k = 'o' AND contains(x, '#')) AS a, count(DISTINCT x) FILTER (WHERE k = 'w' AND contains(x, '#')) AS b, coalesce(bool_or(k = 'o' AND x LIKE 'Dividend_Method#%'), false) AS t FROM v p LEFT JOIN ids ON ids.root = p.id WHERE p.type = 'Policy' GROUP BY p.id),
c AS (SELECT root, CASE WHEN NOT t AND b > a THEN 'comprehensive' WHEN a > 0 THEN 'primary' ELSE 'neighbourhood' END AS chosen FROM f)
SELECT root, chosen, path FROM c JOIN (SELECT root, path, 'primary' AS k FROM o UNION ALL SELECT root, path, 'comprehensive' FROM w UNION ALL SELECT root, path, 'neighbourhood' FROM n) USING (root) WHERE k = chosen""")
def enriched_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's dividend paths, or those of its fallbacks."""
    return enriched(load(spark, sf_dir), "dividend_eligibility_check", text=True).select("root", "chosen", "path")


@query("neighborhood_lookup", f"""WITH {GRAPH_SQL} SELECT src AS root, dst AS neighbour, type FROM e WHERE src LIKE 'Regulation#%'
UNION ALL SELECT dst, src, type FROM e WHERE dst LIKE 'Regulation#%'""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    return neighbourhood(g, g.vertices.where("type = 'Regulation'")).select("root", "neighbour", "type")


@query("policy_resolution", f"""WITH {GRAPH_SQL}, b AS (SELECT DISTINCT dst AS cur, src AS up FROM e),
l1 AS (SELECT DISTINCT v.id AS hit, up AS cur FROM v JOIN b ON cur = v.id WHERE v.type = 'Exclusion'),
l2 AS (SELECT DISTINCT hit, up AS cur FROM l1 JOIN b USING (cur)), l3 AS (SELECT DISTINCT hit, up AS cur FROM l2 JOIN b USING (cur)),
f AS (SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3)
SELECT hit, cur AS policy, CAST(place AS INTEGER) AS place FROM (SELECT hit, cur, row_number() OVER (PARTITION BY hit ORDER BY cur) AS place FROM f WHERE cur LIKE 'Policy#%') WHERE place <= 5""")
def policy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    return resolve_policies(g, g.vertices.where("type = 'Exclusion'"))


@query("isolated_vertices", f"WITH {GRAPH_SQL} SELECT id, type FROM v WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    return subgraph.isolated(g.vertices, g.edges).select("id", "type")


@query("dangling_edges", f"WITH {GRAPH_SQL}, k AS (SELECT id FROM v WHERE type != 'Product_Category') SELECT src, dst, type FROM e WHERE src NOT IN (SELECT id FROM k) OR dst NOT IN (SELECT id FROM k)")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    return subgraph.dangling(g.edges, g.vertices.where("type != 'Product_Category'")).select("src", "dst", "type")


@query("element_counts", f"WITH {GRAPH_SQL} SELECT 'vertex' AS kind, type, count(*) AS n FROM v GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    n = F.count("*").alias("n")
    return g.vertices.groupBy(F.lit("vertex").alias("kind"), "type").agg(n).unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), "type").agg(n))


@query("repaired_edges", f"""WITH {GRAPH_SQL}, r AS (SELECT concat('Exception#', s_suppkey) AS src, concat('Regulation#', s_nationkey) AS dst, 'GOVERNED_BY' AS type FROM supplier
UNION SELECT concat('Policy#', c_custkey), concat('Regulation#', c_nationkey), 'GOVERNED_BY' FROM customer)
SELECT src, dst, type FROM e UNION ALL (SELECT * FROM r EXCEPT SELECT src, dst, type FROM e)""")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair edges from suppliers and customers to their nations, added where missing."""
    g = load(spark, sf_dir)
    supplier, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "customer"))
    pair = lambda t, kind, key, nation: t.select(F.concat(F.lit(f"{kind}#"), key).alias("src"), F.concat(F.lit("Regulation#"), nation).alias("dst"), F.lit("GOVERNED_BY").alias("type"))
    more = pair(supplier, "Exception", "s_suppkey", "s_nationkey").unionByName(pair(customer, "Policy", "c_custkey", "c_nationkey"))
    return subgraph.add_edges(g.edges.select("src", "dst", "type"), more)


# traversal of the regulation patterns, a query for each policy


def _paths(spark: SparkSession, sf_dir: str, template: str = "regulation_lookup", seeds: DataFrame | None = None) -> DataFrame:
    paths = run_template(load(spark, sf_dir), template, seeds).withColumn("path", path_text())
    number = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    return paths.select(F.col("root").alias("query_id"), F.lit(0).alias("exec_no"), number.alias("path_no"), "objects")


def _shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths of one policy for each class with the same first hops, the members and the seeds.

    All policies of a regulation have its continuations: customers times suppliers of a nation.
    """
    members, seeds = classes(load(spark, sf_dir), "regulation_lookup")
    seeds = cut(seeds)
    return _paths(spark, sf_dir, seeds=seeds), members, seeds


def _events(rows: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds' events for all members.  Only the first vertex and the edges of the first hop
    name the root."""
    out = spread(rows, members, seeds)
    edge = F.concat("root", F.expr("substr(element, length(seed) + 1)"))
    own = F.when(F.col("hop") == 0, F.col("root")).when((F.col("hop") == 1) & F.col("event").isin(EDGE_EVENTS), edge)
    return out.withColumn("element", F.coalesce(own, "element")).select(F.col("root").alias("query_id"), *rows.columns[1:])


def paths_sql(template: str = "regulation_lookup") -> str:
    """CTEs ``g`` (paths), ``el`` (elements), ``nd`` (nodes) and ``ed`` (edges) of a template."""
    return f"""WITH {GRAPH_SQL}, g AS (SELECT root AS query_id, row_number() OVER (PARTITION BY root ORDER BY path) AS path_no, string_split(path, '>') AS o FROM ({PATTERN_SQL[template]})),
el AS (SELECT query_id, path_no, k - 1 AS pos, o[k] AS x, o[k - 1] AS before, o[k + 1] AS after, k % 2 = 1 AS is_v FROM (SELECT *, unnest(range(1, len(o) + 1)) AS k FROM g)),
nd AS (SELECT query_id, x AS id, row_number() OVER (PARTITION BY query_id ORDER BY path_no, pos) AS ord, path_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, x ORDER BY path_no, pos) AS r FROM el WHERE is_v) WHERE r = 1),
ed AS (SELECT query_id, path_no, pos, before AS src, after AS dst, x AS type FROM el WHERE NOT is_v)"""


@query("path_nodes", paths_sql() + " SELECT query_id, nd.id, v.type, v.label, CAST(ord AS INTEGER) AS ord FROM nd JOIN v ON v.id = nd.id")
def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, members, seeds = _shared(spark, sf_dir)
    out, root = spread(traversal.nodes(paths), members, seeds), F.col("id") == F.col("seed")
    return out.select(F.col("root").alias("query_id"), F.when(root, F.col("root")).otherwise(F.col("id")).alias("id"), "type", F.when(root, F.col("root_label")).otherwise(F.col("label")).alias("label"), "ord")


@query("path_edges", paths_sql() + " SELECT query_id, CAST(path_no AS INTEGER) AS path_no, CAST(pos AS INTEGER) AS pos, src, dst, type FROM ed")
def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.edges(_paths(spark, sf_dir)).drop("exec_no")


@query("distinct_path_edges", paths_sql() + " SELECT DISTINCT query_id, src, dst, type FROM ed")
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.edges(_paths(spark, sf_dir), distinct_edges=True).select("query_id", "src", "dst", "type")


@query("constraints", paths_sql() + """ SELECT query_id, type AS edge_type, dst AS target, type = 'STRICTLY_PROHIBITED' AS blocked,
CASE WHEN type = 'STRICTLY_PROHIBITED' THEN type END AS reason, CASE WHEN type = 'EXCEPTIONALLY_ALLOWED' THEN true END AS condition_met
FROM ed WHERE type IN ('STRICTLY_PROHIBITED', 'EXCEPTIONALLY_ALLOWED')""")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.constraints(_paths(spark, sf_dir)).select("query_id", "edge_type", "target", "blocked", "reason", "condition_met")


@query("traversal_summary", paths_sql() + """, b AS (SELECT query_id, count(*) AS n_paths, CAST(max((len(o) + 1) // 2) AS BIGINT) AS total_hops FROM g GROUP BY query_id),
t AS (SELECT query_id, string_agg(DISTINCT type, ',' ORDER BY type) AS node_types FROM (SELECT query_id, v.type FROM el JOIN v ON v.id = x WHERE is_v) GROUP BY query_id),
c AS (SELECT query_id, count(*) FILTER (WHERE type IN ('STRICTLY_PROHIBITED', 'EXCEPTIONALLY_ALLOWED')) AS constraints_found, string_agg(DISTINCT type, ',' ORDER BY type) AS edge_types FROM ed GROUP BY query_id)
SELECT query_id, n_paths, total_hops, total_hops - 1 AS edge_hops, coalesce(constraints_found, 0) AS constraints_found, node_types, coalesce(edge_types, '') AS edge_types FROM b JOIN t USING (query_id) LEFT JOIN c USING (query_id)""")
def traversal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.summary(_paths(spark, sf_dir))


def _case(pairs: dict, value: str, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {other} END"


TIMELINE_SQL = paths_sql() + f""", ev AS (SELECT query_id, path_no, pos, 'node_activated' AS event, id AS element, NULL AS style FROM nd
UNION ALL SELECT query_id, path_no, pos, CASE type WHEN 'STRICTLY_PROHIBITED' THEN 'constraint_blocked' WHEN 'EXCEPTIONALLY_ALLOWED' THEN 'constraint_opened' ELSE 'edge_traversed' END, src || '-' || dst || '-' || type, {_case(EDGE_STYLES, 'type', "'default'")} FROM ed),
tm AS (SELECT query_id, row_number() OVER w AS seq, event, element, CAST((pos + 1) // 2 AS BIGINT) AS hop, {_case(DELAYS, 'event', '0')} AS d, style, sum({_case(DELAYS, 'event', '0')}) OVER w AS upto FROM ev WINDOW w AS (PARTITION BY query_id ORDER BY path_no, pos)),
tl AS (SELECT query_id, seq, event, element, hop, CAST(upto - d AS BIGINT) AS delay_ms, style FROM tm
UNION ALL SELECT query_id, max(seq) + 1, 'traversal_complete', NULL, max(hop), CAST(max(upto) AS BIGINT), NULL FROM tm GROUP BY query_id)"""


@query("timeline", TIMELINE_SQL + " SELECT * FROM tl")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, members, seeds = _shared(spark, sf_dir)
    return _events(traversal.timeline(paths), members, seeds)


@query("timeline_player", TIMELINE_SQL + " SELECT query_id, seq, (lead(delay_ms) OVER (PARTITION BY query_id ORDER BY seq) - delay_ms) / 2.0 AS wait_ms FROM tl QUALIFY seq <= 4")
def player(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, members, seeds = _shared(spark, sf_dir)
    played = traversal.play(traversal.timeline(paths), speed=2.0, upto=4).select("query_id", "seq", "wait_ms")
    return spread(played, members, seeds).select(F.col("root").alias("query_id"), "seq", "wait_ms")


@query("merge_overlay", TIMELINE_SQL + """, bd AS (SELECT * FROM tl WHERE event != 'traversal_complete'), la AS (SELECT query_id, max(seq) AS s, max(delay_ms) AS d, max(hop) AS hop FROM bd GROUP BY query_id),
ov AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o_orderkey) AS k, concat('Contract#', o_orderkey) AS element, s, d, hop FROM la JOIN orders ON query_id = concat('Policy#', o_custkey) WHERE o_orderstatus = 'P'),
mg AS (SELECT query_id, seq, event, element, hop, delay_ms FROM bd UNION ALL SELECT query_id, s + k, 'merge_node_added', element, hop, d + 350 * k FROM ov)
SELECT * FROM mg UNION ALL SELECT query_id, max(seq) + 1, 'traversal_complete', NULL, max(hop), max(delay_ms) + 200 FROM mg GROUP BY query_id""")
def merge_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'")
    overlay = orders.select(F.concat(F.lit("Policy#"), "o_custkey").alias("query_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("Contract#"), "o_orderkey").alias("element"))
    paths, members, seeds = _shared(spark, sf_dir)
    events = cut(traversal.timeline(paths))
    last = spread(traversal.last_events(events), members, seeds).select(F.col("root").alias("query_id"), "s", "d", "hop")
    body = _events(events.where("event != 'traversal_complete'"), members, seeds)
    return body.unionByName(traversal.overlay_end(last, overlay)).drop("style")


# subgraphs of the coverage patterns, a query for each policy


#: Places of the trees that are one row each; larger ones go through nodes and edges.
LARGEST = 1 << 18


def _subgraph(spark: SparkSession, sf_dir: str, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    # both are read many times
    paths = _paths(spark, sf_dir, "coverage_lookup", seeds).persist()
    return traversal.nodes(paths).persist(), traversal.edges(paths, distinct_edges=True).persist()


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, packed.Levels, DataFrame | None]:
    """The coverage patterns of policies as trees (``id, next``), the levels' types, and the
    policies (``id``) that are too large for a tree, if there are any."""
    g = load(spark, sf_dir)
    steps, policies = line(g, TEMPLATES["coverage_lookup"]), g.vertices.where("type = 'Policy'")
    large = larger(g, steps, policies, LARGEST)
    if large is not None:
        large = cut(large)
        policies = policies.join(large, "id", "left_anti")
    return trees(g, steps, policies), [("Policy", None)] + [(min(reachable(g, s)), s.types[0]) for s in steps], large


def _one_root(trees: DataFrame) -> DataFrame:
    return trees.select(F.col("id").alias("query_id"), F.array(F.struct("id", "next")).alias("roots"))


COVERAGE_SQL = paths_sql("coverage_lookup") + ", n AS (SELECT query_id, nd.id, v.type, ord FROM nd JOIN v ON v.id = nd.id), ue AS (SELECT DISTINCT query_id, src, dst, type FROM ed)"
DISTANCE_SQL = COVERAGE_SQL + """, u AS (SELECT DISTINCT query_id, src AS a, dst AS b FROM ue UNION SELECT query_id, dst, src FROM ue),
d0 AS (SELECT DISTINCT query_id, query_id AS id, 0 AS d FROM n), d1 AS (SELECT DISTINCT d0.query_id, b AS id, 1 AS d FROM d0 JOIN u ON u.query_id = d0.query_id AND a = id),
d2 AS (SELECT DISTINCT d1.query_id, b AS id, 2 AS d FROM d1 JOIN u ON u.query_id = d1.query_id AND a = id), d3 AS (SELECT DISTINCT d2.query_id, b AS id, 3 AS d FROM d2 JOIN u ON u.query_id = d2.query_id AND a = id),
ds AS (SELECT query_id, id, min(d) AS distance FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY query_id, id)"""


@query("bfs_distance", DISTANCE_SQL + " SELECT query_id, id, CAST(distance AS BIGINT) AS distance FROM ds")
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, large = _trees(spark, sf_dir)
    out = packed.distances(_one_root(rows), depth=3)
    if large is None:
        return out
    nodes, edges = _subgraph(spark, sf_dir, large)
    return out.unionByName(subgraph.distances(edges, nodes.select("query_id", F.col("query_id").alias("id")), depth=3))


_PROTECTED = ", ".join(f"'{t}'" for t in PROTECTED_CONSTRAINTS)


@query("subgraph_prune", DISTANCE_SQL + f""", sf AS (SELECT query_id, src AS id FROM ue WHERE type IN ({_PROTECTED}) UNION SELECT query_id, dst FROM ue WHERE type IN ({_PROTECTED})),
mk AS (SELECT n.*, distance, sf.id IS NOT NULL AS safe, n.type = 'Regulation' AS reg FROM n LEFT JOIN ds ON ds.query_id = n.query_id AND ds.id = n.id LEFT JOIN sf ON sf.query_id = n.query_id AND sf.id = n.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, safe, reg ORDER BY distance NULLS LAST, ord) AS place, count(*) OVER q AS total, count(*) FILTER (WHERE safe) OVER q AS ns,
count(*) FILTER (WHERE safe AND reg) OVER q AS sr, count(*) FILTER (WHERE NOT safe AND reg) OVER q AS nr, count(*) FILTER (WHERE NOT safe AND NOT reg) OVER q AS no FROM mk WINDOW q AS (PARTITION BY query_id)),
sl AS (SELECT *, least(30 - ns - least(greatest(0, 5 - sr), nr, 30 - ns), no) AS others FROM rk)
SELECT query_id, id, type, CAST(ord AS INTEGER) AS ord FROM sl WHERE total <= 30 OR safe OR (ns < 30 AND CASE WHEN reg THEN place <= 30 - ns - others ELSE place <= others END)""")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, levels, large = _trees(spark, sf_dir)
    out = packed.prune(_one_root(rows), levels, depth=3)
    if large is None:
        return out
    nodes, edges = _subgraph(spark, sf_dir, large)
    near = subgraph.distances(edges, nodes.select("query_id", F.col("query_id").alias("id")), depth=3)
    return out.unionByName(subgraph.prune(nodes, edges, near).select("query_id", "id", "type", "ord"))


def _number(policy: str = "id"):
    return F.substring_index(policy, "#", -1).cast("long")


def _pair(policy: str = "id"):
    return F.floor(_number(policy) / 2).cast("string")


@query("policy_comparison")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring policies 2k and 2k + 1 compared, for every k."""
    rows, levels, large = _trees(spark, sf_dir)
    rows, more = rows.withColumn("query_id", _pair()), None
    if large is not None:
        pairs = large.select(_pair().alias("query_id")).distinct()
        rows = rows.join(pairs, "query_id", "left_anti")
        policies = load(spark, sf_dir).vertices.where("type = 'Policy'").select("id").withColumn("query_id", _pair())
        more = _compared(_paths(spark, sf_dir, "coverage_lookup", policies.join(pairs, "query_id", "left_semi")))
    # paths are in the order of their policies
    rows = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "next"))).alias("roots"))
    out = packed.compare(rows, levels, lambda ids: np.array([int(x.rsplit("#", 1)[-1]) % 2 + 1 for x in ids.to_pylist()]))
    return out if more is None else out.unionByName(more)


def _compared(paths: DataFrame) -> DataFrame:
    """The same from paths."""
    order = Window.partitionBy("query_id").orderBy("root", "path_no")
    both = paths.select(_pair("query_id").alias("query_id"), F.col("query_id").alias("root"), "exec_no", "path_no", "objects").withColumn("path_no", F.row_number().over(order)).drop("root")
    both = both.persist()
    nodes, edges = traversal.nodes(both).persist(), traversal.edges(both, distinct_edges=True).persist()
    policies = nodes.where("type = 'Policy'").withColumn("side", (_number() % 2 + 1).cast("int"))
    return subgraph.compare(nodes, edges, policies.select("query_id", "side", "id")).select("query_id", "id", "type", "compared")


_CUSTOMER = ", ".join(f"'{t}'" for t in ROLE_SCOPES["customer"])


@query("role_nodes", COVERAGE_SQL + f" SELECT query_id, id, type FROM n WHERE type IN ({_CUSTOMER})")
def role_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _subgraph(spark, sf_dir)
    return subgraph.visible(nodes, edges, role_scope(spark), "customer")[0].select("query_id", "id", "type")


@query("role_edges", COVERAGE_SQL + f", k AS (SELECT query_id, id FROM n WHERE type IN ({_CUSTOMER})) SELECT query_id, src, dst, type FROM ue WHERE (query_id, src) IN (SELECT query_id, id FROM k) AND (query_id, dst) IN (SELECT query_id, id FROM k)")
def role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _subgraph(spark, sf_dir)
    return subgraph.visible(nodes, edges, role_scope(spark), "customer")[1].select("query_id", "src", "dst", "type")


@query("fallback_choice", f"""WITH {GRAPH_SQL}, c AS (SELECT v.id AS query_id, count(*) FILTER (WHERE e.type = 'NO_DIVIDEND_STRUCTURE') AS n_primary,
count(*) FILTER (WHERE e.type IN ('HAS_COVERAGE', 'OWNS')) AS n_comprehensive, count(e.src) AS n_neighbourhood FROM v LEFT JOIN e ON e.src = v.id WHERE v.type = 'Policy' GROUP BY v.id)
SELECT query_id, CASE WHEN m = 0 THEN 'neighbourhood' WHEN n_primary = 0 AND n_comprehensive > n_primary THEN 'comprehensive' ELSE 'primary' END AS chosen, CASE WHEN m = 0 THEN n_neighbourhood ELSE m END AS n_nodes
FROM (SELECT *, CASE WHEN n_primary = 0 AND n_comprehensive > n_primary THEN n_comprehensive ELSE n_primary END AS m FROM c)""")
def fallback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy, whether a dividend lookup is answered by itself or by its fallbacks."""
    g = load(spark, sf_dir)
    at = g.edges.select(F.col("src").alias("id"), F.col("type").alias("e_type"))
    counts = g.vertices.where("type = 'Policy'").select("id").join(at, "id", "left").groupBy(F.col("id").alias("query_id")).agg(
        F.count_if(F.col("e_type") == "NO_DIVIDEND_STRUCTURE").alias("n_primary"),
        F.count_if(F.col("e_type").isin("HAS_COVERAGE", "OWNS")).alias("n_comprehensive"), F.count("e_type").alias("n_neighbourhood"),
    )
    return fallback(counts.withColumn("has_target", F.col("n_primary") > 0))
