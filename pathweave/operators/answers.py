"""What an answer is made of: properties, sources, prompt contexts, the model's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Properties of vertices and of edges that a prompt may have, and their longest text.
NODE_PROPERTIES = [
    "source_text", "source_article", "source_section_id", "document_id", "full_name", "provider", "effective_date", "product_type", "description",
    "discount_rate_text", "formula_text", "formula_type", "applies_to", "variables", "calculation_type", "formula", "benefit_name", "trigger_condition",
    "payment_amount", "normalized_code", "category", "min_age", "max_age", "gender", "health_condition", "rider_type", "rider_name", "rider_code",
]
EDGE_PROPERTIES = ["source_text", "source_section_id", "description"]
LONGEST = 500
# Keys of an element that are no properties.
NODE_META, EDGE_META = ["T.id", "T.label", "label", "id"], ["T.id", "T.label", "label", "id", "IN", "OUT"]


def properties(element: Column, edge: bool = False) -> Column:
    """The properties in a map of an element's values: all but its identity."""
    return F.map_filter(element, lambda k, _: ~k.isin(EDGE_META if edge else NODE_META))


def prompt_properties(props: Column, edge: bool = False) -> Column:
    """The properties that a prompt may have, long texts cut and marked with ``...``."""
    kept = F.map_filter(props, lambda k, _: k.isin(EDGE_PROPERTIES if edge else NODE_PROPERTIES))
    return F.transform_values(kept, lambda _, v: F.when(F.length(v) > LONGEST, F.concat(F.substring(v, 1, LONGEST), F.lit("..."))).otherwise(v))


def sources(nodes: DataFrame) -> DataFrame:
    """``query_id, id, type, label, source_article, source_text`` of distinct vertices
    (``query_id, ord, id, type, label, properties``); the article is the section if it is empty."""
    first = Window.partitionBy("query_id", "id").orderBy("ord")
    value = lambda k: F.coalesce(F.col("properties")[k], F.lit(""))
    article = F.coalesce(F.expr("nullif(properties['source_article'], '')"), value("source_section_id"))
    one = nodes.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select("query_id", "id", "type", "label", article.alias("source_article"), value("source_text").alias("source_text"))


def naive_sources(hits: DataFrame, longest: int = 200) -> DataFrame:
    """``query_id, id, place, source_text`` of distinct hits (``query_id, id, place, text``), the
    text cut."""
    first = Window.partitionBy("query_id", "id").orderBy("place")
    one = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select("query_id", "id", "place", F.substring(F.coalesce("text", F.lit("")), 1, longest).alias("source_text"))


def context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, context``: a subgraph as JSON, its nodes by ``ord`` and its edges in order, with
    the properties that a prompt may have."""
    one = nodes.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "type", "label", prompt_properties(F.col("properties")).alias("properties")))).alias("n"))
    two = edges.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("src", "dst", "type"))).alias("e"))
    n = F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["label"].alias("label"), x["properties"].alias("properties")))
    e = F.transform(F.coalesce("e", F.array().cast("array<struct<src:string,dst:string,type:string>>")), lambda x: F.struct(x["src"].alias("source"), x["dst"].alias("target"), x["type"].alias("type")))
    return one.join(two, "query_id", "left").select("query_id", F.to_json(F.struct(n.alias("nodes"), e.alias("edges"))).alias("context"))


def prompt(kind: Column, context: Column, templates: dict[str, Column]) -> Column:
    """The prompt of a kind (of ``templates``) with the context put in for ``{context}``."""
    chosen = F.coalesce(*[F.when(kind == k, t) for k, t in templates.items()])
    return F.replace(chosen, F.lit("{context}"), context)


def contract_lines(contracts: Column) -> Column:
    """A line for each contract (``target, product_type, contract_status, start_date``); a missing
    value is ``N/A``."""
    value = lambda c, k: F.coalesce(c[k], F.lit("N/A"))
    line = lambda c: F.concat(F.lit("- "), c["target"], F.lit(" (유형: "), value(c, "product_type"), F.lit(", 상태: "), value(c, "contract_status"), F.lit(", 가입일: "), value(c, "start_date"), F.lit(")"))
    return F.when(F.size(contracts) > 0, F.array_join(F.transform(contracts, line), "\n")).otherwise("계약 정보 없음")


def model_size(intent: Column, complex_: Column) -> Column:
    """``large`` for comparisons and complex questions, ``small`` for others."""
    return F.when((intent == "policy_comparison") | complex_, "large").otherwise("small")


def valid_requests(requests: DataFrame) -> DataFrame:
    """``problem`` of each request (``messages`` of ``role, content``, ``persona``, ``mode``): null
    if it has 1 to 50 messages, users' of 2000 characters at most, and simple names."""
    n = F.coalesce(F.size("messages"), F.lit(0))
    long = F.exists("messages", lambda m: (m["role"] == "user") & (F.length(m["content"]) > 2000))
    name = lambda c: F.col(c).isNull() | F.col(c).rlike("^[A-Za-z0-9_-]+$")
    return requests.withColumn("problem", F.when((n < 1) | (n > 50), "messages").when(F.coalesce(long, F.lit(False)), "content").when(~name("persona"), "persona").when(~name("mode"), "mode"))


def view_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as one table of elements for a viewer; an edge's id is its ends and type."""
    one = nodes.select("query_id", F.lit("nodes").alias("grp"), "id", "type", "label")
    edge = F.concat_ws("-", "src", "dst", "type")
    return one.unionByName(edges.select("query_id", F.lit("edges").alias("grp"), edge.alias("id"), "type", "src", "dst"), allowMissingColumns=True)


def element_classes(elements: DataFrame, applied: DataFrame) -> DataFrame:
    """``query_id, id, classes``: each element's classes by the events (``query_id, element,
    event``) that were applied to it."""
    seen = applied.groupBy("query_id", F.col("element").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("event")), " ").alias("classes"))
    return elements.join(seen, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("classes", F.lit("")).alias("classes"))
