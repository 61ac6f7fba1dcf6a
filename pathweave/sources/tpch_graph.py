"""A property graph over relational tables, and the same graph as SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Graph:
    """``vertices(id, type, label, source_text)`` and ``edges(src, dst, type)``.

    ``ends`` has, for edge types of which it is known, the types of their sources and targets.
    ``hubs`` are types of few vertices at which many paths meet many edges.
    """

    vertices: DataFrame
    edges: DataFrame
    ends: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    hubs: tuple[str, ...] = ()


#: One SELECT for each vertex type; the same text runs in Spark and in DuckDB.
VERTICES = """
SELECT concat('Policy#', c_custkey) AS id, 'Policy' AS type, c_name AS label, concat('segment ', c_mktsegment) AS source_text FROM customer
UNION ALL SELECT concat('Coverage#', o_orderkey), 'Coverage', concat('order ', o_orderkey), concat('status ', o_orderstatus, ' priority ', o_orderpriority) FROM orders
UNION ALL SELECT concat('Exclusion#', p_partkey), 'Exclusion', p_name, concat('brand ', p_brand, ' type ', p_type) FROM part
UNION ALL SELECT concat('Exception#', s_suppkey), 'Exception', s_name, '' FROM supplier
UNION ALL SELECT concat('Regulation#', n_nationkey), 'Regulation', n_name, concat('nation ', n_name) FROM nation
UNION ALL SELECT concat('Product_Category#', r_name), 'Product_Category', r_name, '' FROM region
UNION ALL SELECT DISTINCT concat('Product_Category#', c_mktsegment), 'Product_Category', c_mktsegment, '' FROM customer
UNION ALL SELECT DISTINCT concat('Dividend_Method#', c_mktsegment), 'Dividend_Method', c_mktsegment, '' FROM customer
UNION ALL SELECT DISTINCT concat('Eligibility#', c_mktsegment), 'Eligibility', c_mktsegment, '' FROM customer
UNION ALL SELECT DISTINCT concat('Premium_Discount#', o_orderpriority), 'Premium_Discount', o_orderpriority, concat('rate ', o_orderpriority) FROM orders
UNION ALL SELECT DISTINCT concat('Calculation#', o_orderpriority), 'Calculation', o_orderpriority, '' FROM orders
UNION ALL SELECT DISTINCT concat('Rider#', o_orderstatus), 'Rider', o_orderstatus, '' FROM orders
UNION ALL SELECT concat('Surrender_Value#', o_orderkey), 'Surrender_Value', concat('refund ', o_orderkey), '' FROM orders WHERE o_orderstatus = 'P'
"""

EDGES = """
SELECT concat('Policy#', o_custkey) AS src, concat('Coverage#', o_orderkey) AS dst, 'HAS_COVERAGE' AS type FROM orders
UNION ALL SELECT DISTINCT concat('Coverage#', l_orderkey), concat('Exclusion#', l_partkey), 'EXCLUDED_IF' FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT DISTINCT concat('Exclusion#', l_partkey), concat('Exception#', l_suppkey), 'EXCEPTION_ALLOWED' FROM lineitem WHERE l_linestatus = 'F' AND l_discount >= 0.09
UNION ALL SELECT concat('Policy#', c_custkey), concat('Regulation#', c_nationkey), 'GOVERNED_BY' FROM customer
UNION ALL SELECT concat('Regulation#', n_nationkey), concat('Product_Category#', r_name), 'STRICTLY_PROHIBITED' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
UNION ALL SELECT concat('Regulation#', s_nationkey), concat('Exception#', s_suppkey), 'EXCEPTIONALLY_ALLOWED' FROM supplier WHERE s_acctbal > 5000
UNION ALL SELECT concat('Policy#', c_custkey), concat('Dividend_Method#', c_mktsegment), 'NO_DIVIDEND_STRUCTURE' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT DISTINCT concat('Policy#', o_custkey), concat('Premium_Discount#', o_orderpriority), 'HAS_DISCOUNT' FROM orders
UNION ALL SELECT concat('Policy#', o_custkey), concat('Surrender_Value#', o_orderkey), 'SURRENDER_PAYS' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT concat('Coverage#', o_orderkey), concat('Calculation#', o_orderpriority), 'CALCULATED_BY' FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT DISTINCT concat('Premium_Discount#', o_orderpriority), concat('Calculation#', o_orderpriority), 'CALCULATED_BY' FROM orders WHERE o_orderpriority < '3'
UNION ALL SELECT DISTINCT concat('Policy#', o_custkey), concat('Rider#', o_orderstatus), 'HAS_RIDER' FROM orders
UNION ALL SELECT concat('Policy#', c_custkey), concat('Eligibility#', c_mktsegment), 'REQUIRES_ELIGIBILITY' FROM customer
UNION ALL SELECT concat('Policy#', o_custkey), concat('Coverage#', o_orderkey), 'WAIVES_PREMIUM' FROM orders WHERE o_orderpriority < '2'
UNION ALL SELECT concat('Policy#', c_custkey), concat('Product_Category#', c_mktsegment), 'OWNS' FROM customer
"""

#: Types of each edge type's sources and targets in this graph.
ENDS = {
    "HAS_COVERAGE": (("Policy",), ("Coverage",)), "EXCLUDED_IF": (("Coverage",), ("Exclusion",)), "EXCEPTION_ALLOWED": (("Exclusion",), ("Exception",)),
    "GOVERNED_BY": (("Policy",), ("Regulation",)), "STRICTLY_PROHIBITED": (("Regulation",), ("Product_Category",)), "EXCEPTIONALLY_ALLOWED": (("Regulation",), ("Exception",)),
    "NO_DIVIDEND_STRUCTURE": (("Policy",), ("Dividend_Method",)), "HAS_DISCOUNT": (("Policy",), ("Premium_Discount",)), "SURRENDER_PAYS": (("Policy",), ("Surrender_Value",)),
    "CALCULATED_BY": (("Coverage", "Premium_Discount"), ("Calculation",)), "HAS_RIDER": (("Policy",), ("Rider",)), "REQUIRES_ELIGIBILITY": (("Policy",), ("Eligibility",)),
    "WAIVES_PREMIUM": (("Policy",), ("Coverage",)), "OWNS": (("Policy",), ("Product_Category",)),
}

#: 25 regulations, to which all policies and suppliers belong.
HUBS = ("Regulation",)

#: Common table expressions ``v`` and ``e`` for the queries' SQL.
GRAPH_SQL = f"v AS ({VERTICES}), e AS ({EDGES})"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named tables of a folder."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over a folder's tables.

    Filters and column choice reach the scans: a branch that a query does not ask for by edge
    type is pruned by the optimizer, since each branch's type is a literal.
    """
    frames = tables(spark, sf_dir, *TABLES)
    return Graph(spark.sql(_bound(VERTICES), **frames), spark.sql(_bound(EDGES), **frames), ENDS, HUBS)


def _bound(sql: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
