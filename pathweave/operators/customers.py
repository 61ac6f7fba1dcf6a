"""Customers' contracts: summary, matching with consent, overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contract_summary(contracts: DataFrame) -> DataFrame:
    """``customer_id, contract_count, contracts``, the contracts as JSON by id."""
    item = F.struct("contract_id", "policy_id", "contract_status")
    return contracts.groupBy("customer_id").agg(F.count("*").alias("contract_count"), F.to_json(F.sort_array(F.collect_list(item))).alias("contracts"))


def match_contracts(contracts: DataFrame, entry: DataFrame, consent: DataFrame) -> DataFrame:
    """Contracts of consenting customers on their entry policies (``customer_id, policy_id``);
    where none is, all their active ones."""
    allowed = contracts.join(consent.where("granted").select("customer_id"), "customer_id", "left_semi")
    hit = entry.select("customer_id", "policy_id").distinct().withColumn("match", F.lit(1))
    marked = allowed.join(hit, ["customer_id", "policy_id"], "left").withColumn("match", F.coalesce("match", F.lit(0)))
    any_ = F.max("match").over(Window.partitionBy("customer_id"))
    return marked.withColumn("any", any_).where("match = 1 OR (any = 0 AND contract_status = 'active')").drop("any")


def overlay(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The customers' nodes and their ``OWNS`` edges with five properties."""
    node = contracts.groupBy("customer_id", "customer_name").agg(F.count("*").alias("contract_count"))
    node = node.select(F.concat(F.lit("Customer#"), "customer_name").alias("id"), F.lit("Customer").alias("type"), F.col("customer_name").alias("label"), "contract_count")
    props = F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate([c for name in ("contract_id", "contract_status", "start_date", "premium_amount", "coverage_amount") for c in (name, name)])])
    edge = contracts.select(F.concat(F.lit("Customer#"), "customer_name").alias("src"), F.col("policy_id").alias("dst"), F.lit("OWNS").alias("type"), props.alias("properties"))
    return node, edge


def latest_consent(events: DataFrame) -> DataFrame:
    """``customer_id, granted``: the last event of each customer."""
    last = events.groupBy("customer_id").agg(F.max_by("granted", F.struct("ts", "event_id")).alias("granted"), F.max("ts").alias("ts"))
    return last
