"""Checks of extracted graphs, entity de-duplication, and loading by document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.text import jaro_winkler_of
from pathweave.schema import EDGE_TYPES, VERTEX_TYPES
from pathweave.session import ship_package

MAX_TEXT, NEAR = 500, 0.85


def valid_entities(entities: DataFrame) -> DataFrame:
    """Entities of known types, their text cut and confidence clamped (0.5 if null)."""
    known = entities.where(F.col("type").isin(VERTEX_TYPES))
    return known.withColumn("source_text", F.substring("source_text", 1, MAX_TEXT)).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)))


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of known types with both ends among the document's entities."""
    out = relations.where(F.col("type").isin(EDGE_TYPES))
    for end in ("src", "dst"):
        out = out.join(entities.select("document_id", F.col("id").alias(end)).distinct(), ["document_id", end], "left_semi")
    return out.select(relations.columns)


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities in no relation, but for policies and product categories."""
    ends = relations.select("document_id", F.col("src").alias("id")).unionAll(relations.select("document_id", F.col("dst").alias("id")))
    return entities.where(~F.col("type").isin("Policy", "Product_Category")).join(ends.distinct(), ["document_id", "id"], "left_anti")


def warnings(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``document_id, warnings``: more than one policy, orphans, entities without text."""
    lonely = orphans(entities, relations).groupBy("document_id").agg(F.count("*").alias("orphans"))
    facts = entities.groupBy("document_id").agg(F.count_if(F.col("type") == "Policy").alias("policies"), F.count_if(F.trim(F.coalesce("source_text", F.lit(""))) == "").alias("blank"))
    facts = facts.join(lonely, "document_id", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
    parts = [F.when(F.col("policies") > 1, F.concat(F.lit("policies:"), "policies")), F.when(F.col("orphans") > 0, F.concat(F.lit("orphans:"), "orphans")), F.when(F.col("blank") > 0, F.concat(F.lit("blank:"), "blank"))]
    return facts.select("document_id", F.array_join(F.array_compact(F.array(*parts)), ";").alias("warnings"))


def type_counts(entities: DataFrame) -> DataFrame:
    """``document_id, type, n``."""
    return entities.groupBy("document_id", "type").agg(F.count("*").alias("n"))


def dedup_entities(entities: DataFrame, near: float = NEAR) -> DataFrame:
    """``document_id, id, keep_id`` of the entities (``document_id, ord, id, type, label``).

    In order within a document: an entity with the type and label of an earlier one joins it,
    else the first earlier one of its type whose label is near enough, else it stays.  The
    result depends on the order, so a document is one group; documents are independent.
    """
    ship_package(entities.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        exact: dict[tuple, str] = {}
        kept: dict[str, list[tuple[str, str]]] = {}
        out = []
        for id_, type_, label in zip(group["id"], group["type"], group["label"], strict=True):
            keep = exact.get((type_, label))
            if keep is None:
                keep = next((k for k, other in kept.get(type_, []) if jaro_winkler_of(label, other) >= near), None)
            if keep is None:
                keep = id_
                kept.setdefault(type_, []).append((id_, label))
            exact.setdefault((type_, label), keep)
            out.append(keep)
        return pd.DataFrame({"document_id": group["document_id"], "id": group["id"], "keep_id": out})

    return entities.groupBy("document_id").applyInPandas(run, "document_id string, id string, keep_id string")


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row for each kept entity: label of its first, highest confidence, later properties
    over earlier ones."""
    rows = entities.join(mapping, ["document_id", "id"])
    pairs = rows.select("document_id", "keep_id", "ord", F.explode_outer("properties").alias("k", "v")).where("k IS NOT NULL")
    last = pairs.groupBy("document_id", "keep_id", "k").agg(F.max_by("v", "ord").alias("v"))
    props = last.groupBy("document_id", "keep_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    base = rows.groupBy("document_id", "keep_id").agg(F.min_by("type", "ord").alias("type"), F.min_by("label", "ord").alias("label"), F.max("confidence").alias("confidence"))
    return base.join(props, ["document_id", "keep_id"], "left").withColumnRenamed("keep_id", "id")


def upsert(current: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of both; of equal keys the one with the largest ``order``."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    both = current.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def replace_documents(current: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """The rows of ``new``, and of ``current`` those of documents that ``new`` does not have."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(current.columns).unionByName(new.select(current.columns))


def pending(files: DataFrame, manifest: DataFrame, target: str = "loaded") -> DataFrame:
    """Files that the manifest does not have as done for a target."""
    done = manifest.where(F.col(target)).select("document_id").distinct()
    return files.join(done, "document_id", "left_anti")


def in_batches(frames: Iterator[DataFrame]) -> DataFrame:
    """Several results as one, in one job."""
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out
