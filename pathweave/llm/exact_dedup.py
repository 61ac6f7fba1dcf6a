"""Exact duplicates by a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.scratch import save, shared_dir

#: A group with more than this share of a batch's rows is resolved by broadcast; at most
#: 1 / HOT_SHARE groups can be that large.
HOT_SHARE = 0.001


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """The digests of every text seen so far, as a table bucketed and sorted by digest.

    ``path`` holds the table's files, so that a later session can attach to them with the
    same number of ``buckets`` (at first: the session's number of shuffle partitions).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def add(self, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """Append the batch's new digests and decide about each row.

        ``docs`` needs ``doc_id`` and ``text``.  Returns ``_row`` (a struct of the
        row's columns, or of those in ``carry``, whatever their names), ``digest``, ``keep_id``, ``group_size`` (rows of the
        batch with this text) and ``kept``.  Among equal texts of one batch the largest
        doc_id stays; a text that an earlier batch brought stays there, and all its rows here
        go.  Rows that repeat a doc_id are one document and share its fate.  Null doc_ids
        lose against any other; a group without ids keeps all its rows.  Null texts are empty
        texts.  An empty batch changes nothing.
        """
        batch = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_digest(F.col("text")).alias("digest"))
        groups = save(batch.groupBy("digest").agg(F.max("_id").alias("batch_id"), F.count("*").alias("group_size")), "digest-groups")
        known = self.spark.table(self.table)
        before = groups.join(known.hint("merge"), "digest")
        seen = save(before.select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old")), "digests-seen")
        new = groups.select("digest", "batch_id").hint("merge").join(known, "digest", "left_anti")
        new.select("digest", F.col("batch_id").alias("keep_id")).write.insertInto(self.table)
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        shared = groups.join(seen, "digest", "left").where("group_size > 1 OR old")
        shared = shared.select("digest", "group_size", F.coalesce("old", F.lit(False)).alias("old"), F.when(F.col("old"), F.col("old_id")).otherwise(F.col("batch_id")).alias("keep_id"))
        limit = max(1000, int(total * HOT_SHARE))
        hot = shared.where(F.col("group_size") > limit).select("digest", F.struct("group_size", "old", "keep_id").alias("hot"))
        cold = shared.where(F.col("group_size") <= limit).select(F.col("digest").alias("key"), F.struct("group_size", "old", "keep_id").alias("cold"))
        out = batch.join(F.broadcast(hot), "digest", "left")
        # rows that are resolved already are dealt out by their id, so that no key is hot below
        out = out.withColumn("key", F.when(F.col("hot").isNotNull(), F.unhex(F.sha2(F.coalesce(F.col("_id").cast("string"), F.lit("")), 256))).otherwise(F.col("digest")))
        out = out.join(cold, "key", "left").withColumn("g", F.coalesce("hot", "cold"))
        alone = F.col("g").isNull()
        return out.select(
            "_row", "digest",
            F.when(alone, F.col("_id")).otherwise(F.col("g.keep_id")).alias("keep_id"),
            F.when(alone, F.lit(1)).otherwise(F.col("g.group_size")).cast("long").alias("group_size"),
            (alone | (~F.col("g.old") & F.col("g.keep_id").eqNullSafe(F.col("_id")))).alias("kept"),
        )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, f"{shared_dir(spark)}/pathweave/index/{uuid.uuid4().hex}")


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    index = index or new_index(docs.sparkSession)
    return index.add(docs).where("kept").select("_row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the texts themselves aren't carried: only ids and digests are shuffled
    out = new_index(spark).add(docs, carry=["doc_id"])
    return out.select(F.col("_row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
