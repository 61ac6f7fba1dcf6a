"""Mixing sources to target weights by Pfair scheduling of blocks; DataFrame operations only."""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents in a block, and the most blocks that a schedule has: of more documents than
#: BLOCK * MAX_BLOCKS a block holds more, so that the schedule stays this long.
BLOCK, MAX_BLOCKS = 16, 1 << 22
#: Without given weights a source's weight is its number of documents to this power, to 2^-20.
ALPHA, UNIT = 0.8, 1 << 20
#: A source's documents are dealt into buckets of about so many rows to rank them, at most
#: MAX_BUCKETS for each source.
BUCKET_ROWS, MAX_BUCKETS = 512, 1 << 16


def _source():
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s:"), F.col("source").cast("string")))


def earliest_deadlines(weights: list[Fraction], ends: list[int]) -> array:
    """The number of the source that each slot takes, by exact weights of any size.

    Block k of a source with w of the weights' sum W is released at floor(k W / w) and due at
    ceil((k + 1) W / w).  Each slot takes the released block that is due first, of equal ones
    the first source.  So every block meets its deadline, and after any number of slots each
    source has less than one block more or less than its weight asks.  It ends before the
    first slot whose source s has no block ``ends[s]``, so there are no more slots than blocks.
    """
    scale, order = max((w.denominator for w in weights), default=1), array("i")
    # all denominators are powers of two, as the weights were floats
    whole = [int(w * scale) for w in weights]
    total, done = sum(whole), [0] * len(whole)
    waiting = [(0, -(-total // w), s) for s, w in enumerate(whole)]
    ready: list[tuple[int, int]] = []
    while whole:
        while waiting and waiting[0][0] <= len(order):
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s))
        s = heapq.heappop(ready)[1]
        if done[s] == ends[s]:
            break
        order.append(s)
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // whole[s], -(-(done[s] + 1) * total // whole[s]), s))
    return order


def _schedule(docs: DataFrame, weights: dict[str, float] | None, block: int) -> tuple[DataFrame, int, int]:
    """``_source, block, place`` of the blocks in the mixture, the number of documents, and of
    those in a block.

    The driver has a row for each source and 4 bytes for each block, ``MAX_BLOCKS`` at most and one
    more for each source.
    """
    found = sorted((r["_source"], r["n"]) for r in docs.groupBy(_source().alias("_source")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in found)
    block = max(block, -(-total // MAX_BLOCKS))
    given = None if weights is None else {"n" if k is None else f"s:{k}": Fraction(v) for k, v in weights.items() if v > 0}
    part = [(s, n, Fraction(round(n**ALPHA * UNIT)) if given is None else given[s]) for s, n in found if given is None or s in given]
    order = np.frombuffer(earliest_deadlines([w for *_, w in part], [-(-n // block) for _, n, _ in part]), dtype=np.int32)
    place = np.argsort(order, kind="stable")
    count = np.bincount(order, minlength=len(part))
    number = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    names = pa.array([s for s, *_ in part], pa.string()).take(pa.array(order[place]))
    table = pa.table({"_source": names, "block": pa.array(number, pa.int64()), "place": pa.array(place, pa.int64())})
    return docs.sparkSession.createDataFrame(table, "_source string, block long, place long"), total, block


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """Give every row of ``docs`` (``doc_id``, ``source``) its place in the mixture.

    Returns ``_row`` (a struct of the row's columns, or of those in ``carry``, whatever their
    names), ``block`` (the block's number in its source), ``place`` (the block's slot in the
    whole schedule), ``rank`` (the row's number in its source, in an order drawn by ``seed``)
    and ``in_mix``.  Every block is scheduled from its source's exact weight.  Up to the first
    slot whose source has no block left, the mixture holds its target weights: these blocks are
    ``in_mix``, later ones have no place.  The last block of a source may be short.  Null
    sources are a source of their own; null doc_ids come first in their source; repeated rows
    and rows of equal doc_id each have a rank; texts are not read, however long.  Rows of
    sources without weight have no place and are not in the mix.  An empty table gives an empty
    result.

    Ranks are counted within buckets of a source and the buckets' sizes summed up, so a source
    of any size is spread over many tasks; a bucket's row has the places of its blocks.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"), _source().alias("_source"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_hash"),
    )
    table, total, block = _schedule(docs, weights, block)
    buckets = max(1, min(MAX_BUCKETS, -(-total // BUCKET_ROWS)))
    number = F.conv(F.substring("_hash", 1, 6), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(number * buckets / (1 << 24)).cast("int"))
    sizes = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), "_n")
    first, last = F.floor(F.col("_base") / block), F.floor((F.col("_base") + F.col("_n") - 1) / block)
    spread = bases.select("_source", "_bucket", "_base", F.explode(F.sequence(first, last)).alias("block")).join(table, ["_source", "block"], "left")
    bases = spread.groupBy("_source", "_bucket", "_base").agg(F.sort_array(F.collect_list(F.struct("block", "place"))).alias("_blocks"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", "_id")) - 1)
    ranked = ranked.join(bases, ["_source", "_bucket"]).withColumn("rank", F.col("_base") + F.col("_in"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    place = F.col("_blocks")[(F.col("block") - F.col("_blocks")[0]["block"]).cast("int")]["place"]
    return ranked.select("_row", "rank", "block", place.alias("place"), place.isNotNull().alias("in_mix"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents of the mixture at its target weights, with their own columns."""
    return mix(docs, weights).where("in_mix").select("_row.*")


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, carry=["doc_id", "source"])
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), "rank", "block", "place", "in_mix")


OP10_SQL = """
WITH RECURSIVE src AS (
  SELECT CASE WHEN source IS NULL THEN 'n' ELSE 's:' || source END AS s, count(*) AS n FROM documents GROUP BY 1
), weights AS (
  SELECT s, CAST(round(pow(n, 0.8) * 1048576) AS HUGEINT) AS w, (n + 15) // 16 AS blocks, row_number() OVER (ORDER BY s) AS p FROM src
), plan AS (
  SELECT list(w ORDER BY s) AS ws, list(blocks ORDER BY s) AS ends, CAST(sum(w) AS HUGEINT) AS total FROM weights
), steps(t, ks, p) AS (
  SELECT CAST(0 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS HUGEINT)), CAST(NULL AS BIGINT) FROM plan
  UNION ALL
  SELECT t + 1, list_transform(ks, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (
    SELECT t, ks, ends, CAST(list_min(list_transform(range(1, len(ws) + 1), lambda i:
             CASE WHEN ks[i] * total // ws[i] <= t THEN ((ks[i] + 1) * total + ws[i] - 1) // ws[i] * 100000 + i END)) % 100000 AS BIGINT) AS pick
    FROM steps, plan
  ) WHERE ks[pick] < ends[pick]
), slots AS (
  SELECT row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS block, t - 1 AS place, p FROM steps WHERE p IS NOT NULL
), ranked AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's:' || source END AS s,
         row_number() OVER (PARTITION BY source ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS rank
  FROM documents
)
SELECT doc_id, source, rank, rank // 16 AS block, place, place IS NOT NULL AS in_mix
FROM ranked JOIN weights USING (s) LEFT JOIN slots ON slots.p = weights.p AND slots.block = rank // 16
"""
