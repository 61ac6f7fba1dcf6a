"""A training corpus from ``documents``: clean, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir), where ``docs`` is all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from pathweave.llm import scratch
from pathweave.llm.exact_dedup import drop_copies
from pathweave.llm.mixing import mixed
from pathweave.llm.near_dedup import one_of_each
from pathweave.llm.packing import pack
from pathweave.llm.quality import keep_clean

_own = threading.local()


def _scope(spark: SparkSession) -> str:
    """A folder of its own for a stage's tables.

    A stage's output is written when the next one begins, so that one removes them; pipelines
    that run at the same time, in one driver or in several, do not meet.
    """
    if last := getattr(_own, "scope", None):
        scratch.clear(spark, last)
    _own.scope = f"pipeline-{uuid.uuid4().hex}"
    return _own.scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, their failing lines removed."""
    _scope(spark)
    return keep_clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id."""
    _scope(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id."""
    return one_of_each(docs, _scope(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents up to where every source still meets its target weight."""
    _scope(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return pack(docs, _scope(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenisation and shingling have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is a written table as well."""
    docs, scope = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"pipeline-run-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name, scope)
    return docs
