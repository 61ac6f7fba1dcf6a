"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pathweave.session import shared_dir


def save(df: DataFrame, name: str, scope: str = "query") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return it read again.

    The written table cuts the lineage: what reads it can be retried after an executor is
    lost without computing ``df`` again.  ``scope`` groups tables for :func:`clear`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathweave/{scope}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, scope: str) -> None:
    """Delete the tables that :func:`save` wrote under ``scope``; nothing may still read them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pathweave/{scope}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
