"""Readers of parquet tables and of text, JSON lines and JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A table stored as one small file is read by one task; whoever computes on its texts shuffles it first.
    Tables of many files are left as they are.
    """
    sc = df.sparkSession.sparkContext
    return df if df.rdd.getNumPartitions() >= sc.defaultParallelism else df.repartition(sc.defaultParallelism)
