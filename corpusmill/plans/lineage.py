"""Cutting of lineage in a folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if it is not yet.

    It is the one the session names in ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests on one
    machine, a temporary one is made; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusmill-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the checkpoint folder, for files that are written and read again."""
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed parquet table below the checkpoint folder and read back, by column.

    For wide rows that are read again: a checkpoint of texts takes a multiple of the parquet table they come from. The table is deleted when the session ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.parquet(path)


def cut(df: DataFrame, *, free: bool = False) -> DataFrame:
    """``df`` written to the checkpoint folder and read back.

    ``free``: garbage is collected, so that Spark deletes the shuffle files behind what was written; for plans that move a multiple of
    their input.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    out = df.checkpoint(eager=True)
    del df  # collected references let Spark delete the files, if the caller holds none
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out
