"""Small text files in any file system that Spark reads: manifests, reports, histories."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file, in place of one that is there."""
    system, where = _at(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A whole file; a missing one is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path).lstrip("\ufeff"))


def append_line(spark: SparkSession, path: str, value: Any) -> None:
    """Add one JSON object as a line. Not every file system can append, so what is there is read and written again."""
    before = read_text(spark, path) if exists(spark, path) else ""
    write_text(spark, path, before + json.dumps(value, ensure_ascii=False) + "\n")


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or a folder."""
    system, where = _at(spark, source)
    to, there = _at(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, where, to, there, False, spark._jsc.hadoopConfiguration())
