"""Sending this package to the Python workers of a cluster that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as an archive to the session's files, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(), "corpusmill_package.zip")  # read by the driver, which serves it to all
    with zipfile.ZipFile(archive, "w") as out:
        for path in package.rglob("*.py"):
            out.write(path, str(path.relative_to(package.parent)))
    sc.addPyFile(archive)
    _sent.add(sc.applicationId)
