"""Text values of several tables and columns in one long form, and passes over them a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

CHUNK = 500


def long_form(parts: list[tuple[DataFrame, str, str, str | None]], row_id: str = "row_idx") -> DataFrame:
    """``(table_name, row_idx, field_name, label, text)`` of some (table, its name, field, label column)."""
    rows = []
    for df, name, field, label in parts:
        said = F.col(label) if label else F.lit(None).cast("string")
        rows.append(spread(df.select(F.lit(name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_idx"), F.lit(field).alias("field_name"), said.alias("label"), F.col(field).alias("text")).where("row_idx is not null")))
    return reduce(DataFrame.unionByName, rows)


def over(df: DataFrame, make: Callable[[], Callable[[list, list[str | None]], list[tuple]]], names: list[str], schema: str) -> DataFrame:
    """Rows out of ``f(rows of names, texts)`` for the batches of ``df``, where ``make`` builds f once a task.

    A tuple that f returns is one row of ``schema``; its first value is the number of the input row, whose columns
    ``names`` come first in the output.
    """
    own = df.select(*names, "text")
    kept = ", ".join(f"{n} {own.schema[n].dataType.simpleString()}" for n in names)
    fields = [x.strip().split(" ") for x in schema.split(",")]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for batch in (whole.slice(i, CHUNK) for i in range(0, whole.num_rows, CHUNK)):
                columns = [batch.column(i).to_pylist() for i in range(len(names))]
                rows = f(list(zip(*columns)), batch.column(len(names)).to_pylist())
                at = pa.array([r[0] for r in rows], pa.int64())
                out = [batch.column(i).take(at) for i in range(len(names))]
                out += [pa.array([r[i + 1] for r in rows], types[t]) for i, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(out, names=[*names, *(n for n, _ in fields)])

    return own.mapInArrow(run, f"{kept}, {schema}")
