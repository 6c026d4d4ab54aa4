"""Records that are the same but for formatting: collapse of raw rows, then of canonical texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from ..sources.tables import spread
from .fields import bare, canonical
from .links import join_hot


def _canonical(plain: int, fielded: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(plain + fielded)]
            parts = [[bare(t) for t in c] for c in columns[:plain]] + [[canonical(t) for t in c] for c in columns[plain:]]
            keys = ["\x00".join(p) if any(p) else None for p in zip(*parts)]
            rest = [batch.column(i) for i in range(plain + fielded, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *rest], names=["key", "first_row", "rows", "digest"])

    return run


def _survivors(df: DataFrame, plain: list[str], fielded: list[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows with a digest, and each distinct raw row once with its canonical text."""
    names = [f"part{i}" for i in range(len(plain) + len(fielded))]
    raw = df.select(F.col(row_id).cast("bigint").alias("row_idx"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip([*plain, *fielded], names))).where("row_idx is not null")
    raw = raw.withColumn("digest", F.unhex(F.md5(F.concat_ws("\u0000", *names))))
    once = raw.groupBy(*names, "digest").agg(F.min("row_idx").alias("first_row"), F.count("*").alias("rows"))
    keyed = spread(once.select(*names, "first_row", "rows", "digest")).mapInArrow(
        _canonical(len(plain), len(fielded)), "key string, first_row bigint, rows bigint, digest binary"
    )
    return raw.select("row_idx", "digest"), keyed.where("key is not null")


def format_copies(df: DataFrame, *, plain: list[str] = [], fielded: list[str], row_id: str = "row_idx") -> DataFrame:  # noqa: B006
    """``(kept_row_idx, copies)``: each group of rows alike but for formatting, with its least row and its size.

    Rows are alike if the letters and digits of every column are the same in the same order, ignoring case. Where a value
    of a ``fielded`` column consists of named fields only, their order and layout don't count. Null is empty; rows
    without any letter or digit, or without a number, are left out. Byte-identical rows are counted first and only distinct ones
    made canonical; a hot group is summed before it is shuffled, so its size doesn't matter.
    """
    _, keyed = _survivors(df, plain, fielded, row_id)
    return keyed.groupBy("key").agg(F.min("first_row").alias("kept_row_idx"), F.sum("rows").alias("copies")).drop("key")


def format_copy_rows(df: DataFrame, *, plain: list[str] = [], fielded: list[str], row_id: str = "row_idx") -> DataFrame:  # noqa: B006
    """``(kept_row_idx, copy_row_idx)``: one row for each row of a group of ``format_copies`` but the kept one.

    The groups come from the same two collapses; a group without further copies writes none. A group of many variants, or a row of many copies, is met
    where it lies.
    """
    raw, keyed = _survivors(df, plain, fielded, row_id)
    group = keyed.groupBy("key").agg(F.min("first_row").alias("kept_row_idx"), F.sum("rows").alias("copies"), F.count("*").alias("variants")).where("copies > 1")
    short = F.unhex(F.md5("key")).alias("key")  # the groups are of whole texts; only their way back to the rows is by digest
    total = df.count()
    groups = cut(group.select(short, "kept_row_idx", "variants"))
    kept = cut(join_hot(keyed.select(short, "digest", "rows"), groups, ["key"], size="variants", total=total).select("digest", "kept_row_idx", "rows"))
    joined = join_hot(raw, kept, ["digest"], size="rows", total=total)
    return joined.where("row_idx <> kept_row_idx").select("kept_row_idx", F.col("row_idx").alias("copy_row_idx"))
