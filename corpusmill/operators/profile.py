"""Profiles of raw data: lengths, duplicates, sources, noise, near duplicates by SimHash, gates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from .ordering import global_ordinal

NOISE = r"(?i)https?://|<[^>]+>"


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """Rows, empty ones, ones below 100 characters, exact median and 95th percentile of the normalised length."""
    n = F.length(T.normalized(F.col(column)))
    return df.select(n.alias("n")).agg(
        F.lit(column).alias("field"), F.count("*").alias("rows"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("empty_rows"),
        F.sum(F.when(F.col("n") < 100, 1).otherwise(0)).alias("short_rows"), F.percentile("n", F.lit(0.5)).alias("median_length"), F.percentile("n", F.lit(0.95)).alias("p95_length"),
    ).select("field", "rows", "empty_rows", "short_rows", "median_length", "p95_length")


def duplicate_rate(df: DataFrame, column: str) -> DataFrame:
    """How many rows share their normalised lower-case value with another, and their share."""
    counts = df.groupBy(T.normalized_lower(F.col(column)).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.lit(column).alias("field"), F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_rows")
    ).select("field", "rows", "repeated_rows", (F.col("repeated_rows") / F.col("rows")).alias("repeated_share"))


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(T.source_bucket(F.col("source")).alias("source")).agg(F.count("*").alias("rows"))


def length_histogram(df: DataFrame, column: str, width: int = 100) -> DataFrame:
    n = F.length(T.normalized(F.col(column)))
    return df.groupBy(F.floor(n / width).alias("bin")).agg(F.count("*").alias("rows"), F.min(n).alias("least"), F.max(n).alias("most"))


def near_rate(df: DataFrame, column: str, *, row_id: str = "row_idx", band: int = 40, distance: int = 3) -> DataFrame:
    """One row: the pairs of rows at most ``band`` places apart in the order of ``row_id``, those of them whose SimHashes differ in at most
    ``distance`` bits, and their share (0 without a pair)."""
    placed = global_ordinal(df.select(F.col(row_id).alias("id"), F.col(column).alias("text")), "id", "row_idx")
    hashes = cut(simhash(placed, "text"))
    n = F.col("n")
    checked = F.when(n > band, n * band - F.lit(band * (band + 1) // 2)).otherwise((n * (n - 1) / 2).cast("bigint"))
    total = hashes.agg(F.count("*").alias("n")).select(checked.alias("pairs_checked"))
    near = band_pairs(hashes, band=band, distance=distance).agg(F.count("*").alias("near_pairs"))
    share = F.when(F.col("pairs_checked") > 0, F.col("near_pairs") / F.col("pairs_checked")).otherwise(0.0)
    return total.join(near, how="cross").select("pairs_checked", "near_pairs", share.alias("near_share"))


def gates(df: DataFrame, column: str, near: DataFrame | None = None) -> DataFrame:
    """Shares of noise, of texts that are mostly not ASCII and of near duplicates against their bounds, and whether all pass. ``near`` is a row of
    ``near_rate``; it is computed if not given."""
    t = T.normalized(F.col(column))
    one = df.select(t.alias("t"), T.source_bucket(F.col("source")).alias("s")).agg(
        F.count("*").alias("rows"), F.sum(F.col("t").rlike(NOISE).cast("int")).alias("noise_rows"),
        F.sum((T.non_ascii_ratio(F.col("t")) > 0.3).cast("int")).alias("non_ascii_rows"), F.sum((F.col("s") == T.MISSING_SOURCE).cast("int")).alias("missing_source_rows"),
    )
    noise, other = F.col("noise_rows") < 0.05 * F.col("rows"), F.col("non_ascii_rows") < 0.2 * F.col("rows")
    alike = F.col("near_share") < 0.02
    passed = noise & other & alike & (F.col("missing_source_rows") < F.col("rows"))
    one = one.join((near if near is not None else near_rate(df, column)).select("near_share"), how="cross")
    return one.withColumn("noise_ok", noise).withColumn("non_ascii_ok", other).withColumn("near_dup_ok", alike).withColumn("near_share", F.round("near_share", 9)).withColumn("status", F.when(passed, "PASS").otherwise("PASS_WITH_CLEANING_REQUIRED"))


def _sign_rows(grams: np.ndarray, memo: dict[int, int], rows: list[np.ndarray]) -> np.ndarray:
    """The places in ``rows`` of the signs of trigrams, given as numbers; new ones are added."""
    out = np.empty(len(grams), np.int64)
    for i, g in enumerate(grams.tolist()):
        at = memo.get(g)
        if at is None:
            text = "".join(chr(x - 1) for x in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if x)
            low = np.frombuffer(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[8:], np.uint8)
            at = memo[g] = len(rows)
            rows.append(np.unpackbits(low).astype(np.int8) * 2 - 1)
        out[i] = at
    return out


def _simhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[int, int] = {}
    rows: list[np.ndarray] = []
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            if len(rows) > 500_000:
                memo.clear()
                rows.clear()
            codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1 for t in batch.column(1).to_pylist()]
            # a shorter text is its own only gram
            grams = [(c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else np.array([int("".join(f"{x:021b}" for x in c) or "0", 2)]) for c in codes]
            distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
            signs = _sign_rows(distinct, memo, rows)
            table = np.stack([rows[i] for i in signs])
            sizes = np.array([len(g) for g in grams])
            ends = np.cumsum(sizes)
            votes = np.stack([table[at[e - n : e]].sum(axis=0, dtype=np.int64) for n, e in zip(sizes, ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.packbits(votes > 0, axis=1).view(">i8").ravel().astype(np.int64))], names=["row_idx", "simhash"])


def simhash(df: DataFrame, column: str, row_id: str = "row_idx") -> DataFrame:
    """``(row_idx, simhash)``: 64 votes over the character trigrams, each by the low half of its MD5 digest."""
    rows = df.select(F.col(row_id).cast("bigint").alias("row_idx"), T.normalized_lower(F.col(column)).alias("text"))
    return rows.mapInArrow(_simhash, "row_idx bigint, simhash bigint")


def band_pairs(hashes: DataFrame, *, band: int = 40, distance: int = 3) -> DataFrame:
    """Pairs of rows at most ``band`` row numbers apart whose SimHashes differ in at most ``distance`` bits.

    Rows meet in blocks of ``band`` numbers, each with its own and the next.
    """
    left = hashes.select(F.col("row_idx").alias("row_a"), F.col("simhash").alias("hash_a"), F.floor(F.col("row_idx") / band).alias("block"))
    right = hashes.select(F.col("row_idx").alias("row_b"), F.col("simhash").alias("hash_b"), F.floor(F.col("row_idx") / band).alias("own"))
    right = right.withColumn("block", F.explode(F.array(F.col("own"), F.col("own") - 1))).drop("own")
    differ = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    near = (F.col("row_b") > F.col("row_a")) & (F.col("row_b") <= F.col("row_a") + band)
    return left.join(right, "block").where(near & (differ <= distance)).select("row_a", "row_b", differ.alias("distance"))
