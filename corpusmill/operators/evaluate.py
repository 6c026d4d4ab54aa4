"""Validation of evaluation items, retrieval metrics, ablation grids and regression checks."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from .retrieval import picked


def eval_errors(items: DataFrame, *, query_chars: int = 8, expected_chars: int = 8) -> DataFrame:
    """``(eval_index, error, first_seen)``: short queries, short expected texts, queries seen at an earlier item."""
    rows = items.select("eval_index", T.stripped(F.col("query")).alias("q"), T.stripped(F.col("expected_substring")).alias("e"), T.normalized_lower(F.col("query")).alias("norm"))
    first = rows.where("norm <> ''").groupBy("norm").agg(F.min("eval_index").alias("first_seen"))
    rows = rows.join(first, "norm", "left")
    short_q, short_e = F.length("q") < query_chars, F.length("e") < expected_chars
    again = (F.col("norm") != "") & (F.col("first_seen") < F.col("eval_index"))
    errors = F.array_compact(F.array(F.when(short_q, "short_query"), F.when(short_e, "short_expected"), F.when(again, "duplicate_query")))
    out = rows.select("eval_index", F.explode(errors).alias("error"), "first_seen")
    return out.withColumn("first_seen", F.when(F.col("error") == "duplicate_query", F.col("first_seen")))


def eval_summary(items: DataFrame, **limits) -> DataFrame:
    """One row: items, distinct queries, errors; no items are an error."""
    norm = T.normalized_lower(F.col("query"))
    one = items.agg(F.count("*").alias("items"), F.count_distinct(F.when(norm != "", norm)).alias("unique_queries"))
    errors = eval_errors(items, **limits).agg(F.count("*").alias("n"))
    return one.join(errors, how="cross").select("items", "unique_queries", (F.col("n") + (F.col("items") == 0).cast("int")).alias("errors"))


def hit_ranks(ranked: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """``(qid, hit_rank)``: the first rank whose text contains the item's expected text, ignoring case; null if none."""
    expected = items.select(F.col("eval_index").alias("qid"), F.lower("expected_substring").alias("expected"))
    ranked = cut(ranked)
    rows = ranked.join(picked(chunks, ranked).select("chunk_idx", F.lower("text").alias("text")), "chunk_idx").join(expected, "qid")
    hits = rows.where(F.contains("text", "expected")).groupBy("qid").agg(F.min("rank").alias("hit_rank"))
    return expected.select("qid").join(hits, "qid", "left")


def metrics(ranks: DataFrame, k: int) -> DataFrame:
    """Queries, hits, hit rate and mean reciprocal rank at ``k``, to six digits."""
    hit = F.coalesce(F.col("hit_rank") <= k, F.lit(False))
    rows = ranks.agg(F.count("*").alias("queries"), F.sum(hit.cast("int")).alias("hits"), F.avg(hit.cast("double")).alias("rate"), F.avg(F.when(hit, 1 / F.col("hit_rank")).otherwise(0.0)).alias("reciprocal"))
    return rows.select(F.lit(k).alias("top_k"), "queries", "hits", F.round("rate", 6).alias("hit_rate"), F.round("reciprocal", 6).alias("mrr"))


def names_of(text: str, what: str) -> list[str]:
    """The distinct items of a comma-separated list, in order; an empty list is an error."""
    out = list(dict.fromkeys(x for x in (part.strip() for part in text.split(",")) if x))
    if not out:
        raise ValueError(f"{what} must not be empty")
    return out


def numbers_of(text: str, what: str, *, least: int = 1) -> list[int]:
    """The same of whole numbers, none of them below ``least``."""
    try:
        out = list(dict.fromkeys(map(int, names_of(text, what))))
    except ValueError as e:
        raise ValueError(f"{what} must hold whole numbers: {text!r}") from e
    if min(out) < least:
        raise ValueError(f"{what} must be {least} or more: {min(out)}")
    return out


def variants(spark, modes: list[str], sizes: list[int], overlaps: list[int], ks: list[int]) -> DataFrame:
    """``(ordinal, retrieval_mode, chunk_size, chunk_overlap, top_k)``: all combinations whose overlap is below the size, in
    the order mode, size, overlap, k."""
    if not set(modes) <= {"vector", "hybrid"} or not modes:
        raise ValueError("modes must be vector or hybrid")
    grid = product(*(list(dict.fromkeys(x)) for x in (modes, sizes, overlaps, ks)))
    rows = [v for v in grid if v[2] < v[1]]
    if not rows:
        raise ValueError("no variant is left")
    return spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "ordinal int, retrieval_mode string, chunk_size int, chunk_overlap int, top_k int")


def leaderboard(results: DataFrame) -> DataFrame:
    """Results by mrr, then hit rate, then their first order, with places."""
    order = Window.orderBy(F.col("mrr").desc(), F.col("hit_rate").desc(), "ordinal")
    return results.withColumn("place", F.row_number().over(order))


def regression(current: DataFrame, baseline: DataFrame, *, max_drop: float = 0.01) -> DataFrame:
    """``(metric, current, baseline, delta, max_drop, passed)`` for hit rate and mrr, to six digits; a drop of up to
    ``max_drop`` passes. Each argument has one row."""
    both = current.select(F.struct("hit_rate", "mrr").alias("c")).join(baseline.select(F.struct("hit_rate", "mrr").alias("b")), how="cross")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"c.{m}").alias("current"), F.col(f"b.{m}").alias("baseline")) for m in ("hit_rate", "mrr")))
    rows = both.select(F.inline(each)).withColumn("delta", F.round(F.col("current") - F.col("baseline"), 6))
    return rows.withColumn("max_drop", F.lit(max_drop)).withColumn("passed", F.col("delta") >= -F.col("max_drop"))
