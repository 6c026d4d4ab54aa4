"""Validation with ordered reject rules, first-wins deduplication, quality scores and profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from .ordering import global_ordinal

#: Patterns of noise, code and empty courtesy, and answers that say nothing (fixed values).
NOISE = rf"(?i)https?://|<[^>]+>|{T.EDGE}N/A($|[^\p{{L}}\p{{N}}_])|{T.EDGE}lorem ipsum($|[^\p{{L}}\p{{N}}_])"
CODE = (
    rf"(?i)`[^`]+`|```|{T.EDGE}def\s+{T.WORD}+\(|{T.EDGE}class\s+{T.WORD}+($|[^\p{{L}}\p{{N}}_])"
    rf"|{T.EDGE}print\(|{T.EDGE}import\s+{T.WORD}+"
)
COURTESY = rf"(?i){T.EDGE}(thanks?|thank you|glad to help|happy to help|sure thing|let me know)($|[^\p{{L}}\p{{N}}_])"
WEAK = ["yes", "no", "ok", "okay", "sure", "maybe", "n/a", "unknown", "i don't know", "idk"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    rag_chars: int = 80
    instruction_chars: int = 10
    response_chars: int = 40
    non_ascii: float = 0.30
    noise: str = NOISE


def first_rule(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(holds, name)
    return out


def rag_reason(source: Column, title: Column, text: Column, limits: Limits = Limits()) -> Column:
    """Why a retrieval record is rejected, null if it is valid. All arguments are normalised."""
    whole = F.when(title != "", F.concat(title, F.lit("\n\n"), text)).otherwise(text)
    words = T.word_count(text)
    kind = F.lower(source)
    return first_rule(
        ("missing_source", source == ""),
        ("empty_text", text == ""),
        ("too_short_for_rag", F.length(whole) < limits.rag_chars),
        ("weak_title_text_pair", (words < 6) | (title == "") & (words < 12)),
        ("noise", whole.rlike(limits.noise)),
        ("high_non_ascii_ratio", T.non_ascii_ratio(whole) > limits.non_ascii),
        ("arxiv_missing_title", (kind == "arxiv") & (F.length(title) < 8)),
        ("stackoverflow_low_signal_answer", (kind == "stackoverflow") & (words < 12) & text.rlike(CODE)),
    )


def sft_reason(source: Column, instruction: Column, response: Column, limits: Limits = Limits()) -> Column:
    """Why a pair is rejected, null if it is valid. All arguments are normalised."""
    whole = F.concat(instruction, F.lit(" "), response)
    words = T.word_count(response)
    low, kind = F.lower(response), F.lower(source)
    return first_rule(
        ("missing_source", source == ""),
        ("empty_instruction", instruction == ""),
        ("empty_response", response == ""),
        ("instruction_too_short", F.length(instruction) < limits.instruction_chars),
        ("response_too_short", F.length(response) < limits.response_chars),
        ("weak_response", low.isin(WEAK) | (words < 4)),
        ("invalid_instruction_response_pair", (F.lower(instruction) == low) | low.startswith("context:")),
        ("noise", whole.rlike(limits.noise)),
        ("high_non_ascii_ratio", T.non_ascii_ratio(whole) > limits.non_ascii),
        ("openassistant_weak_assistant_reply", (kind == "openassistant") & (words < 6) & response.rlike(COURTESY)),
        ("stackoverflow_low_signal_answer", (kind == "stackoverflow") & (words < 8) & response.rlike(CODE)),
    )


def _share(value: Column, full: float, weight: float) -> Column:
    return F.least(value / F.lit(full), F.lit(1.0)) * F.lit(weight)


def _bonus(holds: Column, value: float) -> Column:
    return F.when(holds, F.lit(value)).otherwise(F.lit(0.0))


def _any_of(c: Column, marks: list[str]) -> Column:
    out = F.contains(c, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(c, F.lit(m))
    return out


def clamped(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)


def rag_score(source: Column, title: Column, text: Column) -> Column:
    """Quality of a valid record, 0 to 1, rounded half up to three digits. All arguments are normalised. The weights are fixed values."""
    kind, titled = F.lower(source), title != ""
    whole = F.when(titled, F.concat(title, F.lit("\n\n"), text)).otherwise(text)
    score = F.lit(0.42) + F.when(titled, _share(F.length(title), 120, 0.14)).otherwise(F.lit(0.0))
    score = score + _share(F.length(text), 900, 0.22) + _share(T.word_count(text), 160, 0.16)
    score = score + _bonus(_any_of(whole, [". ", "? ", "! ", ": "]), 0.06) + _bonus(titled, 0.04)
    score = score + _bonus((kind == "arxiv") & titled & (F.length(text) >= 200), 0.10)
    score = score + _bonus((kind == "stackoverflow") & ~text.rlike(CODE), 0.06)
    return clamped(score + _bonus(kind.isin("openassistant", "dolly") & (F.length(text) >= 140), 0.05))


def sft_score(source: Column, instruction: Column, response: Column) -> Column:
    """Quality of a valid pair, as ``rag_score``; the weights and words are fixed values."""
    kind, words = F.lower(source), T.word_count(response)
    score = F.lit(0.38) + _share(F.length(instruction), 180, 0.16) + _share(F.length(response), 1200, 0.26) + _share(words, 180, 0.16)
    score = score + _bonus(_any_of(F.lower(response), ["example", "because", "steps", "first", "second"]), 0.08)
    score = score + _bonus(_any_of(response, [". ", ": "]), 0.06) + _bonus((kind == "openassistant") & (words >= 30), 0.06)
    score = score + _bonus((kind == "stackoverflow") & ~response.rlike(CODE), 0.05)
    score = score + _bonus((kind == "dolly") & (F.length(instruction) >= 40) & (F.length(response) >= 160), 0.06)
    return clamped(score - _bonus(response.rlike(COURTESY), 0.08))


def bucket(score: Column) -> Column:
    return F.when(score < 0.45, "low").when(score < 0.72, "medium").otherwise("high")


def _judged(rows: DataFrame, reason: Column, key: Column, score: Column) -> DataFrame:
    """``(row_idx, id, source, reason, quality_score, quality_bucket)`` of normalised rows: later ones of equal valid rows are
    duplicates, the rest are scored.

    Texts are normalised and judged in one pass; only short verdicts go on. The first of each key is found by an aggregate, which sums up hot
    keys before its shuffle, and joined back by row. No filter stands on a computed column, so that none is copied below.
    """
    own = rows.withColumn("reason", reason).select(
        "row_idx", "id", "source", "reason", F.xxhash64(key).alias("k1"), F.md5(key).alias("k2"), F.when(F.col("reason").isNull(), score).alias("quality_score")
    )
    own = cut(own)
    first = own.where("reason is null").groupBy("k1", "k2").agg(F.min("row_idx").alias("row_idx")).select("row_idx", F.lit(True).alias("first"))
    out = own.join(first, "row_idx", "left")
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("first").isNull(), F.lit("duplicate"))))
    kept = F.col("reason").isNull()
    return out.select("row_idx", "id", "source", "reason", F.when(kept, F.col("quality_score")).alias("quality_score"), F.when(kept, bucket(F.col("quality_score"))).alias("quality_bucket"))


def _rag_texts(df: DataFrame) -> DataFrame:
    tags = F.coalesce("tags", F.array(F.lit("ml_assistant"))) if "tags" in df.columns else F.array(F.lit("ml_assistant"))
    return df.select("row_idx", "id", *(T.normalized(F.col(c)).alias(c) for c in ("source", "title", "text")), tags.alias("tags"))


def _sft_texts(df: DataFrame) -> DataFrame:
    return df.select("row_idx", "id", *(T.normalized(F.col(c)).alias(c) for c in ("source", "instruction", "response")))


def rag_verdicts(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(row_idx, id, source, reason, quality_score, quality_bucket)`` of every record, as ``clean_rag`` without the texts."""
    s, t, x = F.col("source"), F.col("title"), F.col("text")
    key = F.lower(F.when(t != "", F.concat(t, F.lit(" "), x)).otherwise(x))
    return _judged(_rag_texts(df).drop("tags"), rag_reason(s, t, x, limits), key, rag_score(s, t, x))


def sft_verdicts(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same of every pair, as ``clean_sft``."""
    s, i, r = F.col("source"), F.col("instruction"), F.col("response")
    return _judged(_sft_texts(df), sft_reason(s, i, r, limits), F.concat(F.lower(i), F.lit("|||"), F.lower(r)), sft_score(s, i, r))


def clean_rag(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every record with its ``reason`` (null if kept), score and bucket (null if rejected), and normalised texts.

    Columns: row_idx, id, source, title, text, tags, reason, quality_score, quality_bucket. A missing tag list becomes
    ``["ml_assistant"]``. Of equal valid records (title and text as one, without case) the first by row_idx is kept.
    """
    found = rag_verdicts(df, limits).drop("id", "source")
    return _rag_texts(df).join(found, "row_idx")


def clean_sft(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """As ``clean_rag`` for pairs: row_idx, id, source, instruction, response, reason, quality_score, quality_bucket."""
    found = sft_verdicts(df, limits).drop("id", "source")
    return _sft_texts(df).join(found, "row_idx")


def kept(cleaned: DataFrame, prefix: str) -> DataFrame:
    """The kept rows; a missing id becomes the prefix, a hyphen and the number of rows kept before."""
    rows = global_ordinal(cleaned.where("reason is null").drop("reason"), "row_idx")
    name = F.when(F.coalesce(F.trim("id"), F.lit("")) != "", F.col("id")).otherwise(F.concat(F.lit(prefix + "-"), F.col("ordinal").cast("string")))
    return rows.withColumn("id", name).drop("ordinal")


def source_profile(cleaned: DataFrame) -> DataFrame:
    """Rows before, after and removed, kept rows per bucket, and mean quality of each source (0 if none is kept)."""
    is_kept = F.col("reason").isNull()
    buckets = (F.sum(F.when(F.col("quality_bucket") == b, 1).otherwise(0)).alias(f"{b}_rows") for b in ("high", "medium", "low"))
    return cleaned.groupBy(T.source_bucket(F.col("source")).alias("source")).agg(
        F.count("*").alias("before"), F.sum(F.when(is_kept, 1).otherwise(0)).alias("after"), F.sum(F.when(is_kept, 0).otherwise(1)).alias("removed"),
        *buckets, F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 3).alias("avg_quality"),
    )


def drop_reasons(cleaned: DataFrame) -> DataFrame:
    """Rejected rows per reason, for each source and, with a null source, over all."""
    rows = cleaned.where("reason is not null").select(T.source_bucket(F.col("source")).alias("source"), "reason")
    sets = rows.groupingSets([[F.col("source"), F.col("reason")], [F.col("reason")]], F.col("source"), F.col("reason"))
    return sets.agg(F.count("*").alias("n"))


def summary(cleaned: DataFrame) -> DataFrame:
    """One row: before, after, removed, kept rows per bucket, mean quality."""
    return source_profile(cleaned.withColumn("source", F.lit("all"))).select("before", "after", "removed", "high_rows", "medium_rows", "low_rows", "avg_quality")


def audit_samples(cleaned: DataFrame, dataset: str, texts: list[str], most: int = 10) -> DataFrame:
    """The first ``most`` rows of each status, source and category (reject reason or kept bucket), with a preview."""
    category = F.coalesce("reason", F.concat(F.lit("kept_"), F.col("quality_bucket"), F.lit("_quality")))
    body = F.concat_ws(" ", *texts)
    rows = cleaned.select(
        F.lit(dataset).alias("dataset_type"), F.when(F.col("reason").isNull(), "kept").otherwise("rejected").alias("status"),
        T.source_bucket(F.col("source")).alias("source"), category.alias("category"), "row_idx", "id", "quality_score",
        T.preview(body).alias("preview"), F.length(T.normalized(body)).alias("normalized_length"),
    )
    group = Window.partitionBy("dataset_type", "status", "source", "category").orderBy("row_idx")
    return rows.withColumn("sample_rank", F.row_number().over(group)).where(F.col("sample_rank") <= most)


def export_documents(kept_rows: DataFrame) -> DataFrame:
    """``(doc_file, content)`` of kept records in row order; blank ones are left out, though their number is used up."""
    rows = global_ordinal(kept_rows, "row_idx")
    return rows.where(F.col("text") != "").select(F.format_string("doc_%07d.txt", F.col("ordinal")).alias("doc_file"), T.merged(F.col("title"), F.col("text")).alias("content"))
