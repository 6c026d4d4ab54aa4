"""Raw sources to records: topic filter, limits, union, pairing of conversation turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import global_ordinal


def rag_items(df: DataFrame) -> DataFrame:
    """Records with normalised title and text that are not empty and on topic; tags are ``["ml_assistant"]``."""
    rows = df.select("row_idx", "id", "source", T.normalized(F.col("title")).alias("title"), T.normalized(F.col("text")).alias("text"))
    whole = F.concat(F.col("title"), F.lit(" "), F.col("text"))
    return rows.where((F.col("text") != "") & T.on_topic(whole)).withColumn("tags", F.array(F.lit("ml_assistant")))


def sft_items(df: DataFrame) -> DataFrame:
    """Pairs with normalised texts, neither empty, on topic."""
    rows = df.select("row_idx", "id", "source", T.normalized(F.col("instruction")).alias("instruction"), T.normalized(F.col("response")).alias("response"))
    whole = F.concat(F.col("instruction"), F.lit(" "), F.col("response"))
    return rows.where((F.col("instruction") != "") & (F.col("response") != "") & T.on_topic(whole))


def with_context(instruction, context):
    """An instruction with its context in a line of its own, if there is one."""
    return F.when(T.normalized(context) != "", F.concat(instruction, F.lit("\nContext: "), context)).otherwise(instruction)


def conversation_items(messages: DataFrame, *, source: str = "openassistant", most: int | None = None, pairing=None) -> tuple[DataFrame, DataFrame]:
    """Records and pairs of a table of messages ``(row_idx, message_id, conv_id, role, text)``: a record of every message that is not blank, whatever its
    role, and the pairs that ``pairing`` (``adjacent_pairs`` by default) finds; both normalised and on topic.

    ``most`` ends the table at that many messages that are neither blank nor an assistant's.
    """
    rows = messages.select("row_idx", "message_id", "conv_id", "role", "text")
    if most is not None:
        asks = rows.where((F.lower(F.trim(F.coalesce("role", F.lit("")))) != "assistant") & (T.normalized(F.col("text")) != ""))
        last = global_ordinal(asks.select("row_idx"), "row_idx", "k").where(F.col("k") == most - 1).select(F.col("row_idx").alias("last"))
        rows = rows.join(F.broadcast(last), how="left").where(F.col("last").isNull() | (F.col("row_idx") <= F.col("last"))).drop("last")
    name = F.coalesce("message_id", F.concat(F.lit("oasst-"), F.col("row_idx").cast("string")))
    own = rows.select("row_idx", name.alias("id"), F.lit(source).alias("source"), F.lit("").alias("title"), "text")
    pairs = (pairing or adjacent_pairs)(rows).join(own.select("row_idx", "id", "source"), "row_idx")
    return rag_items(own), sft_items(pairs)


def source_limit(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of a source by ``row_idx``; the first one at least, as the limit is looked at after a row."""
    return global_ordinal(df, "row_idx", "_place").where(F.col("_place") < max(most, 1)).drop("_place")


def stacked(parts: list[DataFrame]) -> DataFrame:
    """All rows, source after source, numbered by (source, row)."""
    tagged = [p.withColumn("source_ord", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)


def adjacent_pairs(messages: DataFrame, *, block: int = 100_000) -> DataFrame:
    """``(row_idx, conv_id, instruction, response)``: a message that is not an assistant's and the assistant's next to it.

    The order is row_idx within a conversation. A conversation is looked at in blocks of row numbers, so that a hot
    one is spread; the first message of each block stands in for the next of the last one before. Null roles are no assistant's; blank
    texts make no pair.
    """
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    rows = messages.select("conv_id", "row_idx", role.alias("role"), T.normalized(F.col("text")).alias("text"), F.floor(F.col("row_idx") / block).alias("block"))
    inner = Window.partitionBy("conv_id", "block").orderBy("row_idx")
    rows = rows.withColumn("next", F.lead(F.struct("role", "text")).over(inner))
    heads = rows.groupBy("conv_id", "block").agg(F.min_by(F.struct("role", "text"), "row_idx").alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy("conv_id").orderBy("block"))).drop("head")
    open_ = rows.where("next is null").drop("next").join(heads, ["conv_id", "block"]).withColumnRenamed("after", "next")
    whole = rows.where("next is not null").unionByName(open_)
    met = (F.col("role") != "assistant") & (F.col("text") != "") & (F.col("next.role") == "assistant") & (F.col("next.text") != "")
    return whole.where(met).select("row_idx", "conv_id", F.col("text").alias("instruction"), F.col("next.text").alias("response"))


def ordinal_pairs(messages: DataFrame) -> DataFrame:
    """Pairs as a counter that only counts what is not an assistant's finds them: the k-th such message, from 0, with row k + 1 of
    the table if that is an assistant's. Kept for comparison; it misaligns pairs once an assistant's row was passed."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    rows = messages.select("row_idx", role.alias("role"), T.normalized(F.col("text")).alias("text"))
    asks = global_ordinal(rows.where((F.col("role") != "assistant") & (F.col("text") != "")), "row_idx", "k")
    answers = global_ordinal(rows, "row_idx", "n").where((F.col("role") == "assistant") & (F.col("text") != ""))
    answers = answers.select((F.col("n") - 1).alias("k"), F.col("text").alias("response"))
    return asks.join(answers, "k").select("row_idx", F.col("text").alias("instruction"), "response")
