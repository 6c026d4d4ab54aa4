"""Texts cut off by field limits or in transfer, found by length hazards and by what the last words are."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .lineage import cut
from ..operators.ordering import global_ordinal
from ..sources.tables import spread
from .endings import open_endings

#: Lengths to either side whose hazard a length's own is held against.
NEAR = 40
#: Odds of a cut before an ending is looked at: in general, at an ellipsis, at a torn mark.
PRIOR, OMITTED_PRIOR, TORN_PRIOR = 0.6, 3.0, 60.0


def _tail(seen: int, expected: float) -> float:
    """P(Poisson(expected) >= seen)."""
    if seen <= 0:
        return 1.0
    term = math.exp(seen * math.log(expected) - expected - math.lgamma(seen + 1))
    total, k = 0.0, seen
    while term > total * 1e-15 and k < seen + 10_000:
        total += term
        k += 1
        term *= expected / k
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def poisson_tail(seen: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([_tail(int(s), max(float(e), 1e-9)) for s, e in zip(seen, expected)])


def length_hazards(texts: DataFrame, *, false_share: float = 0.01) -> DataFrame:
    """``(source, length, texts, at_risk, expected, p, significant)`` of each source and length.

    The hazard of a length is the share of the texts that long or longer that end there. It is tested against the
    hazard of the ``NEAR`` lengths to either side, and lengths are significant while the expected share of false ones
    among them (Benjamini and Hochberg) is at most ``false_share``. Equal texts of a source count once.
    """
    counts = texts.groupBy("source", "length").agg(F.count_distinct(F.xxhash64("text")).alias("texts"))
    by_length = Window.partitionBy("source").orderBy(F.col("length").desc())
    around = Window.partitionBy("source").orderBy("length").rangeBetween(-NEAR, NEAR)
    risk = counts.withColumn("at_risk", F.sum("texts").over(by_length))
    # Lengths that no text has are at risk as well: the mean risk of those present stands for them.
    neighbours = F.sum("texts").over(around) - F.col("texts")
    exposure = F.avg("at_risk").over(around) * (2 * NEAR)
    expected = F.col("at_risk") * (neighbours + 0.5) / exposure
    tested = cut(risk.withColumn("expected", expected).withColumn("p", poisson_tail(F.col("texts"), F.col("expected"))))
    number = tested.count()
    low = tested.where(F.col("p") <= false_share)  # no other can be significant
    ranked = global_ordinal(low.select("p"), "p", "rank")  # in parts by range; of equal values the last one counts
    bound = ranked.where(F.col("p") <= (F.col("rank") + 1) * false_share / max(1, number)).agg(F.max("p").alias("bound"))
    return tested.join(F.broadcast(bound), how="cross").withColumn("significant", F.coalesce(F.col("p") <= F.col("bound"), F.lit(False)) & (F.col("texts") >= 3)).drop("bound")


def truncated_texts(df: DataFrame, *, text_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, length, at_limit, odds)`` of the texts whose end is missing.

    A text that ends neither in a mark nor in an item, a row, code, a signature or a note is cut if the odds say so: how
    much likelier its last words are at a cut than at a sentence's end, times what its length says, where that is
    a significant one of its source, and what stands behind the cut. Sources are compared without case and outer white
    space, null as empty. Null and blank texts are not cut; texts without an id are left out.
    """
    base = spread(df.select(F.col(text_id).cast("bigint").alias("id"), F.lower(F.trim(F.coalesce(F.col(source), F.lit("")))).alias("source"), F.col(text).alias("text")))
    sized = base.where("text is not null and id is not null").withColumn("length", F.length("text"))
    limits = length_hazards(sized).where("significant").select("source", "length", (F.col("texts") / F.col("expected")).alias("excess"))
    found = open_endings(sized)
    cases = sized.select("id", "source", "length").join(found, "id").join(limits, ["source", "length"], "left")
    prior = F.when(F.col("mark") == "torn", TORN_PRIOR).when(F.col("mark") == "omitted", OMITTED_PRIOR).otherwise(PRIOR) * F.coalesce(F.greatest(F.col("excess"), F.lit(1.0)), F.lit(1.0))
    judged = cases.withColumn("odds", F.col("odds") * prior)
    return judged.where("odds > 1").select(F.col("id").alias(text_id), "source", "length", F.col("excess").isNotNull().alias("at_limit"), "odds")


def truncation_report(df: DataFrame, **how) -> DataFrame:
    """How many texts each source has, how many are cut, and their share."""
    name = how.get("source", "source")
    total = df.groupBy(F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))).alias("source")).agg(F.count("*").alias("texts"))
    cut_off = truncated_texts(df, **how).groupBy("source").agg(F.count("*").alias("truncated"), F.sum(F.col("at_limit").cast("int")).alias("at_limits"))
    zero = {"truncated": 0, "at_limits": 0}
    return total.join(cut_off, "source", "left").na.fill(zero).withColumn("truncated_share", F.col("truncated") / F.col("texts"))
