"""Stratified train / dev / eval splits with quality policies, in a hash order that needs no seed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from .ordering import hash_rank

#: Share of each quality bucket that a split keeps (fixed defaults).
POLICIES = {
    "train": {"high": 1.0, "medium": 0.8, "low": 0.35},
    "dev": {"high": 1.0, "medium": 0.7, "low": 0.3},
    "eval": {"high": 1.0, "medium": 0.85, "low": 0.5},
}


def parse_policy(text: str) -> dict[str, float]:
    """``high=1.0,medium=0.85`` to rates; buckets left out get 1.0. Rates lie in [0, 1]."""
    out = {"high": 1.0, "medium": 1.0, "low": 1.0}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, sep, rate = part.partition("=")
        if not sep or name.strip() not in out or not 0 <= float(rate) <= 1:
            raise ValueError(f"bad policy entry: {part!r}")
        out[name.strip()] = float(rate)
    return out


def allocation(n: Column, ratios: tuple[float, float, float]) -> list[Column]:
    """How many of ``n`` rows train, dev and eval get: largest remainders, then at least one for eval and dev if it can be."""
    if abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError("ratios must be positive and sum to 1")
    raw = [n * F.lit(float(r)) for r in ratios]
    base = [F.floor(x).cast("int") for x in raw]
    rest = n.cast("int") - base[0] - base[1] - base[2]
    frac = [x - b for x, b in zip(raw, base)]

    def ahead(i: int, j: int) -> Column:
        """Whether share j comes before share i: larger remainder, then larger ratio, then earlier."""
        tie = ratios[j] > ratios[i] or ratios[j] == ratios[i] and j < i
        return ((frac[j] > frac[i]) | ((frac[j] == frac[i]) & F.lit(tie))).cast("int")

    got = [base[i] + (sum(ahead(i, j) for j in range(3) if j != i) < rest).cast("int") for i in range(3)]
    train, dev, held = got
    wants = (n >= 3) & F.lit(ratios[2] > 0) & (held == 0)
    by_train = wants & (train > dev) & (train > 1)
    by_dev = wants & ~by_train & (dev > 0)
    train1 = F.when(by_train, train - 1).when(wants & ~by_dev, F.greatest(train - 1, F.lit(0))).otherwise(train)
    dev1, held1 = F.when(by_dev, dev - 1).otherwise(dev), F.when(wants, held + 1).otherwise(held)
    gives = (n >= 2) & F.lit(ratios[1] > 0) & (dev1 == 0) & (train1 > 1)
    train2, dev2 = F.when(gives, train1 - 1).otherwise(train1), F.when(gives, dev1 + 1).otherwise(dev1)
    return [train2 + (n.cast("int") - train2 - dev2 - held1), dev2, held1]


def assign_splits(df: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, policies: dict = POLICIES) -> DataFrame:
    """``df`` with ``split`` and ``selected``, whether the split's policy keeps the row.

    Strata are source and quality bucket (unknown ones count as medium). Within a stratum rows are in the order of
    md5(seed:id:row_idx); of each split and bucket the first round(n rate), half to even, are kept in an order by
    (digest). Needs row_idx, id, source and quality_bucket.
    """
    if set(policies) != {"train", "dev", "eval"}:
        raise ValueError("policies for train, dev and eval are needed")
    label = F.lower(F.coalesce("quality_bucket", F.lit("")))
    rows = df.withColumn("stratum_source", T.source_bucket(F.col("source"))).withColumn("stratum_bucket", F.when(label.isin("high", "medium", "low"), label).otherwise("medium"))
    rows = cut(rows)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("id", F.lit("")), F.col("row_idx").cast("string")))
    keys = ["stratum_source", "stratum_bucket"]
    ranked = hash_rank(rows, keys, digest, "row_idx", "position")
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    train, dev, held = allocation(F.col("n"), ratios)
    counts = size.withColumn("train_n", train).withColumn("dev_n", dev).withColumn("eval_n", held)
    placed = ranked.join(counts, keys)
    name = F.when(F.col("position") <= F.col("train_n"), "train").when(F.col("position") <= F.col("train_n") + F.col("dev_n"), "dev").otherwise("eval")
    placed = placed.withColumn("split", name).drop("position", "n", "train_n", "dev_n", "eval_n")
    placed = cut(placed)
    again = hash_rank(placed, ["split", "stratum_bucket"], digest, "row_idx", "position")
    number = placed.groupBy("split", "stratum_bucket").agg(F.count("*").alias("n"))
    rate = F.lit(0.0)
    for split, rates in policies.items():
        for b, r in rates.items():
            rate = F.when((F.col("split") == split) & (F.col("stratum_bucket") == b), F.lit(float(r))).otherwise(rate)
    number = number.withColumn("most", F.bround(F.col("n") * rate, 0).cast("bigint")).drop("n")
    return again.join(F.broadcast(number), ["split", "stratum_bucket"]).withColumn("selected", F.col("position") <= F.col("most")).drop("position", "most", "stratum_source", "stratum_bucket")


def split_summary(assigned: DataFrame) -> DataFrame:
    """Rows and selected rows per split, source and bucket."""
    return assigned.groupBy("split", T.source_bucket(F.col("source")).alias("source"), F.coalesce("quality_bucket", F.lit("medium")).alias("quality_bucket")).agg(
        F.count("*").alias("rows"), F.sum(F.col("selected").cast("int")).alias("selected_rows")
    )


def auto_eval(df: DataFrame, *, most: int = 200, instruction_chars: int = 20, response_chars: int = 80, expected: tuple[int, int] = (30, 140), seed: int = 42) -> DataFrame:
    """``(row_idx, query, expected_substring)``: the first ``most`` fit pairs in hash order, each with a snippet of its response."""
    rows = df.select("row_idx", T.normalized(F.col("instruction")).alias("query"), T.normalized(F.col("response")).alias("response"))
    rows = rows.where((F.length("query") >= instruction_chars) & (F.length("response") >= response_chars))
    rows = rows.withColumn("expected_substring", T.snippet(F.col("response"), *expected)).where(F.length("expected_substring") >= expected[0])
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_idx").cast("string")))
    return rows.orderBy(digest, "row_idx").limit(most).select("row_idx", "query", "expected_substring")
