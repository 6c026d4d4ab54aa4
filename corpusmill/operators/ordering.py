"""Order and rank without sending a whole table, or a hot group, to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def global_ordinal(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """``df`` with the number of rows before each in the order of a unique column, from 0.

    Rows are sorted by range; only the number of rows of each partition goes through a single task.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def hash_rank(df: DataFrame, keys: list[str], digest: Column, tie: str, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row within its keys, in the order of a hexadecimal digest, then of ``tie``.

    A digest's first three digits cut each group into up to 4096 even parts that are ranked apart.
    """
    rows = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 3))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")
    sizes = sizes.withColumn("_before", before).drop("_size")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_digest", tie))
    ranked = rows.withColumn("_local", local).join(sizes, [*keys, "_part"])
    return ranked.withColumn(name, F.col("_before") + F.col("_local")).drop("_digest", "_part", "_local", "_before")
