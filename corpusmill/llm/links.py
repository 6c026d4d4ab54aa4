"""Links between classes of equal records: exact checks, components, pairs of members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Links at most that one task joins to components; beyond, all tasks do so round by round.
FEW = 200_000
#: Members of a group that meet in one task when its pairs are written.
BLOCK = 2048


def _shared(least: float):
    """Batches of (a, b, left, right), lists of hashes in ascending order, to those with a Jaccard likeness of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for i in (2, 3):
                lists = batch.column(i)
                n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                pair = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                keys.append((pair << np.uint64(32)) | lists.flatten().to_numpy().view(np.uint32).astype(np.uint64))
                sizes.append(n)
            one, two = keys
            at = np.searchsorted(two, one)
            hit = two[np.minimum(at, max(0, len(two) - 1))] == one if len(two) else np.zeros(len(one), bool)
            shared = np.bincount((one[hit] >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows)
            likeness = shared / np.maximum(sizes[0] + sizes[1] - shared, 1)
            kept = pa.array(np.flatnonzero(likeness >= least - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(likeness)], names=["a", "b", "shared", "likeness"]).take(kept)

    return run


def likely_enough(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets, ``(class_id, elements)`` with 32-bit elements in ascending order, have a Jaccard likeness of ``least``
    or more, with that and the number of shared elements."""
    left = sets.select(F.col("class_id").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("class_id").alias("b"), F.col("elements").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(_shared(least), "a bigint, b bigint, shared bigint, likeness double")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of the links ``(a, b)``: the least node each can be reached from.

    Each round every node is hung on its least neighbour, trees are flattened by halving of their paths, and only links between different trees are left,
    between their roots, for the next round; trees and links become fewer from round to round, and a few links are joined by one task.
    """
    spark = links.sparkSession
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    # Checkpoints pass on the constraints of what they hold; round after round these would pile up in the driver.
    spark.conf.set(name, "false")
    try:
        return _roots(links)
    finally:
        spark.conf.set(name, before)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) to (node, root), by taking the least root among neighbours until none changes."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for b in own] for own in [list(batches)] for i in (0, 1)]
    a, b = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        near = root.copy()
        np.minimum.at(near, a, root[b])
        np.minimum.at(near, b, root[a])
        np.minimum.at(near, root, near.copy())  # a root learns what its nodes have met
        near = near[near]
        if (near == root).all():
            break
        root = near
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _flat(trees: DataFrame) -> DataFrame:
    """``(node, root)`` of the trees ``(node, root)`` in which a root is no greater than its node, with every node at its tree's top."""
    while True:
        above = trees.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = cut(trees.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved")))
        trees = step.select("node", "root")
        if step.where("moved").isEmpty():
            return trees


def _roots(links: DataFrame) -> DataFrame:
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []  # of each round the nodes and the roots they got
    while True:
        if edges.count() <= FEW:
            levels.append(cut(edges.coalesce(1).mapInArrow(_joined, "node bigint, root bigint")))
            break
        low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        tops = edges.select(F.col("a").alias("node")).distinct().join(low, "node", "left_anti").withColumn("root", F.col("node"))
        roots = _flat(cut(low.unionByName(tops)))
        levels.append(roots)
        a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        met = edges.join(a, "a").join(b, "b").where("a_root <> b_root")
        edges = cut(met.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    out = levels[0]
    for later in levels[1:]:
        up = later.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = out.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut(out) if len(levels) > 1 else out


def pairs_within(members: DataFrame) -> DataFrame:
    """All pairs ``(row_idx_a, row_idx_b)``, smaller first, of the members ``(row_idx, root)`` of each group.

    A group is cut into blocks of about ``BLOCK`` members; any two blocks meet under a key of their own, so that a
    large group's pairs are written by many tasks.
    """
    members = cut(members)
    size = cut(members.groupBy("root").agg(F.count("*").alias("size")).where("size > 1"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (
        join_hot(members, size, ["root"], size="size", total=members.count())
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("row_idx"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", "row_idx", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    )
    one, two = placed.alias("one"), placed.alias("two")
    same = (F.col("one.root") == F.col("two.root")) & (F.col("one.x") == F.col("two.x")) & (F.col("one.y") == F.col("two.y"))
    met = (F.col("one.x") == F.col("one.y")) | (F.col("one.block") != F.col("two.block"))
    return one.join(two, same & met & (F.col("one.row_idx") < F.col("two.row_idx"))).select(
        F.col("one.row_idx").alias("row_idx_a"), F.col("two.row_idx").alias("row_idx_b")
    )


def join_hot(rows: DataFrame, groups: DataFrame, on: list[str], *, size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, of which each has one row, its key and the number ``size`` of its rows.

    Keys that hold more than a thousandth of all ``total`` rows are fewer than a thousand, so they are broadcast and
    their rows stay where they are; only the others are shuffled.
    """
    many = F.col(size) * 1000 > total
    hot = F.broadcast(groups.where(many))
    cold = rows.join(F.broadcast(groups.where(many).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(groups.where(~many), on))
