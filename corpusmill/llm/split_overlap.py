"""Records of held-out splits that recur, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .bitmap import Bits, bitmap
from .lineage import cut
from .links import join_hot
from .words import WordHashes, counted, digests, hashed, runs

CHUNK = 200
#: Levels of how common a run is among the held-out records: the first that lies above its number of records.
LEVELS = (2, 4, 8, 32, 128, 1024)
#: Pairs at most whose ids are broadcast.
FEW = 200_000


def _held_runs(width: int):
    """Batches of records to (run, n): the distinct runs of each, counted within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            found = [counted(*runs(*hashed(b.column(0).to_pylist(), memo), width))[1] for b in (whole.slice(i, CHUNK) for i in range(0, whole.num_rows, CHUNK))]
            if found:
                own, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["run", "n"])

    return run


def _scanned(width: int, least: float, known: Bits):
    """Batches of (row_idx, train, record) to digests, number of runs, and those of them that held-out records may have, rare ones first, with how
    many of these are to be looked up; without the training records that have too few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for batch in (whole.slice(i, CHUNK) for i in range(0, whole.num_rows, CHUNK)):
                h, n = hashed(batch.column(2).to_pylist(), memo)
                doc, h, _ = counted(*runs(h, n, width))
                size = np.bincount(doc, minlength=len(n))
                d1, d2 = digests(doc, h, len(n))
                level = known.levels(h >> np.uint64(8))
                hits = np.bincount(doc[level > 0], minlength=len(n))
                need = np.ceil(least * size - 1e-9).astype(np.int64)
                kept = np.flatnonzero((size > 0) & (hits >= need))
                here = (level > 0) & ((size > 0) & (hits >= need))[doc]
                doc, h, level = doc[here], h[here], level[here]
                order = np.lexsort((h, level, doc))
                ends = np.r_[0, np.cumsum(hits[kept])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[order].view(np.int64)))
                rows = pa.array(kept)
                looked = (hits - need + 1)[kept]  # of the first size - need + 1 runs those that no held-out record has come first
                cols = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(d1[kept]), pa.array(d2[kept]), pa.array(size[kept]), pa.array(looked), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["row_idx", "train", "d1", "d2", "n", "looked", "elements"])

    return run


def _probing(held: Bits, trained: Bits):
    """Batches of (row_idx, n, looked, elements) to (held, run, id, n, left) for the runs to be looked up of the rows that stand for a class with a held-out
    row, and of those for one with a training row; ``left`` is the number of runs from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, looked = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            starts, flat = lists.offsets.to_numpy()[:-1].astype(np.int64), lists.values.to_numpy()
            most = np.diff(lists.offsets.to_numpy())
            for side, bits in ((True, held), (False, trained)):
                own = np.flatnonzero(bits.passes(ids))
                row = np.repeat(own, looked[own])
                place = np.arange(len(row)) - np.repeat(np.cumsum(looked[own]) - looked[own], looked[own])
                columns = [np.full(len(row), side), flat[starts[row] + place], ids[row], n[row].astype(np.int32), (most[row] - place).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["held", "run", "id", "n", "left"])

    return run


def split_overlaps(
    df: DataFrame, record: Column, train: Column, *, row_id: str = "row_idx", width: int = 5, least: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Held-out records whose likeness to a training record is ``least`` or more.

    Likeness is the share of common ones among the distinct runs of ``width`` words of both. Returns
    ``links(held, trained, shared, likeness, contained)`` between classes of records of equal sets of runs, named after
    their least row (``contained``: the share of the held-out record's runs found in the training record), and
    ``members(row_idx, train, class_id, size)``. A record without a run is like none; null records are empty; a row
    whose ``train`` is null is held out, one without a number is left out.

    The held-out records' runs are counted, and a bitmap sized by their number tells of any run whether they have it and how common it is
    among them. One scan of all records keeps, of each, those runs, rare ones first; a training record in which fewer than the share
    ``least`` are such runs is like none and goes no further. Two sets of that likeness share one of the first n - ceil(least n) + 1 of both in any common
    order, so only these are met in the join and no pair is missed; nor is one by leaving out what lies too far back in
    both for enough to be shared. Pairs are then checked exactly, and copies of one record are a single class throughout.
    """
    source = df.select(F.col(row_id).cast("bigint").alias("row_idx"), F.coalesce(train, F.lit(False)).alias("train"), record.alias("record"))
    source = spread(source.where("row_idx is not null"))
    counts = cut(source.where("not train").select("record").mapInArrow(_held_runs(width), "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")))
    level = sum(((F.col("n") >= x).cast("int") for x in LEVELS), F.lit(1))
    known = bitmap(counts.select(F.expr("shiftrightunsigned(run, 8)").alias("key"), level.alias("level")), counts.count(), planes=3)
    schema = "row_idx bigint, train boolean, d1 bigint, d2 bigint, n bigint, looked bigint, elements array<bigint>"
    rows = cut(source.mapInArrow(_scanned(width, least, known), schema))
    classes = cut(
        rows.groupBy("d1", "d2").agg(
            F.min("row_idx").alias("class_id"), F.count("*").alias("size"), F.max("train").alias("trained"), F.min("train").alias("all_trained"), F.first("n").alias("n")
        )
    )
    number = classes.count()
    of_held, of_train = (bitmap(classes.where(x).select(F.col("class_id").alias("key")), number) for x in ("not all_trained", "trained"))
    probe = rows.select("row_idx", "n", "looked", "elements").mapInArrow(_probing(of_held, of_train), "held boolean, run bigint, id bigint, n int, left int")
    held = probe.where("held").select("run", F.col("id").alias("a"), F.col("n").alias("m"), F.col("left").alias("left_a"))
    trained = probe.where("not held").select("run", F.col("id").alias("b"), "n", F.col("left").alias("left_b"))
    near = (F.col("a") != F.col("b")) & (F.col("n") >= least * F.col("m") - 1e-9) & (F.col("m") >= least * F.col("n") - 1e-9)
    enough = F.least("left_a", "left_b") >= least / (1 + least) * (F.col("m") + F.col("n")) - 1e-9
    pairs = held.join(trained, "run").where(near & enough).select("a", "b").distinct()
    # a bitmap may let a row pass that stands for no class of its side
    pairs = pairs.join(classes.where("not all_trained").select(F.col("class_id").alias("a")), "a", "left_semi").join(classes.where("trained").select(F.col("class_id").alias("b")), "b", "left_semi")
    pairs = cut(pairs)
    touched = pairs.select(F.col("a").alias("row_idx")).union(pairs.select("b")).distinct()
    sets = rows.select("row_idx", "n", "elements").join(F.broadcast(touched) if pairs.count() <= FEW else touched, "row_idx", "left_semi")
    left, right = (sets.select(F.col("row_idx").alias(x), F.col("elements").alias(f"own_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("own_a", "own_b")))
    both = both.withColumn("likeness", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).where(F.col("likeness") >= least - 1e-12)
    unlike = both.select(F.col("a").alias("held"), F.col("b").alias("trained"), F.col("shared").cast("bigint").alias("shared"), "likeness", (F.col("shared") / F.col("n_a")).alias("contained"))
    equal = classes.where("trained and not all_trained").select(
        F.col("class_id").alias("held"), F.col("class_id").alias("trained"), F.col("n").alias("shared"), F.lit(1.0).alias("likeness"), F.lit(1.0).alias("contained")
    )
    links = cut(unlike.unionByName(equal))
    named = classes.select("d1", "d2", "class_id", "size")
    members = join_hot(rows.select("row_idx", "train", "d1", "d2"), named, ["d1", "d2"], size="size", total=rows.count())
    return links, members.select("row_idx", "train", "class_id", "size")


def split_overlap_pairs(df: DataFrame, record: Column, train: Column, *, block: int = 4096, **how) -> DataFrame:
    """``(row_idx_a, row_idx_b)``, smaller first: all pairs of a held-out and a training row of linked classes.

    The copies of a class are met in cells of about ``block`` on either side, so that any two cells are a task's work of their own.
    """
    links, members = split_overlaps(df, record, train, **how)
    touched = links.select(F.col("held").alias("class_id")).union(links.select("trained")).distinct()
    members = cut(members.join(touched, "class_id", "left_semi"))
    cells = F.ceil(F.col("size") / block).cast("int")
    placed = members.withColumn("cell", F.pmod(F.xxhash64("row_idx"), cells).cast("int"))
    held = placed.where("not train").select(F.col("class_id").alias("held"), F.col("cell").alias("cell_x"), F.col("row_idx").alias("x"))
    trained = placed.where("train").select(F.col("class_id").alias("trained"), F.col("cell").alias("cell_y"), F.col("row_idx").alias("y"))
    size = members.groupBy("class_id").agg(F.max(cells).alias("cells"))
    for side, cell in (("held", "cell_x"), ("trained", "cell_y")):
        links = links.join(size.withColumnRenamed("class_id", side), side).withColumn(cell, F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    both = links.join(held, ["held", "cell_x"]).join(trained, ["trained", "cell_y"])
    return both.select(F.least("x", "y").alias("row_idx_a"), F.greatest("x", "y").alias("row_idx_b"))


def overlap_report(df: DataFrame, record: Column, train: Column, *, split: str = "split", source: str = "source", **how) -> DataFrame:
    """Rows, and those of them that overlap with the training split, for each held-out split and source."""
    links, members = split_overlaps(df, record, train, **how)
    best = links.groupBy(F.col("held").alias("class_id")).agg(F.max("likeness").alias("likeness"))
    hit = members.where("not train").join(best, "class_id").select("row_idx", "likeness")
    held = df.where(~F.coalesce(train, F.lit(False))).select("row_idx", F.col(split).alias("split"), F.lower(F.trim(F.coalesce(source, F.lit("")))).alias("source"))
    return held.join(hit, "row_idx", "left").groupBy("split", "source").agg(
        F.count("*").alias("held_rows"), F.count("likeness").alias("overlapping"), F.sum(F.when(F.col("likeness") == 1.0, 1).otherwise(0)).alias("exact")
    )
