"""Groups of records that differ by small edits: BagMinHash, bands, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from ..sources.tables import spread
from .bags import bands, signatures, sketches
from .bitmap import Bits, bitmap
from .links import FEW, components, join_hot, likely_enough, pairs_within
from .words import GOLD, WordHashes, counted, hashed, mix, runs

CHUNK = 200
#: Of the 128 bits of two sketches, two of each of 64 components, this many agree at least, unless the likeness is below 0.6 (all but 1 in 50,000 times).
AGREED = 80
#: Rows of a bucket that a task holds against the bucket's heads; larger buckets are cut into cells.
CELL = 50_000
#: Keys looked for, and keys tracked, when the most frequent are counted to find such buckets.
HOT, TRACKED = 1_000, 10_000


def _signed(width: int, size: int, rows: int, bags: bool, wanted: Bits):
    """Batches of (row_idx, record) to band keys and sketches of the classes in the bitmap that have a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            whole = whole.filter(pa.array(wanted.passes(whole.column(0).to_numpy())))
            for batch in (whole.slice(i, CHUNK) for i in range(0, whole.num_rows, CHUNK)):
                h, n = hashed(batch.column(1).to_pylist(), memo)
                doc, h, count = counted(*runs(h, n, width))
                kept = np.flatnonzero(np.bincount(doc, minlength=len(n)))
                plain = signatures(doc, h, np.ones(len(h), np.int64), len(n), size)
                # runs that come again make the signature of the bag another one than that of the set
                again = np.unique(doc[count > 1])
                here = np.isin(doc, again)
                weighted = signatures(doc[here], h[here], count[here], len(n), size)[again]
                if bags:
                    plain[again] = weighted
                keys = [*bands(plain, rows)]
                if not bags:
                    for i, own in zip(again, bands(weighted, rows)):
                        keys[i] = np.unique(np.r_[keys[i], own])
                sketch = sketches(plain[kept])
                own = [keys[i] for i in kept]
                ends = np.r_[0, np.cumsum([len(k) for k in own])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names=["id", "keys", "s1", "s2"])

    return run


def _sets(width: int, wanted: Bits, bags: bool):
    """Batches of (class_id, record) to the hashed runs of the classes in the bitmap, each once, or as often as it comes with a hash of its own each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for batch in (whole.slice(i, CHUNK) for i in range(0, whole.num_rows, CHUNK)):
                batch = batch.filter(pa.array(wanted.passes(batch.column(0).to_numpy())))
                if not batch.num_rows:
                    continue
                h, n = hashed(batch.column(1).to_pylist(), memo)
                doc, h, count = counted(*runs(h, n, width))
                if bags:
                    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    doc, h = np.repeat(doc, count), np.repeat(h, count)
                    h = np.where(turn > 0, mix(h + turn.astype(np.uint64) * GOLD), h)
                    h = h[np.lexsort((h, doc))]
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(n)))].astype(np.int32)
                values = pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["class_id", "elements"])

    return run


def _met(most: int):
    """Rows (cell, key, id, s1, s2) sorted by cell to pairs (a, b) of each row with the first ``most`` of its cell before it, where their sketches
    agree enough, and to rows (key, id) of those behind the first ``most``, which have not met each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads, seen = None, np.zeros((0, 3), np.int64), 0
        for batch in batches:
            cell, key, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(cell):
                continue
            rows = np.stack(rest, axis=1)  # id and sketch
            if last is not None and cell[0] == last:  # the cell's first rows came in an earlier batch
                cell, key, rows = np.r_[np.full(len(heads), last), cell], np.r_[np.full(len(heads), key[0]), key], np.concatenate([heads, rows])
                carried, before = len(heads), seen - len(heads)
            else:
                carried, before = 0, 0
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            begin = np.repeat(start, np.diff(np.r_[start, len(cell)]))
            rank = np.arange(len(cell)) - begin
            fresh = np.arange(len(cell)) >= carried
            bits = rows[:, 1:].view(np.uint64)
            lead, own = [], []
            for i in range(min(most, int(rank.max()))):
                here = np.flatnonzero((rank > i) & fresh)
                head = begin[here] + i
                like = 128 - np.bitwise_count(bits[here] ^ bits[head]).sum(axis=1, dtype=np.int64) >= AGREED
                lead.append(rows[head[like], 0])
                own.append(rows[here[like], 0])
            lead, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lead, own))
            late = rank >= most
            late[cell == cell[0]] |= before > 0
            late = np.flatnonzero(late & fresh)
            none = pa.nulls(len(late), pa.int64())
            columns = [pa.concat_arrays([pa.array(np.minimum(lead, own)), none]), pa.concat_arrays([pa.array(np.maximum(lead, own)), none])]
            none = pa.nulls(len(own), pa.int64())
            columns += [pa.concat_arrays([none, pa.array(key[late])]), pa.concat_arrays([none, pa.array(rows[late, 0])])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "id"])
            size = len(cell) - start[-1]
            seen = size + (before if len(start) == 1 else 0)
            last, heads = cell[-1], rows[start[-1] : start[-1] + most]

    return run


def _celled(banded: DataFrame, most: int, cell: int) -> DataFrame:
    """The rows (key, id, s1, s2[, late]) of buckets as (cell, key, id, s1, s2), together and in order by cell.

    A bucket is a cell; one of more than ``cell`` rows, found by a count of the most frequent keys, is cut into several, each with the bucket's first
    ``most`` rows in front.
    """
    order = ["late", "id"] if "late" in banded.columns else ["id"]
    top = banded.agg(F.expr(f"approx_top_k(key, {HOT}, {TRACKED})").alias("top")).first().top or []
    hot = [(x["item"], -(-x["count"] // cell)) for x in top if x["item"] is not None and x["count"] > cell]
    rows = banded.withColumn("cell", F.col("key"))
    if hot:
        keys = F.broadcast(banded.sparkSession.createDataFrame(hot, "key bigint, cells bigint"))
        large = banded.join(keys, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("cells")))
        for by in (["key", "part"], ["key"]):
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
            heads = (large if by != ["key"] else heads).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
        heads = cut(heads)
        rest = large.join(F.broadcast(heads.select("key", "id")), ["key", "id"], "left_anti")
        everywhere = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)))
        marked = everywhere.withColumn("behind", F.lit(False)).unionByName(rest.withColumn("behind", F.lit(True)))
        marked = marked.withColumn("cell", F.xxhash64("key", "part")).drop("cells", "part")
        rows = rows.join(keys, "key", "left_anti").withColumn("behind", F.lit(False)).unionByName(marked)
        order = ["behind", *order]
    return rows.repartition("cell").sortWithinPartitions("cell", *order).select("cell", "key", "id", "s1", "s2")


def _rest(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the rows (key, id) of buckets, those of buckets that hold more than one group, with ``late``: in the largest."""
    known = roots.select(F.col("node").alias("id"), "root")
    placed = rows.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    largest = (  # partial sums by key and root first, so a hot bucket is small by then
        placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("groups"))
        .where("groups > 1")
    )
    return placed.join(largest, "key").select("key", "id", (F.col("root") == F.col("most")).alias("late"))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different groups."""
    for x in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _few(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the classes in the pairs, picked where they lie, if the pairs are few; else all sets."""
    if pairs.count() > FEW:
        return sets
    ids = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct()
    return sets.join(F.broadcast(ids), "class_id", "left_semi")


def near_duplicates(
    df: DataFrame, record: Column, *, row_id: str = "row_idx", width: int = 5, least: float = 0.8, bags: bool = True,
    size: int = 64, rows: int | None = None, heads: int = 8, cell: int = CELL,
) -> DataFrame:
    """Groups of texts that share at least the share ``least`` (0.6 or more) of their runs of ``width`` words.

    Returns ``(row_idx, class_id, root)``, one row per record that has a run: byte-identical records are one class,
    named after its least row; classes linked by that likeness, also by way of others, have the same ``root``. With ``bags`` the likeness is that of
    multisets, the sum of the lesser over that of the greater numbers of each run; without, that of sets of distinct runs.

    Each class gets a BagMinHash signature of ``size`` (64 or more) components of its runs, weighted by how often they
    come, in bands of ``rows`` (3 where ``least`` is below 0.75, else 5): at likeness x one band is shared with probability 1 - (1 - x^rows)^(size/rows). For the
    likeness of sets a record with repeated runs has the bands of its set's signature besides. In each
    bucket all classes are held against its first ``heads``: by a sketch of 128 bits of the signature, then exactly, where they are not in one group yet, on
    the runs, by 32-bit hashes (two runs of a pair of n in all are taken for one with a probability of about n^2 / 2^33). Those that were held against all are done; a bucket whose other classes are all in one group by
    now is done as well, and of any other the classes outside its largest group become heads in the next round, sixteen times as
    many. So no pair in a bucket is left out that could join two groups, though a group's pairs are never all written. Buckets of more than
    ``cell`` rows are cut into cells that share their heads; joins by a head of many pairs are left to the splitting of skewed joins at run time.
    Null texts are empty; a record without a run is in no group, a row without a number is left out. Columns beside the ones read do not matter.
    """
    rows = rows or (3 if least < 0.75 else 5)
    source = df.select(F.col(row_id).cast("bigint").alias("row_idx"), F.unhex(F.md5(record)).alias("digest"), record.alias("record")).where("row_idx is not null")
    classes = cut(source.groupBy("digest").agg(F.min("row_idx").alias("class_id"), F.count("*").alias("size")))
    texts = spread(source.select("row_idx", "record"))
    # what else the bitmap lets pass are copies, which are like their class and in no result
    wanted = bitmap(classes.select(F.col("class_id").alias("key")), classes.count())
    signed = cut(texts.mapInArrow(_signed(width, size, rows, bags, wanted), "id bigint, keys array<bigint>, s1 bigint, s2 bigint"))
    sketch = signed.select("id", "s1", "s2")
    banded = signed.select(F.explode("keys").alias("key"), "id", "s1", "s2")
    number = classes.count()
    links = roots = sets = None
    while True:
        met = cut(_celled(banded, heads, cell).mapInArrow(_met(heads), "a bigint, b bigint, key bigint, id bigint"))
        del banded
        near = met.where("a <> b").select("a", "b").distinct()
        near = cut(near if roots is None else _between(near, roots))
        rest = cut(met.where("key is not null").select("key", "id"))
        del met
        if sets is None:  # later rounds hold deep rows only
            touched = near.select(F.col("a").alias("key")).union(near.select("b")).union(rest.select("id"))
            sets = cut(texts.mapInArrow(_sets(width, bitmap(touched, number), bags), "class_id bigint, elements array<int>"))
        found = cut(likely_enough(near, _few(sets, near), least).select("a", "b"))
        links = found if links is None else links.union(found)
        roots = components(links)
        banded = cut(_rest(rest, roots))
        if banded.isEmpty():
            break
        banded = banded.join(sketch, "id")
        links, heads = roots.select(F.col("root").alias("a"), F.col("node").alias("b")), heads * 16
    own = source.select("row_idx", "digest")
    classes = cut(classes.join(signed.select(F.col("id").alias("class_id")), "class_id", "left_semi"))  # those with a run
    members = join_hot(own, classes.select("digest", "class_id", "size"), ["digest"], size="size", total=df.count())
    return members.join(roots, members["class_id"] == roots["node"], "left").select(
        "row_idx", "class_id", F.coalesce("root", "class_id").alias("root")
    )


def near_duplicate_pairs(df: DataFrame, record: Column, **how) -> DataFrame:
    """``(row_idx_a, row_idx_b)``: all pairs of records in the same group of ``near_duplicates``, smaller first."""
    return pairs_within(near_duplicates(df, record, **how).select("row_idx", "root"))
