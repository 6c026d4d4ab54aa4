"""Passages of test items inside a training corpus: an FM-index per shard, searched for the items' phrases."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .fm_index import FMIndex
from .words import WORD, words

#: Words of a shard; a longer document is indexed in pieces that overlap.
SHARD = 1_500_000
#: Phrases that are searched in one pass over the corpus.
BLOCK = 200_000


class Phrases:
    """Windows of ``width`` words of the test items, as numbers of their own vocabulary."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int):
        self.width, self.number = width, {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, parts in items:
            for part in parts:
                ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(part)]
                for i in range(len(ids) - width + 1):
                    owners[tuple(ids[i : i + width])].add(item)
        self.rows = np.array(list(owners), np.int64).reshape(len(owners), width)
        self.owners = [sorted(x) for x in owners.values()]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return 0


def _search(ids: list, lists: list[np.ndarray], phrases: Phrases) -> tuple[list, list, list]:
    """(document, item, first word) of every occurrence in one shard."""
    width, found = phrases.width, ([], [], [])
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    text = np.zeros(int(size.sum()) + len(lists), np.int64)  # a 0 after each document
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    for b, x in zip(begin, lists):
        text[b : b + len(x)] = x
    # Pieces between unknown words that are shorter than a phrase hold none.
    gaps = np.flatnonzero(text == 0)
    length = np.diff(np.r_[-1, gaps]) - 1
    long = length >= width
    if not long.any():
        return found
    keep = np.zeros(len(text) + 1, np.int64)
    np.add.at(keep, (gaps - length)[long], 1)
    np.add.at(keep, gaps[long] + 1, -1)
    place = np.flatnonzero(np.cumsum(keep[:-1]))
    index = FMIndex(text[place], max(phrases.number.values()))
    low, high = index.find(phrases.rows)
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    rows = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = place[index.locate(rows)]
    doc = np.searchsorted(begin, at, "right") - 1
    for d, w, p in zip(doc, at - begin[doc], np.repeat(hit, count)):
        for item in phrases.owners[p]:
            found[0].append(ids[d])
            found[1].append(item)
            found[2].append(int(w))
    return found


def _scan(phrases: Phrases, shard: int):
    numbers = _Numbers(phrases.number)

    def flush(ids, lists, offsets):
        doc, item, word = _search(range(len(lists)), lists, phrases)
        if not doc:
            return None
        order = np.lexsort((word, item, doc))
        doc, item, word = (np.array(x, np.int64)[order] for x in (doc, item, word))
        word = word + np.array([offsets[d] for d in doc], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array(item), pa.array(word)], names=["doc_id", "item", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, offsets, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                found = WORD.findall(text.lower())
                x = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                for start in range(0, max(1, len(x)), shard):
                    piece = x[start : start + shard + phrases.width - 1]
                    if held + len(piece) > shard and held:
                        if (out := flush(ids, lists, offsets)) is not None:
                            yield out
                        ids, lists, offsets, held = [], [], [], 0
                    ids.append(doc)
                    lists.append(piece)
                    offsets.append(start)
                    held += len(piece)
        if held and (out := flush(ids, lists, offsets)) is not None:
            yield out

    return run


def leaked_phrases(
    corpus: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "eval_index",
    parts: list[str] = ["query", "passage"], width: int = 12, block: int = BLOCK, shard: int = SHARD,  # noqa: B006
) -> DataFrame:
    """``(doc_id, item, word)``: each place, counted in words, where a document holds ``width`` successive words of an item.

    Every task cuts its part of the corpus into shards and builds an FM-index of each over the items' vocabulary;
    other words only separate, as no phrase can hold them. All phrases are searched backwards at once; places come
    from sampled suffixes. The corpus is not shuffled. The items are read in blocks of at most ``block`` phrases (an
    item of more is a block of its own), each of which takes a pass over the corpus, so that what a task is sent is
    bounded. Null texts and parts of fewer words hold nothing; a document given twice is reported under each id.
    """
    source = spread(corpus.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null"))
    blocks, now, size = [], [], 0
    chosen = items.select(F.col(item_id).cast("bigint").alias("item"), *(F.col(p).alias(f"part{i}") for i, p in enumerate(parts)))
    for row in chosen.toLocalIterator():
        n = sum(max(0, len(words(x)) - width + 1) for x in row[1:])
        if now and size + n > block:
            blocks.append(now)
            now, size = [], 0
        if n:
            now.append((row[0], [x for x in row[1:] if x]))
            size += n
    blocks += [now] if now else []
    schema = "doc_id bigint, item bigint, word bigint"
    if not blocks:
        return source.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, (source.mapInArrow(_scan(Phrases(b, width), shard), schema) for b in blocks))


def leaked_items(corpus: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``(doc_id, item)``: which items leaked into which documents."""
    return leaked_phrases(corpus, items, **how).select("doc_id", "item").distinct()


def removal_spans(corpus: DataFrame, items: DataFrame, *, width: int = 12, **how) -> DataFrame:
    """``(doc_id, first_word, last_word, items)``: the merged stretches of words to remove from each document."""
    from pyspark.sql import Window

    places = leaked_phrases(corpus, items, width=width, **how).groupBy("doc_id", "word").agg(F.collect_set("item").alias("items"))
    order = Window.partitionBy("doc_id").orderBy("word")
    start = F.when(F.col("word") > F.coalesce(F.lag("word").over(order) + width, F.lit(-1)), 1).otherwise(0)
    spans = places.withColumn("starts", start).withColumn("span", F.sum("starts").over(order))
    return spans.groupBy("doc_id", "span").agg(
        F.min("word").alias("first_word"), (F.max("word") + width - 1).alias("last_word"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).drop("span")
