"""Items into containers of fixed capacity: bounded-space online best fit, measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: How the byte-level vocabulary cuts a text before merging, a fixed value of that tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoding(path: str):
    """A byte-level tokenizer from a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class OpenBins:
    """At most ``most`` open bins of one capacity. A bitset has a bit for each free space that some open bin has."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.made, self.open = capacity, most, 0, 0
        self.bits, self.by_space = 0, {}

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        bin_ = bins.pop()
        if not bins:
            del self.by_space[space]
            self.bits ^= 1 << space
        self.open -= 1
        return bin_

    def put(self, size: int) -> int:
        """The number of the bin that an item of up to the capacity goes to: the one it leaves the least space in."""
        fit = self.bits >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left:
            self.by_space.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_


def _pack(capacities: list[tuple[int, int]], name: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles, TaskContext

        task = TaskContext.get().partitionId()
        tokens = encoding(SparkFiles.get(name))
        bins = [(i, c, OpenBins(c, most)) for i, c in capacities]
        for batch in batches:
            rows = tuple([] for _ in range(6))
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(tokens.encode_ordinary(text)) if text else 0
                for i, capacity, open_bins in bins:
                    for part, start in enumerate(range(0, max(size, 1), capacity)):
                        n = min(capacity, size - start)
                        for column, value in zip(rows, (i, (task << 33) + open_bins.put(n), doc, part, start, n)):
                            column.append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["capacity_id", "container", "doc_id", "part", "start_token", "tokens"])

    return run


def pack(
    items: DataFrame, capacities: DataFrame, *, text: str = "text", item_id: str = "doc_id", tokenizer: str = TOKENIZER, most: int = 1024,
) -> DataFrame:
    """``(capacity_id, container, doc_id, part, start_token, tokens)``: every item's container, for each capacity.

    Bounded-space online best fit within each task: at most ``most`` bins are open, an item goes to the open bin it
    fills best, and if a new one is needed and none may be opened the fullest closes first. An item above the capacity
    is divided into full containers and a rest that is packed like any other; no other is divided. Items are read
    once, in the tables' order, without a shuffle; each task leaves its last open bins as they are, so containers depend on how the table is divided.
    The tokenizer's file is read by the driver, and sent to all executors. Null and empty
    texts have no tokens and still get a container. ``capacities`` holds a row for each size (``capacity_id``,
    ``capacity_tokens``), of which there are at most a thousand; sizes below one token are an error.
    """
    sizes = [(int(i), int(c)) for i, c in capacities.select("capacity_id", "capacity_tokens").dropna().distinct().orderBy("capacity_id").limit(1001).collect()]
    if len(sizes) > 1000 or any(c < 1 for _, c in sizes):
        raise ValueError("capacities must be positive, and at most a thousand")
    source = spread(items.select(F.col(item_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    schema = "capacity_id int, container bigint, doc_id bigint, part int, start_token int, tokens int"
    items.sparkSession.sparkContext.addFile(tokenizer)
    return source.mapInArrow(_pack(sizes, os.path.basename(tokenizer), most), schema)


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens and unused share for each capacity."""
    used = packed.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("tokens"))
    total = used.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    named = capacities.select("capacity_id", "capacity_name", "capacity_tokens")
    unused = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return total.join(F.broadcast(named), "capacity_id").select("capacity_id", "capacity_name", "containers", "tokens", unused.alias("unused_share"))
