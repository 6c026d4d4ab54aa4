"""Documents and chunks: fixed windows, sentences, and paragraph chunks with sections and neighbours."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|$)")
SCHEMA = "doc_id string, pos int, start_char int, end_char int, chunk_text string, section string, source_path string, source_name string, title string, chunk_id string, prev_chunk_id string, next_chunk_id string"


def check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the size must be positive and the overlap at least 0 and below it")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start_char, end_char, chunk_text): windows every ``size - overlap`` characters, as long as one begins inside."""
    check(size, overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start_char"), F.least(s + size, F.length(text)).alias("end_char"), F.substring(text, s + 1, F.lit(size)).alias("chunk_text")))


def fixed_chunks(df: DataFrame, size: int, overlap: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = df.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    return rows.select(key, F.posexplode(fixed_windows(F.col("_text"), size, overlap)).alias("pos", "w")).select(key, "pos", "w.*")


def sentences(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, sentence)``; what stands before a line end without an end mark is no sentence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+(?:[.!?]+|$)"), F.lit(0))
    whole = F.filter(F.transform(found, T.stripped), lambda s: s != "")
    return df.select(key, F.posexplode(whole).alias("pos", "sentence"))


def document_records(df: DataFrame, path: Column, name: Column, text: str = "text") -> DataFrame:
    """doc_id, source_path, source_name, title and section of each document that is not blank, with its text."""
    body = T.stripped(F.col(text))
    rows = df.select(path.alias("source_path"), name.alias("source_name"), body.alias("text")).where(F.col("text") != "")
    return rows.select(T.doc_key(F.col("source_path")).alias("doc_id"), "source_path", "source_name", T.title_of(F.col("text"), F.col("source_name")).alias("title"), T.section_of(F.col("text")).alias("section"), "text")


def _span(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))


def _heading(block: str) -> tuple[bool, str | None]:
    line = block.strip().splitlines()[0].strip() if block.strip() else ""
    if line.startswith("#"):
        return True, line.lstrip("#").strip() or None
    if line.endswith(":") and len(line) <= 100:
        return True, line[:-1].strip() or None
    return False, None


def blocks_of(text: str, section: str | None = None) -> list[tuple[int, int, str, str | None]]:
    """(start, end, text, section) of the paragraphs between blank lines; a heading belongs to the paragraph behind it."""
    ends = [m.span() for m in BLANK.finditer(text)]
    cuts = zip([0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)])
    spans = [(a, b) for a, b in (_span(text, *c) for c in cuts) if a < b]
    out, held = [], None
    for a, b in spans:
        body = text[a:b]
        heads, named = _heading(body)
        if heads:
            section = named
            if held:
                out.append(held)
            held = (a, b, body, section)
        elif held:
            out.append((held[0], b, f"{held[2]}\n\n{body}", held[3]))
            held = None
        else:
            out.append((a, b, body, section))
    return [*out, held] if held else out


def _run_end(total: list[int], i: int, size: int, gap: int) -> int:
    """The end j of the longest run [i, j) of items, at least one, that joined by ``gap`` characters fit into ``size``.
    ``total`` are the running sums of the items' lengths, each with a gap."""
    return max(i + 1, bisect_right(total, total[i] + size + gap) - 1)


def _packed(lengths: list[int], size: int, gap: int) -> list[tuple[int, int]]:
    """Greedy runs of items, one after the other."""
    total, out, i = [0, *accumulate(n + gap for n in lengths)], [], 0
    while i < len(lengths):
        out.append((i, _run_end(total, i, size, gap)))
        i = out[-1][1]
    return out


def _divided(block: tuple, size: int, overlap: int, relative: bool) -> list[tuple]:
    """A block no longer than ``size`` as it is; a longer one by packed sentences, or by fixed windows if one is too long."""
    start, _, body, section = block
    if len(body) <= size:
        return [block]
    parts = [_span(body, *m.span()) for m in SENTENCE.finditer(body) if m.group().strip()]
    if len(parts) > 1 and all(b - a <= size for a, b in parts):
        groups = _packed([b - a for a, b in parts], size, 1)
        return [(start + parts[i][0], start + parts[j - 1][1], " ".join(body[a:b] for a, b in parts[i:j]), section) for i, j in groups]
    base = 0 if relative else start
    return [(base + s, base + min(s + size, len(body)), body[s : s + size], section) for s in range(0, len(body), size - overlap)]


def paragraph_chunks(text: str, size: int, overlap: int, *, section: str | None = None, offsets: str = "document") -> list[tuple]:
    """(start, end, text, section) of chunks of whole blocks up to ``size``, each beginning with the last blocks of the one
    before that make ``overlap`` characters. Windows of a long block count from the document's start, or, with
    ``offsets="reference"``, from the block's."""
    check(size, overlap)
    pieces = [p for b in blocks_of(text, section) for p in _divided(b, size, overlap, offsets == "reference")]
    total, out, i = [0, *accumulate(len(p[2]) + 2 for p in pieces)], [], 0
    while i < len(pieces):
        j = _run_end(total, i, size, 2)
        out.append((pieces[i][0], pieces[j - 1][1], "\n\n".join(p[2] for p in pieces[i:j]), pieces[i][3]))
        if j >= len(pieces):
            break
        back, length = j, 0
        while overlap and back - 1 > i and length < overlap:
            back -= 1
            length += len(pieces[back][2]) + (2 if back + 1 < j else 0)
        i = back
    return out


def _chunked(size: int, overlap: int, offsets: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, section, text, *record in zip(*(batch.column(i).to_pylist() for i in range(6))):
                found = paragraph_chunks(text or "", size, overlap, section=section, offsets=offsets)
                names = [None, *(f"{doc}__{pos:04d}" for pos in range(len(found))), None]
                for pos, (a, b, body, named) in enumerate(found):
                    rows.append((doc, pos, a, b, body, named, *record, names[pos + 1], names[pos], names[pos + 2]))
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 8)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def chunk_records(documents: DataFrame, size: int, overlap: int, *, offsets: str = "document") -> DataFrame:
    """Chunks of document records with ids ``{doc_id}__{0000}``, the ids of both neighbours, and the records' columns. A document's chunks are made and linked in
    one go, in the order of the records; no text is shuffled."""
    check(size, overlap)
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "section", "text", "source_path", "source_name", "title")
    return rows.where("doc_id is not null").mapInArrow(_chunked(size, overlap, offsets), SCHEMA)


def linked(chunks: DataFrame) -> DataFrame:
    """Chunk ids and the ids of the neighbours; a document's chunks are few, so they meet in one task."""
    name = F.format_string("%s__%04d", F.col("doc_id").cast("string"), F.col("pos"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = chunks.withColumn("chunk_id", name)
    return rows.withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))
