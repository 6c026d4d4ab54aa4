"""Leakage between evaluation items and training records."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread

#: Items that are sent to the tasks at once.
BLOCK = 2000


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all, of normalised lower-case texts, as difflib finds them; 0 if one is empty."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _shape(texts: list[str]) -> np.ndarray:
    """Counts of characters in 64 classes: the shared ones bound what can match."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, minlength=64)
    return out


def _bounds(shapes: np.ndarray, lengths: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
    """An upper bound of the ratio of one text with each of some."""
    return 2.0 * np.minimum(shapes, one).sum(axis=1) / np.maximum(lengths + n, 1)


class Texts:
    """Normalised item texts with their shapes."""

    def __init__(self, texts: list[str]):
        self.texts, self.shapes = texts, _shape(texts)
        self.lengths = np.array([len(t) for t in texts], np.int64)

    def near(self, text: str, shape: np.ndarray, least: float) -> list[int]:
        """The items whose ratio with the text, the item first, is ``least`` or more."""
        if not text:
            return []
        maybe = np.flatnonzero(_bounds(self.shapes, self.lengths, shape, len(text)) >= least)
        return [int(i) for i in maybe if ratio(self.texts[i], text) >= least]


def _norm(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def _joined(a: str | None, b: str | None) -> str:
    return f"{(a or '').strip()}\n\n{(b or '').strip()}".strip()


def _words(text: str | None) -> set[str]:
    import regex

    return set(regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower()))


def _blocks(items: DataFrame):
    """The items (number, query, expected) in blocks of at most ``BLOCK``."""
    held = []
    for row in items.select(F.col("eval_index").cast("bigint"), "query", "expected_substring").orderBy("eval_index").toLocalIterator():
        held.append(tuple(row))
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def _automaton(expected: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, e in enumerate(expected):
        if e:
            found.add_word(e, (*found.get(e, ()), i))
    found.make_automaton()
    return found


def _contained(automaton, text: str) -> set[int]:
    if not len(automaton):
        return set()
    return {i for _, own in automaton.iter(text) for i in own}


def _sft(items: list[tuple], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[str, list[int]] = {}
        for i, (_, q, _) in enumerate(items):
            queries.setdefault(_norm(q), []).append(i)
        expected, combos = _automaton([_norm(e) for _, _, e in items]), Texts([_norm(_joined(q, e)) for _, q, e in items])
        for batch in batches:
            rows = []
            pairs = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            combined = [_norm(_joined(a, b)) for _, a, b in pairs]
            shapes = _shape(combined)
            for k, (row, a, b) in enumerate(pairs):
                exact = set(queries.get(_norm(a), ())) if _norm(a) else set()
                inside, near = _contained(expected, _norm(b)), set(combos.near(combined[k], shapes[k], least))
                rows += [(items[i][0], row, i in exact, i in inside, i in near) for i in exact | inside | near]
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["eval_index", "row_idx", "exact_query_match", "expected_in_response", "near_duplicate_pair"])

    return run


def _rag(items: list[tuple], least: float, words: float, title_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [_words(_norm(q)) for _, q, _ in items]
        expected, combos = _automaton([_norm(e) for _, _, e in items]), Texts([_norm(_joined(q, e)) for _, q, e in items])
        norms = [_norm(q) for _, q, _ in items]
        for batch in batches:
            rows = []
            for row, title, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                whole = _norm(_joined(title, text))
                own, inside = _words(whole), set()
                for i in _contained(expected, whole):
                    union = len(sets[i] | own)
                    alike = bool(sets[i]) and bool(own) and len(sets[i] & own) >= words * union
                    if alike or ratio(norms[i], _norm(title)) >= title_least or ratio(norms[i], whole) >= least:
                        inside.add(i)
                near = set(combos.near(whole, _shape([whole])[0], least))
                rows += [(items[i][0], row, i in inside, i in near) for i in inside | near]
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["eval_index", "row_idx", "expected_in_rag_text", "near_duplicate_document"])

    return run


def _first(found: list[DataFrame], reasons: list[str], session, schema: str) -> DataFrame:
    """The first row of each item that matches for any reason, with that row's reasons."""
    rows = found[0] if found else session.createDataFrame([], schema)
    for f in found[1:]:
        rows = rows.unionByName(f)
    best = rows.groupBy("eval_index").agg(F.min_by(F.struct("row_idx", *reasons), "row_idx").alias("m"))
    return best.select("eval_index", "m.*")


def sft_leakage(rows: DataFrame, items: DataFrame, *, least: float = 0.92) -> DataFrame:
    """``(eval_index, row_idx, exact_query_match, expected_in_response, near_duplicate_pair)``: for each item that leaked, the
    first pair that matches and why.

    Items go to the tasks in blocks. All expected texts are looked for in one pass by an automaton; the ratio is computed
    only where counts of characters allow it to be large enough.
    """
    reasons = ["exact_query_match", "expected_in_response", "near_duplicate_pair"]
    schema = "eval_index bigint, row_idx bigint, " + ", ".join(f"{r} boolean" for r in reasons)
    source = spread(rows.select(F.col("row_idx").cast("bigint"), "instruction", "response"))
    return _first([source.mapInArrow(_sft(b, least), schema) for b in _blocks(items)], reasons, rows.sparkSession, schema)


def rag_leakage(rows: DataFrame, items: DataFrame, *, least: float = 0.88, words: float = 0.55, title_least: float = 0.78) -> DataFrame:
    """``(eval_index, row_idx, expected_in_rag_text, near_duplicate_document)``, as ``sft_leakage``, over records with title and text.

    An expected text in a record counts only if the query is like the record: by shared words, by its title or as a whole.
    """
    reasons = ["expected_in_rag_text", "near_duplicate_document"]
    schema = "eval_index bigint, row_idx bigint, " + ", ".join(f"{r} boolean" for r in reasons)
    source = spread(rows.select(F.col("row_idx").cast("bigint"), "title", "text"))
    return _first([source.mapInArrow(_rag(b, least, words, title_least), schema) for b in _blocks(items)], reasons, rows.sparkSession, schema)


def eval_leakage(left: DataFrame, right: DataFrame, *, least: float = 0.94) -> DataFrame:
    """``(eval_index, row_idx, duplicate_query, near_duplicate_eval_item)``: for each left item the first right one that is like it."""
    reasons = ["duplicate_query", "near_duplicate_eval_item"]
    renamed = right.select(F.col("eval_index").alias("row_idx"), F.col("query").alias("instruction"), F.col("expected_substring").alias("response"))
    schema = "eval_index bigint, row_idx bigint, exact_query_match boolean, expected_in_response boolean, near_duplicate_pair boolean"
    source = spread(renamed.select(F.col("row_idx").cast("bigint"), "instruction", "response"))
    found = [source.mapInArrow(_sft(b, least), schema) for b in _blocks(left)]
    found = [f.where("exact_query_match or near_duplicate_pair").select("eval_index", "row_idx", F.col("exact_query_match").alias(reasons[0]), F.col("near_duplicate_pair").alias(reasons[1])) for f in found]
    return _first(found, reasons, left.sparkSession, "eval_index bigint, row_idx bigint, duplicate_query boolean, near_duplicate_eval_item boolean")


def leakage_counts(found: DataFrame, name: str) -> DataFrame:
    """``(check_name, reason, matches)`` of a leakage table; reasons without a match have 0."""
    reasons = [c for c in found.columns if c not in ("eval_index", "row_idx")]
    sums = found.agg(*(F.coalesce(F.sum(F.col(r).cast("int")), F.lit(0)).alias(r) for r in reasons))
    pairs = F.array(*(F.struct(F.lit(r).alias("reason"), F.col(r).alias("matches")) for r in reasons))
    return sums.select(F.lit(name).alias("check_name"), F.explode(pairs).alias("x")).select("check_name", "x.reason", "x.matches")


def split_integrity(sft: DataFrame | None, rag: DataFrame | None, auto: DataFrame | None, manual: DataFrame | None) -> DataFrame:
    """Counts of all pairings whose two sides are given: pairs and records against both item sets, and these against each other."""
    parts = []
    for name, items in (("auto", auto), ("manual", manual)):
        if items is not None and sft is not None:
            parts.append(leakage_counts(sft_leakage(sft, items), f"sft_vs_{name}"))
        if items is not None and rag is not None:
            parts.append(leakage_counts(rag_leakage(rag, items), f"rag_vs_{name}"))
    if auto is not None and manual is not None:
        parts.append(leakage_counts(eval_leakage(auto, manual), "auto_vs_manual"))
    if not parts:
        raise ValueError("no two sides to compare")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_query_matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``(eval_index, row_idx)``: the first pair whose instruction is the item's query, by an equi-join on normalised text."""
    a = items.select("eval_index", T.normalized_lower(F.col("query")).alias("norm")).where(F.col("norm") != "")
    b = rows.select("row_idx", T.normalized_lower(F.col("instruction")).alias("norm")).groupBy("norm").agg(F.min("row_idx").alias("row_idx"))
    return a.join(b, "norm").select("eval_index", "row_idx")


def expected_matches(rows: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """``(eval_index, matches, first_row)``: rows of which a text column contains the item's expected text, normalised."""
    texts = spread(rows.select(F.col("row_idx").cast("bigint"), T.normalized_lower(F.col(column)).alias("text")))
    out = None
    for block in _blocks(items):
        expected = [(i, _norm(e)) for i, _, e in block]

        def run(batches: Iterator[pa.RecordBatch], expected=expected) -> Iterator[pa.RecordBatch]:
            automaton = _automaton([e for _, e in expected])
            for batch in batches:
                rows = [(expected[i][0], row) for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in _contained(automaton, t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["eval_index", "row_idx"])

        part = texts.mapInArrow(run, "eval_index bigint, row_idx bigint")
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else rows.sparkSession.createDataFrame([], "eval_index bigint, row_idx bigint")
    return out.groupBy("eval_index").agg(F.count("*").alias("matches"), F.min("row_idx").alias("first_row"))
