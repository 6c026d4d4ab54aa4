"""Whether a text's end is missing: contexts of its last words, counted over all texts, and what was put after a cut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .bitmap import Bits, bitmap
from .text_kinds import CELL, MARKER
from .words import GOLD, mix

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;…]+(?=\s|$|[\"'”»)])|[,:|\[\]()`]|\n\s*\n")
#: What may follow a cut: a torn entity, tag or bracket, marks of omission, broken characters.
TORN = re.compile(r"\s*(?:&[#\w]{0,7}|</?\w*|\[\w{0,9}|\[(?:truncated|cut|more)\]|�+)\s*$")
OMITTED = re.compile(r"\s*(?:\.{3,}|…|\[\s*(?:\.{3}|…)\s*\]|\((?:more|cont\w*)\.?\))\s*$")
#: What may follow a whole sentence instead of its mark, or after it.
REMARK = re.compile(r"\s*(?:\([^()\n]{1,20}\)|[:;]-?[)(DP]|\"[^\"\n]{1,24}\"|“[^”\n]{1,24}”)\s*$")
CLOSING, FINALS = "\"'”»)]*_ \t\n\r\f\v", (".", "!", "?")
CELLS = re.compile(r"[^\s,;][,;][^\s,;]+[,;][^\s,;]")
#: Characters at the end in which what may follow a cut or a sentence is looked for.
LONGEST = 200
NOTE = re.compile(r"^\s*(?:\[\d+\]\s|--+\s*\S|—\s*\S|(?:see also|source|note|via|tags?|ref)\s*:|```|>\s)", re.I)
TAIL = 240
WORD, CAPITAL, DIGITS, FINAL, OTHER = range(5)
#: Tokens of the contexts that are counted, and their columns.
LENGTHS = (1, 2, 3, 5)
KEYS = [f"k{n}" for n in LENGTHS]
#: Odds that a sentence goes on behind an average word, against the share of words that end one.
AVERAGE = 1 / 14


class Tokens(dict):
    """token -> hash, whose last three bits are its kind; forgets everything beyond ``most`` tokens."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        if token[0].isalnum():
            kind = DIGITS if not token.isalpha() and any(c.isdigit() for c in token) else CAPITAL if token[0].isupper() else WORD
        else:
            kind = FINAL if token[0] in ".!?;…" else OTHER
        out = self[token] = xxhash.xxh3_64_intdigest(token.lower()) & ~7 | kind
        return out


def contexts(lists: list[list[str]], memo: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the text it is in, its kind, its hash, and the hashes of the last ``LENGTHS`` tokens up to it.

    Numbers are alike, and so are capitalised words inside a sentence, as they are names; not so where most words of a
    text are capitalised.
    """
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter(map(memo.__getitem__, chain.from_iterable(lists)), np.uint64, int(n.sum()))
    kind = (h & np.uint64(7)).astype(np.int8)
    h &= ~np.uint64(7)
    doc = np.repeat(np.arange(len(lists)), n)
    capital = np.bincount(doc, kind == CAPITAL, len(lists)) > 0.5 * np.bincount(doc, kind <= CAPITAL, len(lists))
    before = np.r_[FINAL, kind[:-1]]
    before[np.r_[True, doc[1:] != doc[:-1]]] = FINAL
    h = np.where(kind == DIGITS, np.uint64(9), h)
    h = np.where((kind == CAPITAL) & (before != FINAL) & ~capital[doc], np.uint64(7), h)
    keys, back = [mix(h + np.uint64(1))], h
    longer = keys[0]
    for i in range(1, LENGTHS[-1]):
        back = np.r_[np.zeros(1, np.uint64), back[:-1]]
        back = np.where(doc == np.r_[np.full(i, -1), doc[:-i]][: len(doc)], back, np.uint64(i))
        longer = mix(longer * GOLD + back)
        if i + 1 in LENGTHS:
            keys.append(longer)
    return doc, kind, h, np.stack(keys) if len(h) else np.zeros((len(LENGTHS), 0), np.uint64)


def done(text: str) -> bool:
    """Whether a text ends in a mark that ends a sentence, with closing marks behind it at most."""
    return text.rstrip(CLOSING)[-1:] in FINALS


def ending(text: str) -> tuple[str, str | None, str]:
    """(state, mark, text up to the cut). The state is done, listed (an item, row, code, signature or note) or open;
    the mark is torn if something stands behind that only stands behind cuts, omitted for an ellipsis."""
    torn = False
    text = text.rstrip()
    if any(c in text[-LONGEST:] for c in "&<[\ufffd") and (m := TORN.search(text, max(0, len(text) - LONGEST))):
        if not (m.group().strip().startswith("[") and len(m.group().strip()) > 1 and not re.match(r"\[(?:t|c|m)", m.group().strip())):
            text, torn = text[: m.start()], True
    omitted = text[-1:] in (".", "…", "]", ")") and OMITTED.search(text, max(0, len(text) - LONGEST))
    if omitted:
        text = text[: omitted.start()]
    text = text.rstrip()
    last = text[text.rfind("\n") + 1 :]
    line = last.strip()
    if not line:
        return "done", None, text
    tokens = line.split()
    cells = bool(CELLS.search(line)) and sum(bool(CELL.match(t)) for t in tokens) >= max(1, 0.5 * len(tokens))
    if line.count("|") >= 2 or "\t" in line or cells or "  " in line and len(re.findall(r"\S {2,}\S", line)) >= 2 or NOTE.match(line):
        return "listed", None, text
    if MARKER.match(line) and len(tokens) <= 14:
        return "listed", None, text
    if text.endswith("`") or text.count("```") % 2 or re.search(r"[{}();=]\s*$", line) and "```" in text[-400:]:
        return "listed", None, text
    if done(text) and not (torn or omitted):
        return "done", None, text
    if text[-1:] in (")", "(", "D", "P", '"', "”") and (m := REMARK.search(text, max(0, len(text) - LONGEST))):
        rest = text[: m.start()].rstrip()
        if done(rest):
            return "done", None, text
        text = rest
    if done(text):
        return "done", None, text
    return "open", "torn" if torn else "omitted" if omitted else None, text


class Endings:
    """The open ends among some texts."""

    def __init__(self):
        self.kept: list[int] = []
        self.lists: list[list[str]] = []
        self.marks: list[str | None] = []
        self.odd: list[int] = []

    def add(self, place: int, text: str | None) -> bool:
        """Whether a text ends open; then it is kept under its place."""
        if not text or not text.strip():
            return False
        state, mark, upto = ending(text)
        tokens = TOKEN.findall(upto[-TAIL:]) if state == "open" else []
        while tokens and not tokens[-1][0].isalnum():
            tokens.pop()
        if tokens:
            word = tokens[-1]
            self.kept.append(place)
            self.lists.append(tokens)
            self.marks.append(mark)
            # 2: a comma or the like stands last; 1: a word not seen before in the text, in small letters, with nothing behind it
            alone = word.islower() and upto.endswith(word) and len(re.findall(rf"(?<!\w){re.escape(word)}(?!\w)", upto.lower())) < 2
            self.odd.append(2 if upto[-1] in ",;:(–-" else int(alone))
        return bool(tokens)

    def columns(self, memo: Tokens) -> tuple[list[int], list[pa.Array]]:
        """The places kept, and mark, odd and the last contexts of each."""
        doc, _, _, keys = contexts(self.lists, memo)
        last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(0, np.int64)
        k = keys[:, last].view(np.int64) if len(doc) else np.zeros((len(LENGTHS), 0), np.int64)
        return self.kept, [pa.array(self.marks, pa.string()), pa.array(self.odd, pa.int32()), *map(pa.array, k)]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Tokens()
    for batch in batches:
        ends = Endings()
        for i, text in enumerate(batch.column(1).to_pylist()):
            ends.add(i, text)
        at, columns = ends.columns(memo)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["id", "mark", "odd", *KEYS])


def _counts(wanted: Bits, chunk: int = 200):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for whole in batches:
            keys, ends = [], []
            for batch in (whole.slice(i, chunk) for i in range(0, whole.num_rows, chunk)):
                doc, kind, _, k = contexts([TOKEN.findall(t) if t else [] for t in batch.column(0).to_pylist()], memo)
                if len(doc) < 2:
                    continue
                here = (kind[:-1] <= DIGITS) & (doc[1:] == doc[:-1]) & ((kind[1:] <= FINAL) | (kind[1:] == OTHER))
                at = np.flatnonzero(here)
                for row in k:
                    own = row[at]
                    hit = wanted.passes(own)
                    keys.append(own[hit].view(np.int64))
                    ends.append(kind[at[hit] + 1] == FINAL)
            if keys:
                all_keys, n = np.concatenate(keys), np.concatenate(ends)
                distinct, at = np.unique(all_keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct), pa.array(np.bincount(at, n, len(distinct)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(distinct)))],
                    names=["key", "ends", "seen"],
                )

    return run


def odds_of(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``found(id, mark, odd, k1, k2, ..)`` to ``(id, mark, odds)``, by the contexts of the column ``text`` of all texts."""
    keys = found.select(F.explode(F.array(*KEYS)).alias("key"))
    counts = texts.select("text").mapInArrow(_counts(bitmap(keys, len(KEYS) * found.count())), "key bigint, ends bigint, seen bigint")
    own = keys.groupBy("key").agg(F.count("*").alias("open"))
    counts = cut(counts.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen")).join(own, "key"))
    for n in LENGTHS:
        found = found.join(counts.select(F.col("key").alias(f"k{n}"), *(F.col(c).alias(f"{c}{n}") for c in ("ends", "seen", "open"))), f"k{n}", "left")
    share = F.coalesce(*(F.when(F.col(f"seen{n}") >= 3, (F.col(f"ends{n}") + 0.02) / (F.col(f"seen{n}") + 0.5)) for n in reversed(LENGTHS)), F.lit(AVERAGE))
    torn_word = (F.col("odd") == 2) | (F.col("odd") == 1) & (F.coalesce("seen1", F.lit(0)) <= F.greatest(F.lit(2), F.coalesce("open1", F.lit(0))))
    return found.select("id", "mark", F.when(torn_word, 50.0).otherwise(AVERAGE / share).alias("odds"))


def open_endings(texts: DataFrame) -> DataFrame:
    """``(id, mark, odds)`` of the texts ``(id, text)`` that end neither in a mark nor in an item, row, code or note.

    ``odds`` is how much likelier the last words are where a text is cut at random than where a sentence ends, by how
    often the same last five, three, two words or one (the longest seen three times) stand before a mark and elsewhere in all
    texts. A last word in small letters that is hardly ever seen as such, or no oftener than at open ends, is taken for a torn one, and a text that ends
    in a comma or the like for an unfinished one.
    """
    found = cut(texts.select("id", "text").mapInArrow(_open, f"id bigint, mark string, odd int, {', '.join(f'{k} bigint' for k in KEYS)}"))
    return odds_of(found, texts)
