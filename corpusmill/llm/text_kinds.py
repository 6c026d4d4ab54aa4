"""Kinds of lines by a hidden Markov model over line statistics, and statistics of whole texts."""

from __future__ import annotations

import re
import numpy as np

from .fields import LABEL, fields
from .words import WORD

STATES = ("prose", "list", "table", "fields", "junk")
SIGNS = ("sentence", "short", "item", "bullet", "cells", "label", "noise", "code", "scrap")
#: What the model begins with: P(sign of a line | state of the line), rows as STATES, columns as SIGNS; P(state of the first line);
#: P(same state in the next line). Written down by hand; ``line_model.fit`` estimates all of them from the texts.
EMIT = np.array(
    [
        [0.77, 0.03, 0.03, 0.04, 0.01, 0.01, 0.005, 0.055, 0.05],
        [0.02, 0.10, 0.32, 0.46, 0.01, 0.01, 0.005, 0.005, 0.07],
        [0.01, 0.01, 0.04, 0.01, 0.88, 0.01, 0.005, 0.005, 0.03],
        [0.02, 0.01, 0.03, 0.05, 0.01, 0.83, 0.005, 0.005, 0.04],
        [0.01, 0.01, 0.02, 0.01, 0.03, 0.01, 0.81, 0.01, 0.09],
    ]
)
START = np.array([0.80, 0.06, 0.05, 0.05, 0.04])
STAY = 0.92
#: A text is of a kind if lines of that kind hold this share of its words at least.
SHARE = 0.8

MARKER = re.compile(r"(?:(?<=\s)|^)(?:[-*•·–]|\(?\d{1,3}[.)]|\(?[a-z][.)])(?=\s)")
CODE = re.compile(r"```|^\s*(?:def |for .*:$|if .*:$|return |import |[\w.]+ ?= ?[\w.\[({]|[\w.]+\(.*\)$)|[{};]\s*$")
TABLE = re.compile(r"\S[ \t]*\|[ \t]*\S")
CELL = re.compile(r"^[^\s,;]+(?:[,;][^\s,;]+){2,}$")
GAPS = re.compile(r"\S(?:\t| {2,})(?=\S)")
HEX = re.compile(r"^[0-9a-f]{6,}$", re.I)
MARKED = re.compile(r"[.!?…:;][\"'”»)\]]*\s*$")
#: A mark inside a line, and one that ends a sentence of running text.
INSIDE = re.compile(r"[.!?;,]\s")
FLOWING = re.compile(r"(?:[^\W\d_]{2}|\d%?)[.!?;]\s+[^\W\d_]")
VOWELS = re.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüãõåæœаеёиоуыэюя]")
ODD = re.compile(r"[^\w\s.,;:!?'\"()|\-–—%/«»“”¿¡•`=\[\]{}#*_]")


def strange(line: str, found: list[str]) -> bool:
    """Whether a line is no writing: symbols, one endless token, digests, the same few words over and over, odd letters."""
    body = len(line) - line.count(" ")
    letters = sum(map(len, found))
    if not body:
        return False
    if body >= 12 and (letters < 0.55 * body and not TABLE.search(line) or len(ODD.findall(line)) > 0.2 * body):
        return True
    if found and max(map(len, line.split())) > 60 and sum(len(x) for x in line.split() if len(x) > 40) > 0.5 * body:
        return True
    if len(found) >= 4 and sum(bool(HEX.match(w)) and any(c.isdigit() for c in w) for w in found) > 0.5 * len(found):
        return True
    if len(found) >= 12 and len(set(found)) <= 0.2 * len(found) + 1:
        return True
    written = sum(map(str.isalpha, line))
    if written >= 24 and len(VOWELS.findall(line.lower())) < 0.18 * written:
        return True
    odd = sum(1 for c in line if "ƀ" <= c < "Ͱ" or "" <= c <= "" or c == "�")
    return odd > 0.15 * body


def common_share(found: list[str], common: frozenset[str]) -> float:
    alpha = [w for w in found if not w.isdigit()]
    return sum(w in common for w in alpha) / len(alpha) if alpha else 0.0


def sign(line: str, common: frozenset[str], found: list[str], even: bool = False) -> str:
    """The sign a line gives, from its statistics. A line in which a sentence ends and another begins has no label.

    ``even``: all lines of its text have as many wide gaps.
    """
    share = common_share(found, common)
    named = ":" in line and share < 0.45 and LABEL.match(line) and not FLOWING.search(line)
    marked = bool(MARKED.search(line))
    if share >= 0.3 and len(found) >= 6 and "`" not in line and (marked or len(found) > 9):
        return "label" if named else "sentence"
    tokens = line.split()
    if even and GAPS.search(line):
        return "cells"
    if share < 0.2 and strange(line, found):
        return "noise"
    if "|" in line and line.count("|") >= max(2, 0.12 * len(tokens)):
        return "cells"
    if share < 0.15 and sum(bool(CELL.match(t)) for t in tokens) >= max(1, 0.5 * len(tokens)):
        return "cells"
    if "\t" in line or "  " in line:
        gaps = len(GAPS.findall(line))
        if gaps >= 2 and not marked and share < 0.15 and gaps >= 0.4 * (len(tokens) - 1):
            return "cells"
    if named and len(found) > 2:
        return "label"
    if CODE.search(line):
        return "code"
    if len(found) <= 14 and (share < 0.3 or not marked) and MARKER.match(line.lstrip()):
        return "bullet"
    if not found or len(found) <= 2 and not marked:
        return "scrap"
    if len(found) <= 9 and not marked:
        return "item" if share < 0.3 else "short"
    if share < 0.2 and not marked and len(found) > 9 and not INSIDE.search(line):
        return "item"
    return "sentence"


class LineModel:
    """A hidden Markov model of the lines of texts: first states, moves between states, signs of states."""

    def __init__(self, start: np.ndarray | None = None, move: np.ndarray | None = None, emit: np.ndarray | None = None):
        k = len(STATES)
        self.start = START if start is None else start
        self.move = np.where(np.eye(k, dtype=bool), STAY, (1 - STAY) / (k - 1)) if move is None else move
        self.emit = EMIT if emit is None else emit
        self.logs = tuple(np.log(x) for x in (self.start, self.move, self.emit))
        self.known: dict[tuple[int, ...], tuple[int, ...]] = {}

    def decode(self, signs: tuple[int, ...]) -> tuple[int, ...]:
        """The likeliest states of a text's lines (Viterbi)."""
        if signs in self.known:
            return self.known[signs]
        start, move, emit = self.logs
        score, back = start + emit[:, signs[0]], []
        for s in signs[1:]:
            step = score[:, None] + move
            back.append(step.argmax(0))
            score = step.max(0) + emit[:, s]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        if len(self.known) >= 50_000:
            self.known.clear()
        out = self.known[signs] = tuple(reversed(path))
        return out

    def judge(self, signs: tuple[int, ...], words: list[int]) -> tuple[list[float], str]:
        """The share of each state among the words of a text's lines, and its kind. Named fields are two at least."""
        weight = np.array(words) + 0.1
        shares = np.bincount(self.decode(signs), weight, len(STATES)) / weight.sum()
        best = int(shares.argmax())
        one = STATES[best] == "fields" and signs.count(SIGNS.index("label")) < 2
        return shares.tolist(), STATES[best] if best and shares[best] >= SHARE and not one else "prose"


def wrapped(lines: list[str]) -> bool:
    """Whether no line but the last had room for the next one's first word, in lines of a usual width."""
    most = max(map(len, lines))
    return most >= 48 and all(len(a.rstrip()) + 1 + len(b.split(None, 1)[0]) > most for a, b in zip(lines, lines[1:]))


def lines_of(text: str) -> list[str]:
    """The lines of a text. Behind a marker at the start, further markers begin lines, as line breaks may be lost.

    Lines of running text, which has sentence ends or lines as full as they can be, were only wrapped: up to a marker, cells or code they are one.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) > 1 and (FLOWING.search(text) or wrapped(lines)):
        joined: list[str] = []
        free = False
        for line in lines:
            plain = not (MARKER.match(line.lstrip()) or "|" in line or "\t" in line or CODE.search(line))
            if plain and free and not MARKED.search(joined[-1]):
                joined[-1] += " " + line.strip()
            else:
                joined.append(line)
            free = plain
        lines = joined
    out = []
    for line in lines:
        head = line.lstrip()
        marks = [m.start() for m in MARKER.finditer(head)] if MARKER.match(head) else []
        if len(marks) >= 2 and len(head.split()) <= 16 * (len(marks) + 1) and "|" not in head:
            out += [x for a, b in zip(marks, [*marks[1:], len(head)]) if (x := head[a:b]).strip()]
        else:
            out.append(line)
    return out


class Statistics:
    """Statistics and kind of texts; ``common`` are the common words of all languages."""

    SEEN = "words int, mean_word_length double, symbol_ratio double, lines int, marked_line_share double, common_share double"
    SHARES = "prose_share double, list_share double, table_share double, fields_share double, junk_share double, kind string"
    COLUMNS = f"{SEEN}, {SHARES}"

    def __init__(self, common: frozenset[str], model: LineModel | None = None):
        self.common, self.model = common, model or LineModel()

    def signs(self, text: str, found: list[str], lines: list[str], share: float) -> tuple[tuple[int, ...], list[int]]:
        """What the model sees of a text: the signs of its lines, by number, and their words.

        Named fields are lines of their own where a text holds nothing else, whatever its layout; lines without any common word that are
        no writing together are one.
        """
        if share < 0.5 and (own := fields(text)):
            return (SIGNS.index("label"),) * len(own), [len(WORD.findall(f"{k} {v}")) for k, v in own]
        if share < 0.2 and strange(text, found):
            return (SIGNS.index("noise"),), [len(found)]
        of = [found] if len(lines) == 1 else [WORD.findall(x.lower()) for x in lines]
        even = len(lines) > 2 and (gaps := len(GAPS.findall(lines[0]))) > 1 and all(len(GAPS.findall(x)) == gaps for x in lines)
        return tuple(SIGNS.index(sign(x, self.common, w, even)) for x, w in zip(lines, of)), [len(w) for w in of]

    def seen(self, text: str) -> tuple[tuple, tuple[int, ...], list[int]]:
        """The values of ``SEEN``, and what the model sees; a blank text, or one of mere marks without lines, has no signs."""
        found = WORD.findall(text.lower())
        lines = lines_of(text) if text.strip() else []
        body = len("".join(text.split()))
        letters = sum(map(len, found))
        share = common_share(found, self.common)
        marked = sum(bool(MARKED.search(x)) for x in lines) / len(lines) if lines else 0.0
        signs, words = self.signs(text, found, lines, share) if lines else ((), [])
        return (len(found), letters / len(found) if found else 0.0, (body - letters) / body if body else 0.0, len(lines), marked, share), signs, words

    def __call__(self, text: str | None) -> tuple | None:
        """The values of ``COLUMNS``; None for a null, and no kind for a blank text."""
        if text is None:
            return None
        own, signs, words = self.seen(text)
        shares, kind = self.model.judge(signs, words) if signs else ([0.0] * len(STATES), None)
        return (*own, *shares, kind)
