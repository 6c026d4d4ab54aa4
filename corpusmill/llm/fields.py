"""Texts that consist of named fields, whatever their layout."""

from __future__ import annotations

import json
import re

#: A field's name: one to three words of letters before a colon, at the start of the text or behind a mark, a line end
#: or a word that ends in a digit.
LABEL = re.compile(r"(?:(?<=^)|(?<=[^\w\s])|(?<=\d)|(?<=\n))(?:[\s\"'{}|;,.*•·\-–]*?)(?<![^\W\d_])([^\W\d_]+(?:[^\S\n]+[^\W\d_]+){0,2})[\"']?[^\S\n]*[:=](?=\s|[\"'])")
#: A line that is one field, its name and its value.
LINE = re.compile(r"[\W_]*([^\W\d_]+(?:\s+[^\W\d_]+){0,2})[\"']?\s*[:=]\s+(.*\w.*)$")
INNER = re.compile(r"[^\W\d_]{2,}[.!?]\s+[^\W\d_]")
ALNUM = re.compile(r"[\W_]+")
LONGEST = 60


def fields(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a text of two or more named fields and nothing else, in their order; else None.

    Lines, bullets, bars, semicolons or a JSON object may hold the fields, and line breaks may be lost. A name may begin at each
    line and spans none. Unless three or more lines are each one field, a value of more than ``LONGEST`` words or with a sentence end
    inside is no field's value.
    """
    if text.count(":") < 2:
        return None
    bare = text.strip()
    if bare.startswith("{"):
        try:
            found = json.loads(bare, strict=False)
            if isinstance(found, dict) and len(found) > 1 and all(isinstance(v, str | int | float) for v in found.values()):
                return [(k, str(v)) for k, v in found.items()]
        except ValueError:
            pass
    lines = [x.strip() for x in bare.splitlines() if re.search(r"\w", x)]
    if len(lines) > 2 and all(LINE.match(x) and len(LABEL.findall(x)) == 1 for x in lines):
        return [LINE.match(x).groups() for x in lines]
    marks = list(LABEL.finditer(bare))
    if len(marks) < 2 or re.search(r"\w", bare[: marks[0].start(1)]):
        return None
    for m in marks[1:]:  # a name after a sentence's end on the same line is prose
        if re.search(r"[.!?][\"']?[^\S\n]*$", bare[: m.start(1)]) and not re.search(r"[\n\-*•·–|;]\W*$", bare[: m.start(1)]):
            return None
    ends = [m.start(1) for m in marks[1:]] + [len(bare)]
    out = [(m.group(1), bare[m.end() : e]) for m, e in zip(marks, ends)]
    if any(not re.search(r"\w", v) or len(v.split()) > LONGEST or INNER.search(v) for _, v in out):
        return None
    return out


def bare(text: str | None) -> str:
    """Letters and digits alone, without case (capital sharp s counts as ss)."""
    return ALNUM.sub("", text.upper().lower()) if text else ""


def canonical(text: str | None) -> str:
    """Letters and digits of a text; of named fields, the sorted names with their values, so that order doesn't count."""
    if text and (found := fields(text)):
        return "\n".join(sorted(f"{bare(k)}={bare(v)}" for k, v in found))
    return bare(text)
