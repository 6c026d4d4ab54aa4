"""Text functions as column expressions. Null counts as the empty string throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters in one form that JVM and RE2 regular expressions read alike (fixed values).
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
OTHER_SPACE = SPACE.replace(r"\x20", r"\x1f")
WORD = r"[\p{L}\p{N}_]"
EDGE = r"(^|[^\p{L}\p{N}_])"
#: Words that mark a record as on topic (fixed values, matched as substrings).
TOPICS = [
    "ml", "machine learning", "deep learning", "neural", "transformer", "attention", "llm", "rag",
    "embedding", "faiss", "python", "pytorch", "tensorflow", "huggingface", "fine-tune", "finetune",
]
MISSING_SOURCE = "__missing_source__"


def normalized(c: Column) -> Column:
    """Runs of white space become one space; none at the ends. A single plain space is left as it is and not matched."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f" {SPACE}+|{OTHER_SPACE}{SPACE}*", " "))


def normalized_lower(c: Column) -> Column:
    return F.lower(normalized(c))


def stripped(c: Column) -> Column:
    """White space cut off at both ends, whatever it is."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))


def non_ascii_ratio(c: Column) -> Column:
    """Share of code points above 127; 0 for an empty text."""
    other = F.length(F.regexp_replace(c, r"[\x00-\x7F]+", ""))
    return F.when(F.length(c) > 0, other / F.length(c)).otherwise(0.0)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD + "+"))


def tokens(c: Column, pattern: str = "word") -> Column:
    r"""Lower-case words. ``literal_backslash_w`` finds what the pattern ``\\w+`` finds in a raw string: nothing in usual text."""
    what = {"word": WORD + "+", "literal_backslash_w": r"\\w+"}[pattern]
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(what), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def preview(c: Column, limit: int = 180) -> Column:
    """The normalised text, or its start and three dots."""
    t = normalized(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def bucket_name(c: Column) -> Column:
    """A name safe for files: lower-case letters, digits, - and _; ``unknown`` if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(normalized_lower(c), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(safe == "", "unknown").otherwise(safe)


def doc_key(path: Column, fallback: str = "document") -> Column:
    """A document id from a path; different paths may share one."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(key == "", fallback).otherwise(key)


def first_line(c: Column) -> Column:
    """The first line that is not blank, without outer white space; null if there is none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"([^\r\n]*[^\s][^\r\n]*)", 1)
    line = stripped(found)
    return F.when(line != "", line)


def title_of(c: Column, fallback: Column) -> Column:
    """A heading's text (or the fallback if it has none), else 120 characters of the first line."""
    line = first_line(c)
    bare = stripped(F.regexp_replace(line, "^#+", ""))
    heading = F.when(bare != "", bare).otherwise(fallback)
    return F.when(line.isNull(), fallback).when(line.startswith("#"), heading).otherwise(F.substring(line, 1, 120))


def section_of(c: Column) -> Column:
    """A heading's text if the text starts with one, else null."""
    line = first_line(c)
    bare = stripped(F.regexp_replace(line, "^#+", ""))
    return F.when(line.startswith("#") & (bare != ""), bare)


def is_heading(c: Column) -> Column:
    line = first_line(c)
    return F.coalesce(line.startswith("#") | (line.endswith(":") & (F.length(line) <= 100)), F.lit(False))


def snippet(c: Column, least: int, most: int) -> Column:
    """A whole short text; else its start up to the last of the first of ``. ? ! ;`` found far enough, else up to a space."""
    t = normalized(c)
    head = F.substring(t, 1, most)

    def last(mark: str) -> Column:
        at = F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1
        return F.when((F.instr(head, mark) > 0) & (at >= least), at)

    ends = [F.when(last(m).isNotNull(), stripped(F.substring(head, F.lit(1), last(m) + 1))) for m in (". ", "? ", "! ", "; ")]
    space = F.when(last(" ").isNotNull(), stripped(F.substring(head, F.lit(1), last(" "))))
    return F.when(F.length(t) <= most, t).otherwise(F.coalesce(*ends, space, stripped(head)))


def on_topic(c: Column, keywords: list[str] | None = None) -> Column:
    lower = F.lower(F.coalesce(c, F.lit("")))
    return lower.rlike("|".join(k.replace("-", r"\-") for k in keywords or TOPICS))


def run_label(c: Column, most: int = 120) -> Column:
    """Letters, digits, - and _; others become _; none at the ends."""
    safe = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    return F.regexp_replace(F.substring(safe, 1, most), "^_+|_+$", "")


def split_list(c: Column) -> Column:
    """Distinct items of a comma-separated list, in order, without blanks."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def source_bucket(c: Column) -> Column:
    s = normalized(c)
    return F.when(s == "", MISSING_SOURCE).otherwise(s)


def merged(title: Column, text: Column) -> Column:
    """Title, a blank line and text; the text alone without a title. Both normalised."""
    t, x = normalized(title), normalized(text)
    return F.when(t != "", F.concat(t, F.lit("\n\n"), x)).otherwise(x)


def answer_part(c: Column) -> Column:
    """What follows the last ``[ASSISTANT]``, up to the next role."""
    tail = F.substring_index(F.coalesce(c, F.lit("")), "[ASSISTANT]", -1)
    return stripped(F.split(tail, r"\[(?:SYSTEM|CONTEXT|USER|ASSISTANT)")[0])


def trigrams(c: Column) -> Column:
    """Character trigrams of the normalised lower-case text; a shorter text is its own."""
    t = normalized_lower(c)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(many)


def prefixed(c: Column, model: str, kind: str) -> Column:
    """``passage: `` or ``query: `` before the text where the model wants it."""
    return F.concat(F.lit(f"{kind}: "), c) if "e5" in model.lower() else c
