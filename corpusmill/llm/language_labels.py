"""Languages of documents and of their segments, and values whose declared label is missing or wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from . import line_model
from .languages import MOST_SAMPLES, LanguageModel, declared
from .text_kinds import Statistics
from .text_statistics import LEAST_CHARS
from .values import over
from .words import MOST_LISTED, word_list, words

KEY = ["table_name", "row_idx", "field_name"]
#: Values of fewer words say too little about their language.
LEAST_WORDS = 6


def fit(samples: DataFrame, common: DataFrame, most: int = MOST_SAMPLES) -> LanguageModel:
    """A model from at most ``most`` labelled sentences ``(lang, text)`` and all common words ``(lang, word, word_rank)``.

    Every language gets the same share of ``most``, at least one sentence; of a language with more the first in the order of their MD5
    digests are taken. Nulls are left out. More than ``MOST_LISTED`` common words are an error.
    """
    known = samples.select("lang", "text").dropna().distinct()
    share = max(1, most // max(1, known.select("lang").distinct().count()))
    order = Window.partitionBy("lang").orderBy(F.md5("text"), "text")
    sentences = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= share).drop("n").orderBy("lang", "text").collect()
    listed = common.select("lang", "word", "word_rank").dropna().orderBy("lang", "word_rank", "word").limit(MOST_LISTED + 1).collect()
    if len(listed) > MOST_LISTED:
        raise ValueError(f"a list of common words has at most {MOST_LISTED} words")
    return LanguageModel([tuple(r) for r in sentences], [tuple(r) for r in listed])


def text_languages(values: DataFrame, model: LanguageModel) -> DataFrame:
    """``(table_name, row_idx, field_name, lang, share, confidence)``: a row for each language of each value.

    ``share`` is the share of its words, ``confidence`` their mean posterior. Null and blank values and those without
    evidence of any language have no row.
    """

    def make():
        def f(_, texts):
            found = model.languages([t or "" for t in texts])
            return [(i, *x) for i, own in enumerate(found) for x in own]

        return f

    return over(values, make, KEY, "lang string, share double, confidence double")


def language_segments(values: DataFrame, model: LanguageModel) -> DataFrame:
    """``(table_name, row_idx, field_name, segment, first_word, words, lang, confidence)`` of the segments of each value.

    Neighbouring segments differ in language; ``lang`` is null where nothing speaks for any.
    """

    def make():
        def f(_, texts):
            found = model.segments([t or "" for t in texts])
            return [(i, k, a, n, model.codes[c] if c >= 0 else None, x) for i, own in enumerate(found) for k, (a, n, c, x) in enumerate(own)]

        return f

    return over(values, make, KEY, "segment int, first_word int, words int, lang string, confidence double")


def language_cases(values: DataFrame, model: LanguageModel, common: DataFrame, *, natural_only: list[str]) -> DataFrame:
    """``(table_name, row_idx, field_name, lang)``: the languages of values whose label is missing, empty of meaning or
    wrong, or that hold several.

    A label of another spelling (case, region, three letters, English name) is right. Values of fewer than
    ``LEAST_WORDS`` words, and those of fields in ``natural_only`` that are lists, tables, named fields or junk (by the model of lines
    that all these values give), are no cases.
    """
    listed = word_list(common)

    def make():
        kinds = Statistics(listed)

        def f(rows, texts):
            found = model.languages([t or "" for t in texts])
            out = []
            for i, ((_, _, field, label), text, own) in enumerate(zip(rows, texts, found)):
                seen = kinds.seen(text)[1:] if text and field in natural_only and len(text.strip(" ")) >= LEAST_CHARS else ((), [])
                right = not own or len(own) == 1 and declared(label) == own[0][0] or len(words(text)) < LEAST_WORDS
                out.append((i, [] if right else [lang for lang, _, _ in own], line_model.digits(seen[0]), seen[1]))
            return out

        return f

    seen = cut(over(values, make, [*KEY, "label"], "langs array<string>, signs string, line_words array<int>").drop("label"))
    kept = line_model.judged(seen.where("size(langs) > 0"), line_model.fit(seen)).where("kind is null or kind = 'prose'")
    return kept.select(*KEY, F.explode("langs").alias("lang"))


def language_report(values: DataFrame, model: LanguageModel) -> DataFrame:
    """How often each main language comes under each declared label, with its mean confidence."""
    main = text_languages(values, model).groupBy(*KEY).agg(F.max_by("lang", F.struct("share", "lang")).alias("lang"), F.max_by("confidence", F.struct("share", "lang")).alias("confidence"))
    label = values.select(*KEY, F.coalesce("label", F.lit("")).alias("label"))
    return label.join(main, KEY, "left").groupBy("table_name", "field_name", "label", "lang").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
