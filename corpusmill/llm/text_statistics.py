"""Statistics of texts, and texts that are no natural prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .line_model import digits, fit, judged
from .text_kinds import Statistics
from .values import over
from .words import word_list

KEY = ["table_name", "row_idx", "field_name"]
#: Shorter values are of no kind.
LEAST_CHARS = 40


def text_statistics(values: DataFrame, common: DataFrame) -> DataFrame:
    """A row for each value that is not null: words, mean word length, symbol ratio, lines, share of marked lines, share of
    common words, shares of prose, list, table, fields and junk among the words, and the kind of the whole.

    Lines are labelled by a hidden Markov model over what each looks like, which is estimated from all values; the kind is other than prose
    where four fifths of the words are in lines of that label. A blank value has zeros and no kind. ``common(word)`` is a word list (``word_list``).
    The texts are read once; what the model sees of them is kept in between.
    """
    listed = word_list(common)

    def make():
        statistics = Statistics(listed)

        def f(_, texts):
            out = []
            for i, t in enumerate(texts):
                if t is not None:
                    own, signs, words = statistics.seen(t)
                    out.append((i, *own, digits(signs), words))
            return out

        return f

    seen = cut(over(values, make, KEY, f"{Statistics.SEEN}, signs string, line_words array<int>"))
    return judged(seen, fit(seen))


def unnatural_texts(values: DataFrame, common: DataFrame) -> DataFrame:
    """``(table_name, row_idx, kind)`` of the values of ``LEAST_CHARS`` or more characters that are no natural prose."""
    long = values.where(F.length(F.trim("text")) >= LEAST_CHARS)
    return text_statistics(long, common).where("kind <> 'prose'").select("table_name", "row_idx", "kind")
