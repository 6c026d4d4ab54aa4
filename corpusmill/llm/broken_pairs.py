"""Prompt and response pairs that are useless for training, with what is wrong with each."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .links import join_hot
from .near_duplicates import near_duplicates
from ..sources.tables import spread
from .endings import KEYS, Endings, Tokens, odds_of
from .languages import LanguageModel
from .text_kinds import Statistics
from .truncation import OMITTED_PRIOR, PRIOR, TORN_PRIOR
from .words import WORD, word_list, words

#: Answers that stand for none, as words without marks; a fixed list.
PLACEHOLDERS = {
    "", "tbd", "todo", "tba", "none", "null", "nil", "nan", "na", "n a", "empty", "no answer", "no response", "not available",
    "not applicable", "unknown", "undefined", "missing", "placeholder", "blank", "pending", "answer here", "to be done", "to be determined",
}
#: Names of languages in the languages themselves, by code; a fixed table.
NAMES = {
    "en": "english englisch anglais inglés ingles inglês inglese engels английск",
    "de": "german deutsch allemand alemán aleman alemão tedesco duits немецк",
    "fr": "french französisch français francés frances francês francese frans французск",
    "es": "spanish spanisch espagnol español espanol espanhol spagnolo spaans испанск",
    "pt": "portuguese portugiesisch portugais portugués portugues português portoghese portugees португальск",
    "it": "italian italienisch italien italiano italiaans итальянск",
    "nl": "dutch niederländisch néerlandais neerlandés holandés neerlandês holandês olandese nederlands нидерландск голландск",
    "ru": "russian russisch russe ruso russo русск",
}
#: Words of a refusal at most, words of an opening, of its head, and unrelated prompts a template needs.
SHORT, OPENING, HEAD, TEMPLATE = 30, 10, 4, 6
#: Confidence above which an answer is in one language.
SURE = 0.9
SENTENCE = re.compile(r"[^.!?;]+")


def opening(text: str, known: Callable[[str], bool] = str.isalpha) -> list[str]:
    """The first words of the first sentence, of more where it has fewer than three: numbers and words with digits as 0, names as *, that is
    capitalised words inside and a first word that is not ``known``."""
    found: list[str] = []
    for sentence in SENTENCE.finditer(text):
        found += [m.group() for m in islice(WORD.finditer(sentence.group()), OPENING + 4)]
        if len(found) > 2:
            break
    found = found[: OPENING + 4]
    named = sum(w[0].isupper() for w in found) <= 0.5 * len(found)
    out = ["0" if not w.isalpha() and any(c.isdigit() for c in w) else "*" if (named and w[0].isupper() and len(w) > 2 if i else not known(w.lower())) else w.lower() for i, w in enumerate(found)]
    return [w for w, before in zip(out, ["", *out]) if not (w == before and w in "*0")][:OPENING]


def copies(instruction: list[str], response: list[str]) -> bool:
    """Whether nearly all of a response's pairs of words come from the instruction, and most of one of its parts is there."""
    if len(response) < 3 or not instruction:
        return response == instruction and len(response) > 0
    known = set(instruction)
    if sum(map(known.__contains__, response)) < 0.8 * len(response):  # then fewer pairs than that are shared as well
        return False
    a, b = Counter(zip(instruction, instruction[1:])), Counter(zip(response, response[1:]))
    shared = sum((a & b).values())
    return shared >= 0.8 * sum(b.values()) and sum(b.values()) >= 0.3 * sum(a.values())


def _asked(instruction: str, code: str) -> bool:
    lower = instruction.lower()
    return any(re.search(rf"(?<!\w){n}", lower) for n in NAMES.get(code, code).split())


def _read(model: LanguageModel, common: frozenset[str]):
    """Batches of (row_idx, instruction, response) to what one pair shows by itself: its defect, whether it is natural, its words and opening,
    and how it ends. Kind and language are looked at where they matter: at short or open answers, and where the words do not already say that both texts are
    in one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, memo = Statistics(common), Tokens()
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                asks, answers = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
                put, said = [words(t) for t in asks], [words(t) for t in answers]
                doubtful = [i for i, (a, b) in enumerate(zip(put, said)) if len(b) > 2 and not model.alike(a, b)]
                spoken = dict(zip(doubtful, zip(model.languages([asks[i] for i in doubtful]), model.languages([answers[i] for i in doubtful]))))
                ends = Endings()
                rows = []
                for i, (answer, a, b) in enumerate(zip(answers, put, said)):
                    local, natural = None, True
                    x, y = spoken.get(i, ((), ()))
                    foreign = x and len(y) == 1 and y[0][0] != x[0][0] and y[0][2] > SURE and not _asked(asks[i], y[0][0])
                    if len(b) < 5 and " ".join(b) in PLACEHOLDERS:
                        local = "empty"
                    elif copies(a, b):
                        local = "copy"
                    else:
                        open_ = ends.add(i, answer)
                        if foreign or open_ or len(b) <= SHORT:
                            natural = len(answer) < 40 or kinds(answer)[-1] in (None, "prose")
                        if foreign and natural:
                            local = "other_language"
                    start = opening(answer, model.knows)
                    rows.append((local, natural, len(b), " ".join(start) if len(start) > 2 else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int32(), pa.string()))]
                at, how = ends.columns(memo)
                place = np.full(len(rows), -1)
                place[at] = np.arange(len(at))
                taken = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *(c.take(taken) for c in how)], names=["row_idx", "local", "natural", "words", "opening", "mark", "odd", *KEYS])

    return run


#: Answers that may yet be refusals.
SOUND = "natural and (local is null or local = 'other_language')"


def opening_templates(read: DataFrame, *, least: float = 0.7) -> DataFrame:
    """``(opening, template, size, pairs, short_share)``: clusters of like openings of short answers, how many answers have the opening and how many any
    of its cluster, and the share of short ones among all answers that begin with the same ``HEAD`` words as one of the cluster's openings.

    Openings are counted first. Those of which at least one answer is short, natural and has no other defect are linked where they
    share ``least`` of their words, as verified MinHash finds them, and linked ones form a cluster, also by way of others.
    """
    short, sound = F.col("words") <= SHORT, F.expr(SOUND)
    counts = read.where("opening is not null").groupBy("opening").agg(
        F.count("*").alias("size"), F.sum(short.cast("int")).alias("short"), F.min("row_idx").alias("id"), F.max(short & sound).alias("candidate")
    )
    counts = cut(counts.withColumn("head", F.substring_index("opening", " ", HEAD)))
    candidates = counts.where("candidate")
    roots = near_duplicates(candidates, F.col("opening"), row_id="id", width=1, least=least, bags=False).select(F.col("row_idx").alias("id"), F.col("root").alias("template"))
    named = cut(candidates.join(roots, "id").select("opening", "template", "size", "head"))
    heads = counts.groupBy("head").agg(F.sum("size").alias("begun"), F.sum("short").alias("short"))
    share = named.select("template", "head").distinct().join(heads, "head").groupBy("template").agg((F.sum("short") / F.sum("begun")).alias("short_share"))
    total = named.groupBy("template").agg(F.sum("size").alias("pairs"))
    return named.select("opening", "template", "size").join(total, "template").join(share, "template")


def _apart(enough: int, least: float):
    """Rows (template, cell, row_idx, instruction) sorted by template and cell to the first ``enough`` of each cell that are unlike those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leaders = None, []
        for batch in batches:
            out = []
            for i, (template, cell, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
                if (template, cell) != last:
                    last, leaders = (template, cell), []
                if len(leaders) >= enough:
                    continue
                own = words(text)
                runs = frozenset(zip(own, own[1:], own[2:])) or frozenset([tuple(own)])  # without a run: alike if the words are the same
                if all(len(runs & x) < least * len(runs | x) for x in leaders):
                    leaders.append(runs)
                    out.append(i)
            yield batch.take(pa.array(out, pa.int64()))

    return run


def unrelated_prompts(asked: DataFrame, *, least: float = 0.6, enough: int = TEMPLATE, cell: int = 20_000) -> DataFrame:
    """``(template, prompts)``: over the rows ``(row_idx, template, instruction)``, how many instructions each template has any two of which are
    less alike than ``least`` by their runs of three words, as many as are found one after the other, up to ``enough``.

    A null instruction is empty. A template of more than ``cell`` rows is looked at in parts, then those found in its parts together.
    """
    asked = cut(asked.select("row_idx", "template", "instruction"))
    size = asked.groupBy("template").agg(F.count("*").alias("size"))
    cells = join_hot(asked, cut(size), ["template"], size="size", total=asked.count()).withColumn("cell", F.pmod(F.xxhash64("row_idx"), F.ceil(F.col("size") / cell)).cast("int"))
    rows = cells.select("template", "cell", "row_idx", "instruction")
    schema = "template bigint, cell int, row_idx bigint, instruction string"
    for _ in range(2):
        rows = rows.repartition("template", "cell").sortWithinPartitions("template", "cell", "row_idx").mapInArrow(_apart(enough, least), schema)
        rows = rows.withColumn("cell", F.lit(0))
    return rows.groupBy("template").agg(F.count("*").alias("prompts"))


def broken_pairs(
    df: DataFrame, model: LanguageModel, common: DataFrame, *, row_id: str = "row_idx", instruction: str = "instruction", response: str = "response"
) -> DataFrame:
    """``(row_idx, defect)`` of the pairs with a defect, each with the first that holds.

    ``empty``: null, blank or a placeholder. ``copy``: nearly nothing but the instruction's words in their order. ``other_language``: wholly in
    another language than most of the instruction, which names no such language. ``refusal``: a short answer that opens with a template put
    to ``TEMPLATE`` or more unrelated prompts whose answers are nearly all short; a refusal in words that recur less often is not told
    from an answer. ``truncated``: the last words are likelier at a cut than at a sentence's end; lists,
    tables, named fields and junk are not. A null instruction is an empty one. Templates' counts are joined by opening, hot
    ones by a broadcast of fewer than a thousand.
    """
    base = df.select(F.col(row_id).cast("bigint").alias("row_idx"), F.col(instruction).alias("instruction"), F.col(response).alias("response")).where("row_idx is not null")
    schema = "row_idx bigint, local string, natural boolean, words int, opening string, mark string, odd int, " + ", ".join(f"{k} bigint" for k in KEYS)
    read = cut(spread(base).mapInArrow(_read(model, word_list(common)), schema))
    total = read.count()
    short = read.where((F.col("words") <= SHORT) & F.col("opening").isNotNull() & F.expr(SOUND)).select("row_idx", "opening")
    templates = opening_templates(read).where((F.col("pairs") >= TEMPLATE) & (F.col("short_share") >= 0.75))
    put_off = cut(join_hot(short, cut(templates.select("opening", "template", "size")), ["opening"], size="size", total=total).select("row_idx", "template"))
    asked = base.select("row_idx", "instruction").join(put_off, "row_idx")
    usual = unrelated_prompts(asked).where(F.col("prompts") >= TEMPLATE).select("template")
    number = put_off.groupBy("template").agg(F.count("*").alias("size"))
    refused = join_hot(put_off, cut(usual.join(number, "template")), ["template"], size="size", total=total).select("row_idx", F.lit(True).alias("refused"))
    odds = F.col("odds") * F.when(F.col("mark") == "torn", TORN_PRIOR).when(F.col("mark") == "omitted", OMITTED_PRIOR).otherwise(PRIOR)
    found = read.where(F.col("k1").isNotNull() & F.col("natural") & F.col("local").isNull()).select(F.col("row_idx").alias("id"), "mark", "odd", *KEYS)
    ends = odds_of(cut(found), spread(base.select(F.col("response").alias("text")))).where(odds > 1).select(F.col("id").alias("row_idx"), F.lit(True).alias("open"))
    judged = read.select("row_idx", "local").join(refused, "row_idx", "left").join(ends, "row_idx", "left")
    defect = F.coalesce(F.when(F.col("refused"), "refusal"), "local", F.when(F.col("open"), "truncated"))
    return judged.select("row_idx", defect.alias("defect")).where("defect is not null")
