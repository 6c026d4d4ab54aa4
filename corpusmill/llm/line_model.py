"""Estimation of the hidden Markov model of lines from all texts, and kinds of texts by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .text_kinds import SIGNS, STATES, LineModel

#: Rounds of estimation, and the share of each probability that comes from the texts; the rest stays as it was written down.
ROUNDS, LEARNT = 3, 0.5


def _expected(model: LineModel):
    """Batches of (signs, texts) to (place, amount): expected first states, moves and signs (forward and backward)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, moves, seen = (np.zeros_like(x) for x in (model.start, model.move, model.emit))
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                signs = np.frombuffer(text.encode(), np.uint8) - ord("0")
                like = model.emit[:, signs].T
                ahead = np.empty_like(like)
                ahead[0] = model.start * like[0]
                ahead[0] /= ahead[0].sum()
                for t in range(1, len(signs)):
                    ahead[t] = (ahead[t - 1] @ model.move) * like[t]
                    ahead[t] /= ahead[t].sum()
                behind = np.ones(len(STATES))
                for t in range(len(signs) - 1, -1, -1):
                    state = ahead[t] * behind
                    state /= state.sum()
                    seen[:, signs[t]] += n * state
                    if t:
                        pair = ahead[t - 1][:, None] * model.move * (like[t] * behind)
                        moves += n * pair / pair.sum()
                        behind = model.move @ (like[t] * behind)
                        behind /= behind.sum()
                    else:
                        first += n * state
        flat = np.concatenate([x.ravel() for x in (first, moves, seen)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "amount"])

    return run


def fit(signs: DataFrame, *, rounds: int = ROUNDS, learnt: float = LEARNT) -> LineModel:
    """A model from the column ``signs`` of all texts (Baum and Welch): one digit a line.

    Equal rows of signs are counted first; each round sums the expected first states, moves and signs where the rows are, and
    a hundred numbers reach the driver. Null and empty rows say nothing; without any the model stays as written down.
    """
    model = prior = LineModel()
    counts = cut(signs.where("signs <> ''").groupBy("signs").agg(F.count("*").alias("n")))
    k, m = len(STATES), len(SIGNS)
    for _ in range(rounds):
        rows = counts.mapInArrow(_expected(model), "place bigint, amount double").groupBy("place").agg(F.sum("amount").alias("amount")).collect()
        flat = np.zeros(k + k * k + k * m)
        for place, amount in rows:
            flat[place] = amount
        parts = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(k, m)
        if not parts[0].sum():
            return prior
        mixed = []
        for own, old in zip(parts, (prior.start, prior.move, prior.emit)):
            total = own.sum(axis=-1, keepdims=True)
            mixed.append(np.round(np.where(total > 0, learnt * own / np.maximum(total, 1e-300) + (1 - learnt) * old, old), 9))
        model = LineModel(*mixed)
    return model


def digits(signs: tuple[int, ...]) -> str:
    return "".join(map(str, signs))


def judged(df: DataFrame, model: LineModel) -> DataFrame:
    """``df`` with shares and kind of each row's text instead of the columns ``signs`` and ``line_words``; null without signs."""
    kept = [c for c in df.columns if c not in ("signs", "line_words")]
    names = [f"{s}_share" for s in STATES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, words = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("signs", "line_words"))
            out = [model.judge(tuple(map(int, s)), w) if s else ([0.0] * len(STATES), None) for s, w in zip(signs, words)]
            columns = [pa.array([o[0][i] for o in out], pa.float64()) for i in range(len(STATES))] + [pa.array([o[1] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *columns], names=[*kept, *names, "kind"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(run, f"{schema}, {', '.join(f'{n} double' for n in names)}, kind string")
