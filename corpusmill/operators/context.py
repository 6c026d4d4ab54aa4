"""Context blocks, prompts and answers for batches of retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from .retrieval import TOKEN, picked

BLOCK_SCHEMA = "qid bigint, rank int, doc_id string, source_path string, source_name string, title string, section string, chunk_ids array<string>, start_char int, end_char int, text string, rendered_text string"
#: What is said where no model answers (fixed values, as those in ``answers``).
SYSTEM = "You are a helpful assistant. Use the given contexts."
RETRIEVAL_ONLY = "Use retrieved contexts as evidence for the final response."


@dataclass(frozen=True)
class Assembly:
    """Limits of context assembly."""

    blocks: int = 3
    chars: int = 1800
    per_doc: int = 2
    alike: float = 0.8
    neighbours: bool = True
    chunk_size: int = 520


def _fold(limits: Assembly):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chosen, sets, used, chars = [], [], {}, 0
        for r in rows.sort_values("rank").to_dict("records"):
            if len(chosen) >= limits.blocks:
                break
            if used.get(r["doc_id"], 0) >= limits.per_doc:
                continue
            words = set(TOKEN.findall(r["text"].lower()))
            if words and any(len(words & s) >= limits.alike * len(words | s) for s in sets):
                continue
            if chosen and chars + len(r["rendered_text"]) > limits.chars:
                continue
            chosen.append(r)
            sets.append(words)
            chars += len(r["rendered_text"])
            used[r["doc_id"]] = used.get(r["doc_id"], 0) + len(r["chunk_ids"])
        out = pd.DataFrame(chosen, columns=rows.columns)
        out["rank"] = range(1, len(out) + 1)
        return out

    return run


def context_blocks(ranked: DataFrame, chunks: DataFrame, limits: Assembly = Assembly()) -> DataFrame:
    """Blocks of each query in rank order: a chunk, with the next one of its section if it ends unfinished and both are
    short enough; at most so many blocks and chunks of a document, none like one chosen before, and none that goes over the
    character limit but the first (a later, smaller one may still come).

    Texts are joined before the fold, so that what a task folds is a query's few candidates. ``chunks`` has chunk_idx and
    the columns of chunk records with ``text``.
    """
    names = ["chunk_idx", "doc_id", "source_path", "source_name", "title", "section", "chunk_id", "next_chunk_id", "start_char", "end_char", "text"]
    ranked = cut(ranked.select("qid", "chunk_idx", "rank"))
    own = cut(ranked.join(picked(chunks, ranked).select(*names), "chunk_idx"))
    follow = picked(chunks, own.select(F.col("next_chunk_id").alias("chunk_id")), "chunk_id").select(F.col("chunk_id").alias("next_chunk_id"), F.struct("doc_id", "section", "chunk_id", "start_char", "end_char", "text").alias("next"))
    rows = own.join(follow, "next_chunk_id", "left")
    text, more = T.stripped(F.col("text")), T.stripped(F.col("next.text"))
    unfinished = (text != "") & ~text.rlike(r"[.!?:`]$")
    fits = F.length("text") + F.length("next.text") <= int(1.6 * limits.chunk_size)
    takes = F.lit(limits.neighbours) & F.col("next").isNotNull() & (F.col("next.doc_id") == F.col("doc_id")) & F.col("next.section").eqNullSafe(F.col("section")) & fits & unfinished
    takes = F.coalesce(takes, F.lit(False))
    name = F.coalesce(F.when(F.col("source_name") != "", F.col("source_name")), F.col("doc_id"))
    body = F.when(takes & (more != ""), F.concat(text, F.lit("\n\n"), more)).otherwise(text)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Source: "), name), F.when(F.col("title") != "", F.concat(F.lit("Title: "), F.col("title"))),
        F.when((F.col("section") != "") & ~F.col("section").eqNullSafe(F.col("title")), F.concat(F.lit("Section: "), F.col("section"))), F.lit("Text:"), body,
    )
    ids = F.when(takes, F.array("chunk_id", "next.chunk_id")).otherwise(F.array("chunk_id"))
    start = F.when(takes, F.least("start_char", "next.start_char")).otherwise(F.col("start_char"))
    end = F.when(takes, F.greatest("end_char", "next.end_char")).otherwise(F.col("end_char"))
    ready = rows.select(
        F.col("qid").cast("bigint").alias("qid"), F.col("rank").cast("int").alias("rank"), "doc_id", "source_path", name.alias("source_name"), "title", "section", ids.alias("chunk_ids"),
        start.cast("int").alias("start_char"), end.cast("int").alias("end_char"), body.alias("text"), T.stripped(lines).alias("rendered_text"),
    )
    return ready.groupBy("qid").applyInPandas(_fold(limits), BLOCK_SCHEMA)


def prompt(query: Column, contexts: Column, system: str = SYSTEM) -> Column:
    """The prompt of a query and its array of contexts."""
    each = F.transform(contexts, lambda c, i: F.concat(F.lit("[CONTEXT "), (i + 1).cast("string"), F.lit("]\n"), T.stripped(c)))
    return F.concat(F.lit(f"[SYSTEM]\n{system}\n\n[CONTEXT]\n"), F.array_join(each, "\n\n"), F.lit("\n\n[USER]\n"), query, F.lit("\n\n[ASSISTANT]\n"))


def gathered(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, query, contexts, sources)``: each query's rendered blocks in order, and where they come from."""
    source = F.struct("rank", "doc_id", "source_path", "source_name", "title", "section", "chunk_ids", "start_char", "end_char")
    lists = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "rendered_text"))).alias("own"), F.array_sort(F.collect_list(source)).alias("sources"))
    rows = queries.select("qid", "query").join(lists, "qid", "left")
    empty = F.array().cast("array<string>")
    return rows.select("qid", "query", F.coalesce(F.transform("own", lambda x: x["rendered_text"]), empty).alias("contexts"), "sources")


def first_context(prompts: list[str]) -> list[str]:
    """A stand-in for a model: the first context's text."""
    return [p.split("Text:\n", 1)[-1].split("\n\n[", 1)[0] if "Text:\n" in p else "" for p in prompts]


def answers(blocks: DataFrame, gate: DataFrame, queries: DataFrame, *, mode: str = "retrieval_only", generate: Callable[[list[str]], list[str]] = first_context, system: str = SYSTEM) -> DataFrame:
    """A row for each query: mode, answer, contexts, whether it is grounded, why, how much evidence, sources, error.

    ``retrieval_only`` never calls the generator. ``rag`` refuses where the gate failed; where the generator raises, the answer says so.
    """
    if mode not in {"retrieval_only", "rag"}:
        raise ValueError("mode must be retrieval_only or rag")
    rows = gathered(blocks, queries).join(gate.select("qid", "sufficient", "reason"), "qid", "left")
    rows = rows.withColumn("prompt", prompt(F.col("query"), F.col("contexts"), system))
    asks = F.lit(mode == "rag") & F.coalesce("sufficient", F.lit(False))
    if mode == "rag":

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prompts = batch.column(1).to_pylist()
                try:  # all prompts of a batch at once; where one fails, each by itself
                    out = generate(prompts)
                    bad = [None] * len(prompts)
                    if len(out) != len(prompts):
                        raise ValueError("the generator must return an answer for each prompt")
                except Exception:  # noqa: BLE001
                    out, bad = [], []
                    for p in prompts:
                        try:
                            out.append(generate([p])[0])
                            bad.append(None)
                        except Exception as e:  # noqa: BLE001
                            out.append(None)
                            bad.append(str(e))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(bad, pa.string())], names=["qid", "raw", "rag_error"])

        said = rows.where(asks).select("qid", "prompt").mapInArrow(run, "qid bigint, raw string, rag_error string")
        rows = rows.join(said, "qid", "left")
    else:
        rows = rows.withColumn("raw", F.lit(None).cast("string")).withColumn("rag_error", F.lit(None).cast("string"))
    refused = F.concat(F.lit("I found only partially relevant context, so I cannot answer reliably yet. "), F.col("reason"))
    failed = F.concat(F.lit("RAG generation failed on this machine. Returning retrieval-only contexts. Error: "), F.col("rag_error"))
    answer = F.when(F.lit(mode == "retrieval_only"), RETRIEVAL_ONLY).when(~asks, refused).when(F.col("rag_error").isNotNull(), failed).otherwise(T.answer_part(F.col("raw")))
    final = F.when(asks & F.col("rag_error").isNull(), "rag").otherwise("retrieval_only")
    return rows.select("qid", final.alias("mode"), answer.alias("answer"), "contexts", F.col("sufficient").alias("grounded"), "reason", F.coalesce(F.size("sources"), F.lit(0)).alias("evidence_count"), "sources", "rag_error")
