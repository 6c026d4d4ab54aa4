"""Whole runs: index, answers, ablation, regression, preparation to splits."""

from __future__ import annotations

import os
from dataclasses import asdict
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Rag
from ..functions import text as T
from ..operators import chunk, clean, context, evaluate, retrieval, split
from ..sources import files, store
from .lineage import cut, stored

STAGES = ("clean", "split", "eval", "index")


def bare_documents(texts: DataFrame) -> DataFrame:
    """Document records of bare texts ``(idx, text)``, named document_0000.txt and so on; blank ones use up their number."""
    name = F.format_string("document_%04d.txt", F.col("idx"))
    return chunk.document_records(texts.withColumn("_name", name), F.col("_name"), F.col("_name"))


def numbered_chunks(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunk records with ``chunk_idx``, their number in the order of documents and places, and ``text``; stored, so nothing is chunked again.

    Documents are sorted by range and chunked where they then are, so each task's chunks are in order; only the number of chunks of each task goes through a single one.
    """
    placed = documents.withColumn("_place", F.concat(F.col("doc_id").cast("string"), F.lit("|"))).repartitionByRange("_place", "source_path").sortWithinPartitions("_place", "source_path")
    rows = stored(chunk.chunk_records(placed, size, overlap).withColumnRenamed("chunk_text", "text").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)  # where a task's own numbers begin
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"), F.min("_id").alias("_first"))
    before = cut(sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size") - F.col("_first")).alias("_shift")))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("chunk_idx", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def build_index(documents: DataFrame, config: Config, out: str, *, rebuild: bool = False, embedder: retrieval.Embedder | None = None) -> int:
    """Write chunks, vectors and, for hybrid search, postings of document records; the number of chunks. An index that is there is
    kept unless it shall be rebuilt; no chunks are an error."""
    spark = documents.sparkSession
    try:
        if not rebuild:
            return files.load_index(spark, out)["chunks"].count()
    except ValueError:
        pass
    rows = numbered_chunks(documents, config.rag.chunk_size, config.rag.chunk_overlap)
    n = rows.count()
    if not n:
        raise ValueError("no chunks to index")
    files.save_index(out, chunks=rows, vectors=retrieval.embed(rows, "chunk_idx", "text", embedder))
    if config.rag.retrieval_mode == "hybrid":
        files.save_index(out, postings=retrieval.postings(rows), statistics=retrieval.keyword_stats(rows))
        stored = files.load_index(spark, out)
        files.save_index(out, vocabulary=retrieval.vocabulary(stored["postings"], stored["statistics"]))
    store.write_json(spark, f"{out}/manifest.json", files.manifest(out, n, asdict(config.rag) | {"embedding_model": config.embeddings.name, "generator_model": config.model.name}))
    return n


def _candidates(rag: Rag) -> int:
    return retrieval.candidate_count(rag.top_k, hybrid=rag.retrieval_mode == "hybrid", rerank=rag.reranker_enabled, configured=rag.reranker_candidate_k)


def find(index: dict[str, DataFrame], queries: DataFrame, rag: Rag, embedder: retrieval.Embedder | None = None, near: DataFrame | None = None) -> DataFrame:
    """``(qid, chunk_idx, rank, score)`` over the tables of an index; nothing of it is computed again. Without postings the chunks' texts are
    scanned. ``near`` are the nearest vectors where they are known, as many as wanted or more."""
    hybrid = rag.retrieval_mode == "hybrid"
    n = _candidates(rag)
    found = near.where(F.col("rank") <= n) if near is not None else retrieval.knn(index["vectors"], retrieval.embed(queries, "qid", "query", embedder), n)
    if hybrid:
        if "postings" in index:
            stats = index["statistics"] if "statistics" in index else retrieval.keyword_stats(index["chunks"])
            words = retrieval.bm25(index["postings"], stats, queries, n, words=index.get("vocabulary"))
        else:
            words = retrieval.bm25_scan(index["chunks"], queries, n)
        found = retrieval.fuse(found, words, n, rrf_k=rag.rrf_k)
    return retrieval.rerank(found, queries, index["chunks"], rag.top_k) if rag.reranker_enabled else found.where(F.col("rank") <= rag.top_k)


def ask(index: dict[str, DataFrame], queries: DataFrame, config: Config, *, mode: str = "retrieval_only", generate=context.first_context) -> DataFrame:
    """Answers of ``queries(qid, query)`` from an index, as ``operators.context.answers``."""
    rag, chunks = config.rag, index["chunks"]
    found = cut(find(index, queries, rag))
    gate = retrieval.quality_gate(found, queries, chunks, min_score=rag.quality_gate_min_score, min_coverage=rag.quality_gate_min_coverage, min_strong=rag.quality_gate_min_strong_results, enabled=rag.quality_gate_enabled)
    limits = context.Assembly(rag.context_max_blocks, rag.context_max_chars, rag.context_max_chunks_per_doc, rag.context_dedup_threshold, rag.context_expand_neighbors, rag.chunk_size)
    return context.answers(context.context_blocks(found, chunks, limits), gate, queries, mode=mode, generate=generate)


def serving_summary(spark: SparkSession, folder: str) -> dict:
    """What may be done with a served folder, from its manifest or, without one, the fixed values of a folder of an older kind."""
    there = store.exists(spark, f"{folder}/manifest.json")
    found = store.read_json(spark, f"{folder}/manifest.json") if there else {"schema_version": "legacy", "online_pipeline": files.manifest(folder, 0, {})["online_pipeline"]}
    return {"pipeline_role": "online", "artifacts_dir": folder, "manifest_available": there, "schema_version": found["schema_version"], **found["online_pipeline"]}


def _queries(items: DataFrame) -> DataFrame:
    return items.select(F.col("eval_index").cast("bigint").alias("qid"), "query")


def evaluated(index: dict[str, DataFrame], items: DataFrame, rag: Rag, ks: list[int], near: DataFrame | None = None) -> DataFrame:
    """Metrics at some depths of the items ``(eval_index, query, expected_substring)``; ``near`` as in ``find``."""
    deep = Rag(**(asdict(rag) | {"top_k": max(ks)}))
    ranks = cut(evaluate.hit_ranks(find(index, _queries(items), deep, near=near), index["chunks"], items.withColumn("eval_index", F.col("eval_index").cast("bigint"))))
    return reduce(DataFrame.unionByName, [evaluate.metrics(ranks, k) for k in ks])


def ablation(documents: DataFrame, items: DataFrame, grid: DataFrame, base: Rag | None = None, *, max_runs: int = 0, dry_run: bool = False) -> DataFrame:
    """The leaderboard of a grid of variants, of the first ``max_runs`` if that is positive; a dry run only returns the variants. Chunks are made once for each
    size and overlap, and their vectors, which are not kept, searched once for all modes at the greatest depth."""
    if max_runs > 0:
        grid = grid.orderBy("ordinal").limit(max_runs)
    if dry_run:
        return grid
    base, rows, parts = base or Rag(), grid.orderBy("ordinal").collect(), []
    for size, overlap in dict.fromkeys((r.chunk_size, r.chunk_overlap) for r in rows):
        chunks = numbered_chunks(documents, size, overlap)
        index = {"chunks": chunks, "vectors": retrieval.embed(chunks, "chunk_idx", "text")}
        own = [r for r in rows if (r.chunk_size, r.chunk_overlap) == (size, overlap)]
        most = max(_candidates(Rag(**(asdict(base) | {"retrieval_mode": r.retrieval_mode, "top_k": r.top_k}))) for r in own)
        near = cut(retrieval.knn(index["vectors"], retrieval.embed(_queries(items), "qid", "query"), most))
        for mode in dict.fromkeys(r.retrieval_mode for r in own):
            rag = Rag(**(asdict(base) | {"retrieval_mode": mode, "chunk_size": size, "chunk_overlap": overlap}))
            found = evaluated(index, items, rag, [r.top_k for r in own if r.retrieval_mode == mode], near)
            parts.append(found.select(F.lit(mode).alias("retrieval_mode"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), "top_k", "queries", "hits", "hit_rate", "mrr"))
    results = reduce(DataFrame.unionByName, parts)
    return evaluate.leaderboard(grid.join(results, ["retrieval_mode", "chunk_size", "chunk_overlap", "top_k"]))


def metrics_record(metrics, config: Config, *, tag: str = "", snapshot_label: str = "", artifacts_dir: str = "", eval_file: str = "") -> dict:
    """One row of metrics with what it was measured with: names, search parameters, flags of the environment that keep models offline."""
    flags = ("HF_HUB_OFFLINE", "TRANSFORMERS_OFFLINE", "HF_DATASETS_OFFLINE")
    row = metrics.asDict()
    return {
        "created_at_utc": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "tag": tag, "snapshot_label": snapshot_label, "artifacts_dir": artifacts_dir, "eval_file": eval_file,
        "embedding_model": config.embeddings.name, **{k: v for k, v in asdict(config.rag).items() if k != "rrf_k"}, **{k: row[k] for k in ("top_k", "queries", "hits", "hit_rate", "mrr")},
        "offline_flags": {f: os.environ.get(f, "") for f in flags},
    }


def regression_run(
    index: dict[str, DataFrame], item_sets: dict[str, DataFrame | None], config: Config, baselines: dict[str, dict] | None = None, *, out: str | None = None,
    required: tuple[str, ...] = (), max_drop: dict[str, float] | None = None, tag: str = "regression", query_chars: int = 8, expected_chars: int = 8,
) -> tuple[int, dict]:
    """Exit code (0 or 1) and summary of some named item sets: each is validated, measured and held against its baseline ``{hit_rate, mrr}``.

    A required set that is missing, or any set with errors, fails the run before anything is measured. A drop of more than ``max_drop`` of a
    metric (nothing by default) fails it; a set without a baseline passes with a note. ``out`` gets each set's metrics,
    the summary as JSON and Markdown, and a line in ``history.jsonl``.
    """
    spark, drop = index["chunks"].sparkSession, {"hit_rate": 0.0, "mrr": 0.0} | (max_drop or {})
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    summary: dict = {"created_at_utc": stamp, "run_tag": f"{tag}_{stamp}", "overall_passed": False, "eval_validation": [], "runs": [], "failure_reasons": []}
    given = {n: s for n, s in item_sets.items() if s is not None}
    summary["failure_reasons"] += [f"item set not found: {n}" for n in required if n not in given]
    for name, items in given.items():
        limits = dict(query_chars=query_chars, expected_chars=expected_chars)
        totals = evaluate.eval_summary(items, **limits).first().asDict()
        errors = [r.asDict() for r in evaluate.eval_errors(items, **limits).orderBy("eval_index", "error").toLocalIterator()] if totals["errors"] else []
        summary["eval_validation"].append({"name": name, "summary": totals, "errors": errors, "valid": not totals["errors"]})
        if totals["errors"]:
            summary["failure_reasons"].append(f"item set has errors: {name}")
    if not summary["failure_reasons"]:
        for name, items in given.items():
            record = metrics_record(evaluated(index, items, config.rag, [config.rag.top_k]).first(), config, tag=f"{tag}_{name}", eval_file=name)
            base = (baselines or {}).get(name)
            checks = []
            for metric in ("hit_rate", "mrr") if base else ():
                delta = round(record[metric] - base[metric], 6)
                checks.append({"metric": metric, "current": record[metric], "baseline": base[metric], "delta": delta, "max_drop": drop[metric], "passed": delta >= -drop[metric]})
            reasons = [f"{name}: {c['metric']} fell by {-c['delta']:.6f}, allowed {c['max_drop']:.6f}" for c in checks if not c["passed"]]
            summary["runs"].append({"name": name, "metrics": record, "checks": checks, "passed": not reasons, "note": "" if base else "no baseline"})
            summary["failure_reasons"] += reasons
    summary["overall_passed"] = not summary["failure_reasons"]
    if out:
        folder = f"{out}/{summary['run_tag']}"
        for run in summary["runs"]:
            store.write_json(spark, f"{folder}/metrics/{run['name']}.json", run["metrics"])
        store.write_json(spark, f"{folder}/summary.json", summary)
        store.write_text(spark, f"{folder}/summary.md", regression_markdown(summary))
        store.append_line(spark, f"{out}/history.jsonl", summary)
    return int(not summary["overall_passed"]), summary


def regression_markdown(summary: dict) -> str:
    """The summary of a regression run for people."""
    lines = [f"# Regression run {summary['run_tag']}", "", f"passed: {summary['overall_passed']}", ""]
    lines += [files.markdown([{"set": v["name"], **v["summary"]} for v in summary["eval_validation"]], ["set", "items", "unique_queries", "errors"]), ""] if summary["eval_validation"] else []
    rows = [{"set": r["name"], **c} for r in summary["runs"] for c in r["checks"]]
    lines += [files.markdown(rows, ["set", "metric", "current", "baseline", "delta", "passed"]), ""] if rows else []
    lines += [f"- {r['name']}: {r['note']}" for r in summary["runs"] if r["note"]] + [f"- failure: {r}" for r in summary["failure_reasons"]]
    return "\n".join(lines).strip() + "\n"


def write_splits(assigned: DataFrame, out: str, *, seed: int = 42) -> dict:
    """Write the selected rows of each split as JSON lines below ``out``, and a summary of rows per split, source and bucket, which is returned."""
    spark, folders = assigned.sparkSession, {"train": "sft_train", "dev": "sft_dev", "eval": "sft_eval_holdout"}
    assigned = cut(assigned)
    for name, folder in folders.items():
        files.write_json_lines(assigned.where((F.col("split") == name) & F.col("selected")).drop("selected"), f"{out}/{folder}", "overwrite")
    counts = [r.asDict() for r in split.split_summary(assigned).orderBy("split", "source", "quality_bucket").toLocalIterator()]
    totals = {n: sum(r["selected_rows"] for r in counts if r["split"] == n) for n in folders}
    summary = {"seed": seed, "rows": sum(r["rows"] for r in counts), "selected": totals, "paths": {n: f"{out}/{f}" for n, f in folders.items()}, "strata": counts}
    store.write_json(spark, f"{out}/split_summary.json", summary)
    return summary


def prepare(spark: SparkSession, rag: DataFrame, sft: DataFrame, config: Config, out: str, stages: tuple[str, ...] = STAGES) -> dict[str, int]:
    """Clean, split, make evaluation items and index, each stage a table below ``out``; the number of rows of each."""
    done: dict[str, int] = {}

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        saved = spark.read.parquet(f"{out}/{name}")
        done[name] = saved.count()
        return saved

    if "clean" in stages:
        write("rag_clean", clean.kept(clean.clean_rag(rag), "rag"))
        write("sft_clean", clean.kept(clean.clean_sft(sft), "sft"))
    if "split" in stages:
        assigned = cut(split.assign_splits(spark.read.parquet(f"{out}/sft_clean"), seed=config.project.seed))
        write_splits(assigned, f"{out}/splits", seed=config.project.seed)
        write("sft_splits", assigned.where("selected").drop("selected"))
    if "eval" in stages:
        write("eval_items", split.auto_eval(spark.read.parquet(f"{out}/sft_splits").where("split = 'eval'"), seed=config.project.seed))
    if "index" in stages:
        records = spark.read.parquet(f"{out}/rag_clean")
        path = F.concat(F.lit("record_"), F.col("row_idx").cast("string"))
        docs = chunk.document_records(records.withColumn("text", T.merged(F.col("title"), F.col("text"))), path, F.col("source"))
        done["chunks"] = build_index(docs, config, f"{out}/index", rebuild=True)
    return done
