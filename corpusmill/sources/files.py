"""Text folders, JSON lines, JSON arrays, artifacts: readers and writers."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import store

RAG_SCHEMA = "row_idx bigint, id string, source string, title string, text string, tags array<string>"
SFT_SCHEMA = "row_idx bigint, id string, source string, instruction string, response string"
EVAL_SCHEMA = "query string, expected_substring string"
#: Tasks a core in which small files are read.
TASKS = 4
#: Folders of a set of text files: more than 32, so that Spark lists them at once.
FOLDERS = 64
#: Steps of the two halves of a pipeline (fixed values of the manifest).
OFFLINE = ["prepare_datasets", "clean_processed_datasets", "chunk_documents", "build_embeddings", "build_index", "archive_artifacts", "evaluate"]
ONLINE = ["load_artifacts", "retrieve", "rerank", "quality_gate", "context_assembly", "generate", "source_attribution"]
FORBIDDEN = ["prepare_datasets", "clean_processed_datasets", "reindex", "reembed", "ablation", "evaluation"]


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a line that is none is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, in as many files as there are partitions, nulls left out."""
    df.write.mode(mode).json(path)


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """``(eval_index, query, expected_substring)`` of a JSON array in one file, with or without a byte order mark."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    items = json.loads(text.lstrip("﻿"))
    if not isinstance(items, list):
        raise ValueError("the file must hold a list")
    rows = [(i, x.get("query"), x.get("expected_substring")) for i, x in enumerate(items, 1)]
    return spark.createDataFrame(rows, "eval_index int, query string, expected_substring string")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(source_path, source_name, text)`` of all .txt and .md files below a folder that are not blank; none is an error."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").load(folder)
    rows = raw.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_name"), T.stripped(F.col("value")).alias("text")).where(F.col("text") != "")
    rows = rows.coalesce(TASKS * spark.sparkContext.defaultParallelism)  # Spark reads a few small files a task
    if rows.isEmpty():
        raise ValueError(f"no documents below {folder}")
    return rows


def write_documents(files: DataFrame, path: str) -> None:
    """Rows ``(doc_file, content)`` as text files; on request only, as many small files are slow to read. A folder that is there is an error.

    Spark's writer sets up, moves and reports each file by itself, and lists each folder as a task. Where the folder is one of the machine's file system the tasks write files
    ``doc_file={name}.txt`` into a few folders instead, each under another name until it is whole; elsewhere Spark writes a folder ``doc_file={name}`` for each.
    """
    spark = files.sparkSession
    rows, (system, where) = files.select("doc_file", "content").repartition("doc_file"), store._at(spark, path)
    place = where.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri()
    if place.getScheme() != "file":
        return rows.write.mode("error").partitionBy("doc_file").text(path)
    if system.exists(where):
        raise FileExistsError(path)
    name = F.col("doc_file").cast("string")
    shown = F.when(F.coalesce(name, F.lit("")) == "", "__HIVE_DEFAULT_PARTITION__").otherwise(F.url_encode(name))
    named = F.concat(F.pmod(F.xxhash64(name), F.lit(FOLDERS)), F.lit("/doc_file="), shown, F.lit(".txt"))
    out = rows.select(named.alias("file"), F.col("content").cast("binary").alias("content")).sortWithinPartitions("file")
    out.mapInArrow(_written(place.getPath()), "files bigint").agg(F.sum("files")).collect()
    store.write_text(spark, f"{path}/_SUCCESS", "")


def _written(root: str):
    """Write sorted rows ``(file, content)``, the rows of a file as its lines; how many files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, c or b"") for batch in batches for f, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        n = 0
        for file, lines in groupby(rows, key=lambda r: r[0]):
            folder = f"{root}/{file.split('/')[0]}"
            if not os.path.isdir(folder):
                os.makedirs(folder, exist_ok=True)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                f.writelines(c + b"\n" for _, c in lines)
            os.replace(draft, f"{root}/{file}")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return run


def stackoverflow_items(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and pairs of raw questions ``(row_idx, id, title, question, answer)``; a missing title is the question."""
    title = F.when(T.normalized(F.col("title")) != "", F.col("title")).otherwise(F.col("question"))
    rag = df.select("row_idx", "id", F.lit("stackoverflow").alias("source"), title.alias("title"), F.col("answer").alias("text"))
    return rag, df.select("row_idx", "id", F.lit("stackoverflow").alias("source"), F.col("question").alias("instruction"), F.col("answer").alias("response"))


def arxiv_items(df: DataFrame) -> DataFrame:
    """Records of raw papers ``(row_idx, id, title, abstract)``."""
    return df.select("row_idx", "id", F.lit("arxiv").alias("source"), "title", F.col("abstract").alias("text"))


def dolly_items(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and pairs of raw instructions ``(row_idx, id, instruction, context, response)``."""
    from ..operators.prepare import with_context

    rag = df.select("row_idx", "id", F.lit("dolly").alias("source"), F.col("instruction").alias("title"), F.col("response").alias("text"))
    asks = with_context(F.col("instruction"), F.col("context"))
    return rag, df.select("row_idx", "id", F.lit("dolly").alias("source"), asks.alias("instruction"), "response")


TABLES = ("chunks", "vectors", "postings", "vocabulary", "statistics")


def save_index(out: str, **tables: DataFrame | None) -> None:
    """Chunks, vectors and, for keyword search, postings, vocabulary and statistics as parquet tables below a folder."""
    if set(tables) - set(TABLES):
        raise ValueError(f"tables of an index are {TABLES}")
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{out}/{name}")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables below a folder that are there; nothing is computed again."""
    out = {}
    for name in TABLES:
        if store.exists(spark, f"{folder}/{name}"):
            out[name] = spark.read.parquet(f"{folder}/{name}")
    if not {"chunks", "vectors"} <= set(out):
        raise ValueError(f"no index in {folder}")
    return out


def legacy_chunks(texts: DataFrame) -> DataFrame:
    """Chunk records of bare texts ``(idx, text)``: one document and one chunk each."""
    doc = F.format_string("legacy_document_%04d", F.col("idx"))
    return texts.select(
        F.col("idx").alias("chunk_idx"), doc.alias("doc_id"), doc.alias("source_path"), doc.alias("source_name"), T.title_of(F.col("text"), doc).alias("title"), F.concat(doc, F.lit("__0000")).alias("chunk_id"),
        "text", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("prev_chunk_id"), F.lit(None).cast("string").alias("next_chunk_id"),
    )


def chunk_payload(rows: DataFrame) -> DataFrame:
    """Chunk records of a stored payload, of which columns may be missing or null: then a document of its own, no title, no neighbours, and the
    places of the whole text. A payload needs ``idx`` and ``text``."""
    name = F.format_string("legacy_document_%04d", F.col("idx"))
    has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    doc = F.coalesce(has("doc_id", "string"), name)
    return rows.select(
        F.col("idx").alias("chunk_idx"), doc.alias("doc_id"), F.coalesce(has("source_path", "string"), doc).alias("source_path"), F.coalesce(has("source_name", "string"), doc).alias("source_name"),
        F.coalesce(has("title", "string"), F.lit("")).alias("title"), F.coalesce(has("chunk_id", "string"), F.concat(doc, F.lit("__0000"))).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(has("start_char", "int"), F.lit(0)).alias("start_char"), F.coalesce(has("end_char", "int"), F.length(F.coalesce("text", F.lit("")))).alias("end_char"),
        has("section", "string").alias("section"), has("prev_chunk_id", "string").alias("prev_chunk_id"), has("next_chunk_id", "string").alias("next_chunk_id"),
    )


def manifest(folder: str, chunk_count: int, config: dict, *, data_dir: str = "", config_path: str = "") -> dict:
    """What a served folder holds and how it may be used."""
    return {
        "schema_version": "1.0",
        "created_at_utc": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "artifacts_dir": folder,
        "artifacts": {"index_path": f"{folder}/vectors", "chunks_path": f"{folder}/chunks", "chunk_count": chunk_count},
        "offline_pipeline": {"data_dir": data_dir, "config_path": config_path, "steps": OFFLINE},
        "online_pipeline": {"allowed_steps": ONLINE, "forbidden_steps": FORBIDDEN, "generator_loading": "lazy_on_first_rag_request"},
        "config": config,
    }


def missing_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of a served folder's parts that are not there."""
    return [n for n in ("chunks", "vectors", "manifest.json") if not store.exists(spark, f"{folder}/{n}")]


def validated(spark: SparkSession, folder: str) -> dict:
    """What a served folder holds and allows; one that lacks a part is an error."""
    if lost := missing_files(spark, folder):
        raise FileNotFoundError(f"missing below {folder}: {lost}")
    found = store.read_json(spark, f"{folder}/manifest.json")
    steps = found.get("online_pipeline", {})
    return {
        "artifacts_dir": folder, "index_exists": True, "chunks_exists": True, "manifest_exists": True, "chunk_count": found.get("artifacts", {}).get("chunk_count", 0),
        "generator_loading": steps.get("generator_loading", ""), "allowed_steps": steps.get("allowed_steps", []), "forbidden_steps": steps.get("forbidden_steps", []),
    }


def snapshot(spark: SparkSession, folder: str, config: dict, *, label: str = "manual", notes: str = "", data_dir: str = "", stamp: str | None = None) -> str:
    """Copy a served folder's parts into ``snapshots/{time}__{label}`` below it, with a record of their sizes and checksums, and point
    ``latest_snapshot.json`` to it. Returns the new folder; missing parts, or a snapshot of that name, are an error."""
    if lost := [n for n in missing_files(spark, folder) if n != "manifest.json"]:
        raise FileNotFoundError(f"missing below {folder}: {lost}")
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in label.strip())[:80] or "snapshot"
    out = f"{folder}/snapshots/{stamp}__{safe}"
    if store.exists(spark, out):
        raise FileExistsError(out)
    parts = [n for n in ("chunks", "vectors", "postings", "vocabulary", "statistics", "manifest.json") if store.exists(spark, f"{folder}/{n}")]
    for name in parts:
        store.copy(spark, f"{folder}/{name}", f"{out}/{name}")
    sums = {}
    for name in parts:
        files = checksums(spark, f"{out}/{name}").where(F.col("path").rlike(r"\.(parquet|json)$")).orderBy("path")
        rows = [r.asDict() for r in files.toLocalIterator()]  # one for each file of a table
        sums[name] = {"path": f"{out}/{name}", "size_bytes": sum(r["length"] for r in rows), "sha256": [r["sha256"] for r in rows]}
    sums["chunks"]["chunk_count"] = spark.read.parquet(f"{out}/chunks").count()
    record = {"created_at_utc": stamp, "label": safe, "notes": notes, "source": {"artifacts_dir": folder, "data_dir": data_dir}, "config": config, "artifacts": sums}
    store.write_json(spark, f"{out}/metadata.json", record)
    store.write_json(spark, f"{folder}/latest_snapshot.json", {"snapshot_dir": out})
    return out


def latest_snapshot(spark: SparkSession, folder: str) -> str:
    return store.read_json(spark, f"{folder}/latest_snapshot.json")["snapshot_dir"]


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length, sha256)`` of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_audit(samples: DataFrame, path: str) -> DataFrame:
    """Write audit samples as JSON lines, a folder for each dataset, status, source and category; returns, for each folder, ``(dataset_type, status,
    source, category, path, sample_count)``, which is also written as ``_manifest.json``."""
    keys = ["dataset_type", "status", "source_slug", "category_slug"]
    named = samples.withColumn("source_slug", T.bucket_name(F.col("source"))).withColumn("category_slug", T.bucket_name(F.col("category")))
    named.write.mode("overwrite").partitionBy(*keys).json(path)
    spark = samples.sparkSession
    place = F.concat_ws("/", F.lit(path), *(F.concat(F.lit(f"{k}="), F.col(k)) for k in keys))
    groups = spark.read.json(path).groupBy(*keys).agg(F.min("source").alias("source"), F.min("category").alias("category"), F.count("*").alias("sample_count"))
    listed = groups.select("dataset_type", "status", "source", "category", place.alias("path"), "sample_count")
    rows = [r.asDict() for r in listed.orderBy("path").toLocalIterator()]  # one for each group
    store.write_json(spark, f"{path}/_manifest.json", {"file_count": len(rows), "files": rows})
    return listed


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: list, columns: list[str]) -> str:
    """A table of a few collected rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows])
