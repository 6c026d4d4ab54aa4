"""Whole runs over a few documents."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.__main__ import main
from corpusmill.config import Config, Rag, load_config
from corpusmill.operators import evaluate
from corpusmill.plans import pipeline
from corpusmill.sources import files, store

TEXTS = ["# Transformers\n\nA transformer uses attention. It reads all tokens at once.", " ", "# Retrieval\n\nRetrieval grounds answers. It reduces hallucinations by evidence."]


def documents(spark):
    return pipeline.bare_documents(spark.createDataFrame(list(enumerate(TEXTS)), "idx int, text string"))


def test_index_ask_and_regression(spark, tmp_path):
    docs = documents(spark)
    assert sorted(r.doc_id for r in docs.collect()) == ["document_0000_txt", "document_0002_txt"]
    config, out = Config(rag=Rag(chunk_size=80, chunk_overlap=0, top_k=2, retrieval_mode="hybrid", reranker_enabled=True, quality_gate_enabled=True)), str(tmp_path / "ix")
    n = pipeline.build_index(docs, config, out)
    assert n == pipeline.build_index(docs, config, out) >= 2
    index = files.load_index(spark, out)
    q = spark.createDataFrame([(0, "What reduces hallucinations?"), (1, "zzz qqq")], "qid bigint, query string")
    said = {r.qid: r for r in pipeline.ask(index, q, config, mode="rag").collect()}
    assert said[0].grounded and "evidence" in said[0].answer and said[0].sources[0].doc_id == "document_0002_txt" and not said[1].grounded
    items = spark.createDataFrame([(1, "What reduces hallucinations?", "reduces hallucinations"), (2, "What uses attention here?", "uses attention")], "eval_index int, query string, expected_substring string")
    code, said = pipeline.regression_run(index, {"auto": items, "manual": None}, config, {"auto": {"hit_rate": 1.0, "mrr": 1.0}}, out=f"file://{tmp_path}/runs")
    assert code == 0 and said["runs"][0]["metrics"]["hit_rate"] == 1.0 and said["runs"][0]["metrics"]["offline_flags"].keys() == {"HF_HUB_OFFLINE", "TRANSFORMERS_OFFLINE", "HF_DATASETS_OFFLINE"}
    low, worse = pipeline.regression_run(index, {"auto": items, "manual": items}, config, {"manual": {"hit_rate": 1.2, "mrr": 0.5}}, out=f"file://{tmp_path}/runs", tag="low")
    assert low == 1 and worse["failure_reasons"] == ["manual: hit_rate fell by 0.200000, allowed 0.000000"] and worse["runs"][0]["note"] == "no baseline"
    assert pipeline.regression_run(index, {"manual": items}, config, {"manual": {"hit_rate": 1.2, "mrr": 0.5}}, max_drop={"hit_rate": 0.2})[0] == 0
    bad, why = pipeline.regression_run(index, {"auto": items.withColumn("query", F.lit("x"))}, config, required=("auto", "manual"))
    assert bad == 1 and not why["runs"] and why["failure_reasons"] == ["item set not found: manual", "item set has errors: auto"]
    history = [json.loads(x) for x in store.read_text(spark, f"file://{tmp_path}/runs/history.jsonl").splitlines()]
    assert [h["overall_passed"] for h in history] == [True, False] and "failure: manual" in store.read_text(spark, f"file://{tmp_path}/runs/{history[1]['run_tag']}/summary.md")
    board = pipeline.ablation(docs, items, evaluate.variants(spark, ["vector", "hybrid"], [60, 80], [0], [1, 2])).collect()
    assert sorted(r.place for r in board) == list(range(1, 9)) and len({r.queries for r in board}) == 1
    grid = evaluate.variants(spark, ["vector"], [60, 80], [0], [1, 2])
    assert pipeline.ablation(docs, items, grid, max_runs=1).count() == 1 and pipeline.ablation(docs, items, grid, max_runs=3, dry_run=True).count() == 3
    assert pipeline.serving_summary(spark, out)["schema_version"] == "1.0"
    bare = pipeline.serving_summary(spark, str(tmp_path))
    assert bare["schema_version"] == "legacy" and not bare["manifest_available"] and "reembed" in bare["forbidden_steps"]
    made = files.snapshot(spark, out, {"top_k": 2}, label="first try!", stamp="20260101T000000Z")
    assert made.endswith("snapshots/20260101T000000Z__first_try_") and files.latest_snapshot(spark, out) == made
    record = store.read_json(spark, f"{made}/metadata.json")
    assert record["artifacts"]["chunks"]["chunk_count"] == n and set(record["artifacts"]) == {"chunks", "vectors", "postings", "vocabulary", "statistics", "manifest.json"}
    assert files.load_index(spark, made)["chunks"].count() == n and len(record["artifacts"]["chunks"]["sha256"][0]) == 64
    with pytest.raises(FileExistsError):
        files.snapshot(spark, out, {}, label="first try!", stamp="20260101T000000Z")
    with pytest.raises(FileNotFoundError):
        files.snapshot(spark, str(tmp_path), {})
    with pytest.raises(ValueError):
        pipeline.build_index(docs.limit(0), config, str(tmp_path / "none"))


def test_prepare(spark, tmp_path):
    rag = spark.createDataFrame([(i, None, "dolly", f"Title of record {i}", f"Record {i} says that the model reads all of its passages in order, because it was built for that purpose.", None) for i in range(12)], "row_idx bigint, id string, source string, title string, text string, tags array<string>")
    sft = spark.createDataFrame([(i, None, "dolly", f"Explain in a few words what record {i} says.", f"It says that model {i} reads all of its passages in order, because it was built for that very purpose.") for i in range(30)], "row_idx bigint, id string, source string, instruction string, response string")
    done = pipeline.prepare(spark, rag, sft, Config(), str(tmp_path))
    said = store.read_json(spark, f"{tmp_path}/splits/split_summary.json")
    assert sum(said["selected"].values()) == done["sft_splits"] and said["rows"] == 30
    assert done["rag_clean"] == 12 and done["sft_clean"] == 30 and 0 < done["sft_splits"] <= 30 and done["eval_items"] >= 1 and done["chunks"] >= 12


def test_command_line_and_config(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text(TEXTS[2])
    (tmp_path / "c.json").write_text('{"rag": {"top_k": 1}}')
    assert load_config(str(tmp_path / "c.json")).rag.top_k == 1
    with pytest.raises(ValueError):
        Config.of({"rag": {"nope": 1}})
    assert main(["index", "--data-dir", str(tmp_path / "docs"), "--artifacts-dir", str(tmp_path / "ix")]) == 0
    assert main(["ask", "What grounds answers?", "--artifacts-dir", str(tmp_path / "ix"), "--show-contexts"]) == 0
    assert "Retrieval grounds answers" in capsys.readouterr().out
    assert main(["validate", "--artifacts-dir", str(tmp_path / "ix")]) == 0 and '"chunk_count"' in capsys.readouterr().out
    assert main(["snapshot", "--artifacts-dir", str(tmp_path / "ix"), "--label", "a"]) == 0
    (tmp_path / "items.json").write_text(json.dumps([{"query": "What grounds answers?", "expected_substring": "grounds answers"}]))
    assert main(["regression", "--artifacts-dir", str(tmp_path / "ix"), "--items", f"auto={tmp_path}/items.json"]) == 0
    assert main(["regression", "--artifacts-dir", str(tmp_path / "ix")]) == 1
    with pytest.raises(FileNotFoundError):
        files.validated(spark, str(tmp_path))


def test_lists_of_parameters():
    assert evaluate.numbers_of("3, 5,3,8", "k") == [3, 5, 8] and evaluate.names_of(" a,b ,,a", "m") == ["a", "b"]
    for bad in ("", "x", "0"):
        with pytest.raises(ValueError):
            evaluate.numbers_of(bad, "k")


def test_ablation_keeps_neither_vectors_nor_postings(spark, tmp_path):
    import random
    from pathlib import Path
    from urllib.parse import urlparse

    from corpusmill.operators import chunk
    from corpusmill.plans.lineage import checkpoint_folder

    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(2000)]
    texts = ["\n\n".join(" ".join(draw.choices(words, k=70)) + "." for _ in range(8)) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    docs = chunk.document_records(spark.read.parquet(str(tmp_path / "in")), path, path)
    items = spark.createDataFrame([(i, texts[i][600:660], texts[i][600:630]) for i in range(20)], "eval_index int, query string, expected_substring string")
    size = lambda d: sum(p.stat().st_size for p in d.rglob("*") if p.is_file())
    folder = Path(urlparse(checkpoint_folder(spark)).path)
    before = size(folder)
    board = pipeline.ablation(docs, items, evaluate.variants(spark, ["vector", "hybrid"], [520, 1000], [80], [3, 8])).collect()
    assert size(folder) - before < 4 * size(tmp_path / "in")
    assert len(board) == 8 and max(r.hit_rate for r in board) == 1.0
