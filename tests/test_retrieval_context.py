"""Search, fusion, gate, context, answers, integrity, metrics and files on small literal cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import context, evaluate, integrity, retrieval
from corpusmill.sources import files

CHUNK = "chunk_idx bigint, doc_id string, source_path string, source_name string, title string, section string, chunk_id string, next_chunk_id string, start_char int, end_char int, text string"


def chunks(spark, texts, title="t"):
    rows = [(i, f"d{i}", f"p{i}", f"n{i}", title, None, f"d{i}__0000", None, 0, len(t), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, query string")


def test_nearest_is_exact_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "chunk_idx bigint, embedding array<double>").repartition(6)
    q = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in (3, 50)], "qid bigint, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for block in (1, 10):
        found = retrieval.knn(df, q, 4, block=block).orderBy("qid", "rank").collect()
        for qid in (3, 50):
            score = np.round(u @ u[qid], 9)
            assert [r.chunk_idx for r in found if r.qid == qid] == sorted(range(300), key=lambda i: (-score[i], i))[:4]
    assert retrieval.knn(df, q.where("qid < 0"), 4).count() == 0


def test_bm25_and_fusion(spark):
    c = chunks(spark, ["foobar_token is here with evidence", "generic paragraph", "foobar_token foobar_token", ""])
    p, s = retrieval.postings(c), retrieval.keyword_stats(c)
    found = retrieval.bm25(p, s, queries(spark, "foobar_token", "nothing known", ""), 5).collect()
    assert [r.chunk_idx for r in sorted(found, key=lambda r: r["rank"])] == [2, 0] and {r.qid for r in found} == {0}
    ranked = lambda ids: spark.createDataFrame([(0, i, r, 1.0) for r, i in enumerate(ids, 1)], "qid bigint, chunk_idx bigint, rank int, score double")
    fused = retrieval.fuse(ranked([0, 1, 2]), ranked([2, 0]), 3).orderBy("rank").collect()
    assert [(r.chunk_idx, round(r.score, 6)) for r in fused] == [(0, 0.032522), (2, 0.032266), (1, 0.016129)]
    tied = retrieval.fuse(ranked([5, 6]), ranked([6, 5]), 2).orderBy("rank").collect()
    assert [r.chunk_idx for r in tied] == [5, 6]


def test_rerank_and_gate(spark):
    c = chunks(spark, ["unrelated words", "RAG can reduce errors", "nothing"], title="")
    ranked = spark.createDataFrame([(0, i, i + 1, 0.0) for i in range(3)], "qid bigint, chunk_idx bigint, rank int, score double")
    q = queries(spark, "Why does RAG reduce hallucinations?", "QLoRA?")
    first = retrieval.rerank(ranked, q, c, 2).orderBy("rank").first()
    assert first.chunk_idx == 1 and first.score == 0.4
    gate = {r.qid: r for r in retrieval.quality_gate(ranked, q, c, min_score=0.35, min_coverage=0.3).collect()}
    assert gate[0].sufficient and gate[0].strong_results == 1 and not gate[1].sufficient and gate[1].reason == "No contexts were retrieved."
    weak = retrieval.quality_gate(ranked, q, c, min_score=0.35, min_coverage=0.9).where("qid = 0").first()
    assert weak.reason == "Retrieved context only partially overlaps with the question."
    assert retrieval.candidate_count(5, hybrid=True, rerank=True) == 20 and retrieval.candidate_count(5, hybrid=True, rerank=False) == 15


def test_modes(spark):
    c = chunks(spark, ["apples and pears", "rockets and planes", "pears"])
    for mode in ("vector", "hybrid"):
        assert retrieval.retrieve(c, queries(spark, "pears"), top_k=1, mode=mode, reranked=True).first().chunk_idx in (0, 2)
    with pytest.raises(ValueError):
        retrieval.retrieve(c, queries(spark, "x"), top_k=1, mode="other")


def test_blocks(spark):
    rows = [
        (0, "d", "p", "n", "T", "S", "d__0000", "d__0001", 0, 20, "unfinished sentence here"), (1, "d", "p", "n", "T", "S", "d__0001", None, 20, 40, "its end."),
        (2, "e", "p", "", "T", "T", "e__0000", None, 0, 5, "other words entirely."), (3, "f", "p", "n", "T", None, "f__0000", None, 0, 5, "other words entirely."),
        (4, "g", "p", "n", "T", None, "g__0000", None, 0, 5, "long " * 100 + "."), (5, "h", "p", "n", "T", None, "h__0000", None, 0, 5, "brief."),
    ]
    c = spark.createDataFrame(rows, CHUNK)
    ranked = spark.createDataFrame([(0, i, r, 0.0) for r, i in enumerate([0, 1, 2, 3, 4, 5], 1)], "qid bigint, chunk_idx bigint, rank int, score double")
    found = context.context_blocks(ranked, c, context.Assembly(blocks=5, chars=300, per_doc=2)).orderBy("rank").collect()
    assert [r.doc_id for r in found] == ["d", "e", "h"] and found[0].chunk_ids == ["d__0000", "d__0001"] and (found[0].start_char, found[0].end_char) == (0, 40)
    assert found[0].rendered_text == "Source: n\nTitle: T\nSection: S\nText:\nunfinished sentence here\n\nits end." and found[1].source_name == "e" and "Section" not in found[1].rendered_text
    one = context.context_blocks(ranked.where("chunk_idx in (4, 5)"), c, context.Assembly(chars=10)).collect()
    assert [r.doc_id for r in one] == ["g"]


def test_answers(spark):
    c = chunks(spark, ["grounded text."])
    ranked = spark.createDataFrame([(0, 0, 1, 1.0)], "qid bigint, chunk_idx bigint, rank int, score double")
    q = queries(spark, "grounded text", "other")
    gate, blocks = retrieval.quality_gate(ranked, q, c), context.context_blocks(ranked, c)
    calm = {r.qid: r for r in context.answers(blocks, gate, q).collect()}
    assert calm[0].answer == context.RETRIEVAL_ONLY and calm[0].evidence_count == 1 and calm[1].contexts == []
    said = {r.qid: r for r in context.answers(blocks, gate, q, mode="rag", generate=lambda p: ["x [ASSISTANT]\nGrounded answer"]).collect()}
    assert said[0].answer == "Grounded answer" and said[0].mode == "rag" and said[1].mode == "retrieval_only" and said[1].answer.endswith("No contexts were retrieved.")

    def broken(prompts):
        raise RuntimeError("no model")

    bad = context.answers(blocks, gate, q, mode="rag", generate=broken).where("qid = 0").first()
    assert bad.rag_error == "no model" and bad.mode == "retrieval_only"
    empty = spark.range(1).select(context.prompt(F.lit("Q"), F.array().cast("array<string>")).alias("p")).first().p
    assert "[CONTEXT]\n\n\n[USER]\nQ" in empty


EVAL = "eval_index int, query string, expected_substring string"


def test_integrity(spark):
    items = spark.createDataFrame([(1, "What is a transformer model?", "attention is all you need"), (2, "Clean question", "clean words"), (3, None, None)], EVAL)
    sft = spark.createDataFrame([(0, "other", "text"), (1, "what is a  TRANSFORMER model?", "some answer"), (2, "x", "indeed Attention is all\nyou need here")], "row_idx bigint, instruction string, response string")
    found = integrity.sft_leakage(sft, items).collect()
    assert [(r.eval_index, r.row_idx, r.exact_query_match, r.expected_in_response) for r in found] == [(1, 1, True, False)]
    near = spark.createDataFrame([(0, "What is a transformer model", "attention is all you need.")], "row_idx bigint, instruction string, response string")
    assert integrity.sft_leakage(near, items).first().near_duplicate_pair
    rag = spark.createDataFrame([(5, "What is a transformer model", "attention is all you need"), (6, None, None)], "row_idx bigint, title string, text string")
    hit = integrity.rag_leakage(rag, items).collect()
    assert [(r.eval_index, r.row_idx, r.expected_in_rag_text) for r in hit] == [(1, 5, True)]
    other = spark.createDataFrame([(9, "WHAT is a transformer model?", "y")], EVAL)
    assert integrity.eval_leakage(items, other).first().duplicate_query
    clean = integrity.split_integrity(sft.where("row_idx = 0"), None, items, None).collect()
    assert len(clean) == 3 and not any(r.matches for r in clean)
    assert integrity.ratio("abcd", "bcde") == 0.75 and integrity.ratio("", "a") == 0.0


def test_validation_and_metrics(spark):
    items = spark.createDataFrame([(1, "Hi", "ok"), (2, "hi ", "ok")], EVAL)
    assert sorted(r.error for r in evaluate.eval_errors(items, query_chars=5, expected_chars=5).collect()) == ["duplicate_query", "short_expected", "short_expected", "short_query", "short_query"]
    assert tuple(evaluate.eval_summary(items.limit(0)).first()) == (0, 0, 1)
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 2)], "qid bigint, hit_rank int")
    assert tuple(evaluate.metrics(ranks, 3).first()) == (3, 4, 2, 0.5, 0.375)
    grid = evaluate.variants(spark, ["vector"], [100], [20, 100], [5]).collect()
    assert len(grid) == 1
    with pytest.raises(ValueError):
        evaluate.variants(spark, ["vector"], [100], [100], [5])
    row = lambda h, m: spark.createDataFrame([(h, m)], "hit_rate double, mrr double")
    assert all(r.passed for r in evaluate.regression(row(0.325, 0.3), row(0.33, 0.3)).collect())
    assert [r.passed for r in evaluate.regression(row(0.29, 0.2), row(0.33, 0.3)).collect()] == [False, False]


def test_files(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a.txt").write_text("# Title\nbody")
    (tmp_path / "docs/sub/b.md").write_text("text")
    (tmp_path / "docs/c.csv").write_text("no")
    (tmp_path / "docs/d.txt").write_text("  ")
    assert sorted(r.source_name for r in files.read_documents(spark, str(tmp_path / "docs")).collect()) == ["a.txt", "b.md"]
    (tmp_path / "e.json").write_text("﻿" + json.dumps([{"query": "q", "expected_substring": "e"}]), encoding="utf-8")
    assert tuple(files.read_eval_items(spark, str(tmp_path / "e.json")).first()) == (1, "q", "e")
    (tmp_path / "f.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_eval_items(spark, str(tmp_path / "f.json"))
    rows = spark.createDataFrame([(1, "é", None)], "row_idx bigint, id string, source string")
    files.write_json_lines(rows, str(tmp_path / "out"))
    assert files.read_json_lines(spark, str(tmp_path / "out"), "row_idx bigint, id string, source string").first().id == "é"
    c = chunks(spark, ["a"])
    files.save_index(str(tmp_path / "ix"), chunks=c, vectors=retrieval.embed(c, "chunk_idx", "text"))
    assert set(files.load_index(spark, str(tmp_path / "ix"))) == {"chunks", "vectors"}
    with pytest.raises(ValueError):
        files.load_index(spark, str(tmp_path / "none"))
    assert files.missing_files(spark, str(tmp_path / "ix")) == ["manifest.json"]
    assert files.checksums(spark, str(tmp_path / "docs")).count() == 4
    assert files.legacy_chunks(spark.createDataFrame([(3, "x")], "idx int, text string")).first().chunk_id == "legacy_document_0003__0000"


def test_stream_of_questions(spark, tmp_path):
    from corpusmill.streaming.answers import answer_stream

    queries(spark, "pears", "planes").write.parquet(str(tmp_path / "in"))
    c = chunks(spark, ["apples and pears", "rockets and planes"])
    stream = spark.readStream.schema("qid bigint, query string").parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda b: retrieval.retrieve(c, b, top_k=1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.qid, r.chunk_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 0), (1, 1)}


def test_both_ways_of_bm25_agree(spark):
    texts = ["apples and pears and plums", "rockets and planes", "pears", "", None, "the plums of the pears"]
    c = spark.createDataFrame([(i, "", None, t) for i, t in enumerate(texts)], "chunk_idx bigint, title string, section string, text string")
    q = queries(spark, "pears and plums", "rockets", "nothing here", "")
    p, s = retrieval.postings(c), retrieval.keyword_stats(c)
    truth = sorted(map(tuple, retrieval.bm25(p, s, q, 3).collect()))
    assert truth and truth == sorted(map(tuple, retrieval.bm25_scan(c, q, 3).collect()))
    assert truth == sorted(map(tuple, retrieval.bm25(p, s, q, 3, words=retrieval.vocabulary(p, s), block=2).collect())) == sorted(map(tuple, retrieval.bm25_scan(c, q, 3, block=1).collect()))
    assert retrieval.bm25_scan(c.limit(0), q, 3).count() == 0 and retrieval.bm25_scan(c, q.limit(0), 3).count() == 0


def test_chunk_payload(spark):
    rows = files.chunk_payload(spark.createDataFrame([(0, "ab", "d1", None), (1, None, None, 5)], "idx int, text string, doc_id string, start_char int")).orderBy("chunk_idx").collect()
    assert (rows[0].doc_id, rows[0].chunk_id, rows[0].end_char, rows[0].title) == ("d1", "d1__0000", 2, "") and (rows[1].source_name, rows[1].start_char, rows[1].text) == ("legacy_document_0001", 5, "")


def test_generator_gets_whole_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def generate(prompts):
        sizes.add(1)
        if any("Bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["[ASSISTANT] fine" for _ in prompts]

    def ask(*texts):
        q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid bigint, query string").coalesce(1)
        gate = q.select("qid", F.lit(True).alias("sufficient"), F.lit("").alias("reason"))
        return {r.qid: (r.answer, r.rag_error) for r in context.answers(spark.createDataFrame([], context.BLOCK_SCHEMA), gate, q, mode="rag", generate=generate).collect()}

    assert ask("a", "b", "c") == {i: ("fine", None) for i in range(3)}
    found = ask("a", "Bad")
    assert found[0] == ("fine", None) and found[1][1] == "no"


def test_what_search_over_chunks_writes_stays_below_its_input(spark, tmp_path):
    import random
    from pathlib import Path
    from urllib.parse import urlparse

    from corpusmill.operators import chunk
    from corpusmill.plans import pipeline
    from corpusmill.plans.lineage import checkpoint_folder

    draw = random.Random(3)
    words = ["the", "of", "and", *("".join(draw.choices("abcdefghij", k=6)) for _ in range(3000))]
    texts = ["\n\n".join(" ".join(draw.choices(words, [300] * 3 + [1] * 3000, k=70)) + "." for _ in range(8)) for _ in range(1500)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / "in"))
    raw, folder = spark.read.parquet(str(tmp_path / "in")), Path(urlparse(checkpoint_folder(spark)).path)
    size = lambda d: sum(p.stat().st_size for p in d.rglob("*") if p.is_file())
    before = size(folder)
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    c = pipeline.numbered_chunks(chunk.document_records(raw, path, path), 520, 80)
    q = queries(spark, *(f"the {a} of {b} and {d}" for a, b, d in zip(words[3:40], words[50:], words[100:])))
    found = retrieval.retrieve(c, q, top_k=5, mode="hybrid", reranked=True)
    assert context.context_blocks(found, c).select("qid").distinct().count() == 37
    assert size(folder) - before < size(tmp_path / "in")
    order = [(r.doc_id, r.pos) for r in c.orderBy("chunk_idx").collect()]
    assert [r.chunk_idx for r in c.select("chunk_idx").orderBy("chunk_idx").collect()] == list(range(len(order))) and order == sorted(order, key=lambda x: (x[0] + "|", x[1]))


def test_scan_takes_rare_and_frequent_words_alike(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(1, 1 + i % 9)) for i in range(120)]
    c, q = chunks(spark, texts), queries(spark, "w1 w2 w2 w3", "w0 w5 w22 zzz", "w7", "zzz")
    truth = sorted(map(tuple, retrieval.bm25(retrieval.postings(c), retrieval.keyword_stats(c), q, 7).collect()))
    for heads in (0, 2, 256):
        monkeypatch.setattr(retrieval, "HEADS", heads)
        assert truth == sorted(map(tuple, retrieval.bm25_scan(c, q, 7).collect())) and len(truth) == 21


def test_text_files_lie_in_few_folders_and_are_read_by_few_tasks(spark, tmp_path):
    rows = [(f"doc_{i}", f" text {i}\n") for i in range(150)] + [("_a/b c.é", "odd"), (".x", "hidden"), (None, "nameless"), ("none", None), ("two", "first"), ("two", "second")]
    df = spark.createDataFrame(rows, "doc_file string, content string").repartition(8)
    files.write_documents(df, str(tmp_path / "out"))
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_dir()]) <= files.FOLDERS < 150
    found = files.read_documents(spark, str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() <= files.TASKS * spark.sparkContext.defaultParallelism
    texts = {r.source_name: r.text for r in found.collect()}
    assert len(texts) == 154 and texts["doc_file=doc_7.txt"] == "text 7" and {"odd", "hidden", "nameless"} <= set(texts.values())
    assert sorted(texts["doc_file=two.txt"].split("\n")) == ["first", "second"]
    with pytest.raises(FileExistsError):
        files.write_documents(df, str(tmp_path / "out"))
