"""The queries of the core by name, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Rag
from .functions import text as T
from .operators import chunk, clean, context, evaluate, integrity, prepare, profile, retrieval, split
from .plans import pipeline
from .plans import sql as S
from .plans.lineage import cut, scratch
from .sources import files, store
from .sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LIMITS = clean.Limits(non_ascii=0.08)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rag(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "rag_corpus"))


def sft(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "sft_instructions"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_item")


def _cleaned(spark: SparkSession, d: str, which: str) -> DataFrame:
    return clean.clean_rag(rag(spark, d), LIMITS) if which == "rag" else clean.clean_sft(sft(spark, d), LIMITS)


def _verdicts(spark: SparkSession, d: str, which: str) -> DataFrame:
    """What cleaning says of each row, without its texts."""
    return clean.rag_verdicts(rag(spark, d), LIMITS) if which == "rag" else clean.sft_verdicts(sft(spark, d), LIMITS)


# Text functions


@query(S.TEXT_FUNCTIONS)
def text_functions(spark, d):
    """Scalar functions over every record."""
    t, n = F.col("text"), F.col("title")
    return rag(spark, d).select(
        "row_idx", F.length(T.normalized(t)).alias("norm_length"), F.round(T.non_ascii_ratio(T.normalized(t)), 9).alias("non_ascii"), T.word_count(T.normalized(t)).cast("bigint").alias("words"),
        F.size(T.token_set(t)).alias("distinct_words"), T.preview(t).alias("preview"), T.bucket_name(F.col("source")).alias("bucket"), T.doc_key(F.col("id")).alias("doc_key"),
        T.source_bucket(F.col("source")).alias("source_bucket"), T.on_topic(T.normalized(t)).alias("on_topic"), F.md5(T.normalized(T.merged(n, t))).alias("merged_md5"),
    )


@query(S.SNIPPETS)
def snippets(spark, d):
    """The expected snippet of every response."""
    return sft(spark, d).select("row_idx", T.snippet(F.col("response"), 30, 140).alias("snippet"))


@query(S.TITLES)
def document_titles(spark, d):
    """Title, section and heading flag of every document."""
    t = F.col("text")
    return spread(table(spark, d, "documents")).select("doc_id", T.title_of(t, F.lit("untitled")).alias("doc_title"), T.section_of(t).alias("section"), T.is_heading(t).alias("heading"))


@query(S.TEXT_MORE)
def text_functions_more(spark, d):
    """Labels, lists, trigrams, prefixes and the pattern that finds nothing in usual text."""
    both = F.concat(F.coalesce("source", F.lit("")), F.lit(","), F.coalesce("lang", F.lit("")))
    return rag(spark, d).select(
        "row_idx", T.run_label(F.col("title")).alias("run_label"), F.array_join(T.split_list(both), "|").alias("items"), F.size(F.array_distinct(T.trigrams(F.col("title")))).alias("distinct_trigrams"),
        T.prefixed(F.col("title"), "intfloat/e5-base", "query").alias("prefixed"), F.size(T.tokens(F.col("title"), "literal_backslash_w")).alias("literal_tokens"),
    )


@query(S.ANSWER_PARTS)
def answer_parts(spark, d):
    """What a model said, found again in a whole dialogue."""
    said = F.concat(F.lit("[SYSTEM]\nx [ASSISTANT] y\n[USER] z\n[ASSISTANT]\n"), F.coalesce("response", F.lit("")), F.lit("\n[USER]\nmore"))
    return sft(spark, d).select("row_idx", T.answer_part(said).alias("answer"))


# Preparation


@query(S.CONVERSATIONS)
def conversation_items(spark, d):
    """Records of all roles and pairs of a table of messages."""
    own, pairs = prepare.conversation_items(spread(table(spark, d, "message")))
    own = own.select(F.lit("rag").alias("kind"), "row_idx", "id", F.md5("text").alias("text_md5"))
    return own.unionByName(pairs.select(F.lit("sft").alias("kind"), "row_idx", "id", F.md5(F.concat("instruction", F.lit("|"), "response")).alias("text_md5")))


@query(S.RAW_SOURCES)
def raw_sources(spark, d):
    """Records and pairs out of the three raw layouts."""
    r, p = rag(spark, d), sft(spark, d)
    stack, _ = files.stackoverflow_items(r.select("row_idx", "id", "title", F.col("source").alias("question"), F.col("text").alias("answer")))
    papers = files.arxiv_items(r.select("row_idx", "id", "title", F.col("text").alias("abstract")))
    _, dolly = files.dolly_items(p.select("row_idx", "id", "instruction", F.col("source").alias("context"), "response"))
    rows = [x.select("source", "row_idx", F.col("title").alias("head"), F.md5("text").alias("body_md5")) for x in (stack, papers)]
    rows.append(dolly.select("source", "row_idx", F.col("instruction").alias("head"), F.md5("response").alias("body_md5")))
    return reduce(DataFrame.unionByName, rows)


# Files


@query(S.JSON_LINES)
def json_lines_roundtrip(spark, d):
    """Records written as JSON lines and read again."""
    path = scratch(spark)
    files.write_json_lines(rag(spark, d).select("row_idx", "id", "source", "title", "text", "tags"), path)
    rows = files.read_json_lines(spark, path, files.RAG_SCHEMA)
    return rows.select("row_idx", "id", "source", "title", F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"))


@query(S.EVAL_FILE)
def eval_file_roundtrip(spark, d):
    """Evaluation items written as one JSON array and read again."""
    path = f"{scratch(spark)}/items.json"
    rows = items(spark, d).orderBy("eval_index").select("query", "expected_substring").collect()
    store.write_text(spark, path, "\ufeff" + json.dumps([r.asDict() for r in rows], ensure_ascii=False))
    return files.read_eval_items(spark, path)


@query(S.TEXT_FOLDER)
def text_folder_roundtrip(spark, d):
    """Documents written as a text file each and read again."""
    path = scratch(spark)
    rows = spread(table(spark, d, "documents")).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_file"), F.coalesce("text", F.lit("")).alias("content"))
    files.write_documents(rows, path)
    return files.read_documents(spark, path).select(F.md5("text").alias("text_md5"))


@query(S.CHECKSUMS)
def checksums(spark, d):
    """SHA-256 of a file of each question."""
    path = scratch(spark)
    files.write_documents(items(spark, d).select(F.col("eval_index").cast("string").alias("doc_file"), F.col("query").alias("content")), path)
    return files.checksums(spark, path).where("path like '%.txt'").select(F.regexp_extract("path", "doc_file=([0-9]+)", 1).cast("int").alias("eval_index"), "sha256")


@query(S.AUDIT_FILES)
def audit_files(spark, d):
    """Audit samples written as a file for each group, counted as read again."""
    found = files.write_audit(clean.audit_samples(_cleaned(spark, d, "rag"), "rag", ["title", "text"]), scratch(spark))
    return found.select("status", T.bucket_name(F.col("source")).alias("source_slug"), T.bucket_name(F.col("category")).alias("category_slug"), F.col("sample_count").alias("n"))


@query(S.SPLIT_FILES)
def split_files(spark, d):
    """The kept pairs of each split, written as JSON lines and read again."""
    path = scratch(spark)
    pipeline.write_splits(_assigned(spark, d), path)
    parts = [files.read_json_lines(spark, f"{path}/{f}", "row_idx bigint, split string") for f in ("sft_train", "sft_dev", "sft_eval_holdout")]
    return reduce(DataFrame.unionByName, parts).select("row_idx", "split")


@query(S.LEGACY)
def legacy_chunks(spark, d):
    """Bare texts as chunk records with defaults."""
    rows = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("idx"), "text")
    return files.chunk_payload(rows).select("chunk_idx", "doc_id", "chunk_id", "start_char", "end_char")


@query(S.HYBRID)
def stored_search(spark, d):
    """Both searches over an index that was written and read again."""
    path, p = scratch(spark), passages(spark, d)
    files.save_index(path, chunks=p, vectors=retrieval.embed(p, "chunk_idx", "text"), postings=retrieval.postings(p), statistics=retrieval.keyword_stats(p))
    index = files.load_index(spark, path)
    files.save_index(path, vocabulary=retrieval.vocabulary(index["postings"], index["statistics"]))
    return pipeline.find(files.load_index(spark, path), questions(spark, d), Rag(retrieval_mode="hybrid"))


@query(S.METRICS)
def metrics_history(spark, d):
    """Metrics at three depths appended to one history and read again."""
    path, ranks = scratch(spark), cut(_ranks(spark, d))
    for k in (3, 5, 10):
        files.write_json_lines(evaluate.metrics(ranks, k), path, "append")
    return spark.read.schema("top_k int, queries bigint, hits bigint, hit_rate double, mrr double").json(path)


@query(S.LEADERBOARD)
def leaderboard_file(spark, d):
    """The leaderboard written as a table of text and read again."""
    path = scratch(spark)
    files.write_csv(leaderboard(spark, d), path)
    return spark.read.option("header", True).schema("place int, top_k int, hit_rate double, mrr double").csv(path)


# More of preparation

@query(S.PREPARE_RAG)
def prepare_rag(spark, d):
    """Records on topic with their normalised texts."""
    return prepare.rag_items(rag(spark, d)).select("row_idx", "title", "text")


@query(S.PREPARE_SFT)
def prepare_sft(spark, d):
    """Pairs on topic with their normalised texts."""
    return prepare.sft_items(sft(spark, d)).select("row_idx", "instruction", "response")


@query(S.TOPIC_COUNTS)
def topic_filter(spark, d):
    """Records on and off topic for each source."""
    whole = F.concat(T.normalized(F.col("title")), F.lit(" "), T.normalized(F.col("text")))
    rows = rag(spark, d).select(T.source_bucket(F.col("source")).alias("source"), T.on_topic(whole).alias("on_topic"))
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.col("on_topic").cast("int")).alias("on_topic_rows"))


@query(S.STACKED)
def stacked_sources(spark, d):
    """Rows per place of the stacked sources."""
    rows = rag(spark, d).select("row_idx", F.lower(T.normalized(F.col("source"))).alias("source"))
    names = ["openassistant", "dolly", "stackoverflow", "arxiv"]
    parts = [rows.where(F.col("source") == n) for n in names]
    return prepare.stacked(parts).groupBy("source_ord", "source").agg(F.count("*").alias("rows"), F.min("row_idx").alias("first_row"))


@query(S.ADJACENT)
def pair_adjacent(spark, d):
    """Message pairs next to each other within a conversation."""
    return prepare.adjacent_pairs(spread(table(spark, d, "message")))


@query(S.ORDINAL)
def pair_ordinal(spark, d):
    """Message pairs as a counter of non-assistant messages finds them."""
    return prepare.ordinal_pairs(spread(table(spark, d, "message")))


# Cleaning


@query(S.CLEAN_RAG)
def clean_rag_rows(spark, d):
    """Every record's reject reason, score and bucket."""
    return _verdicts(spark, d, "rag").select("row_idx", "reason", "quality_score", "quality_bucket")


@query(S.CLEAN_SFT)
def clean_sft_rows(spark, d):
    """Every pair's reject reason, score and bucket."""
    return _verdicts(spark, d, "sft").select("row_idx", "reason", "quality_score", "quality_bucket")


@query(S.profile_of("clean_rag"))
def clean_rag_profile(spark, d):
    """What comes in, stays and is dropped of each source of records, and the mean quality of what stays."""
    return clean.source_profile(_verdicts(spark, d, "rag"))


@query(S.profile_of("clean_sft"))
def clean_sft_profile(spark, d):
    """The same of pairs."""
    return clean.source_profile(_verdicts(spark, d, "sft"))


@query(S.DROP_REASONS)
def drop_reasons_rollup(spark, d):
    """Rejected records per reason, by source and over all."""
    return clean.drop_reasons(_verdicts(spark, d, "rag"))


@query(S.SUMMARY)
def cleaning_summary(spark, d):
    """Totals of both tables."""
    parts = [clean.summary(_verdicts(spark, d, w)).select(F.lit(w).alias("dataset"), "*") for w in ("rag", "sft")]
    return reduce(DataFrame.unionByName, parts)


@query(S.AUDIT)
def audit_samples(spark, d):
    """The first ten rows of each status, source and category."""
    return clean.audit_samples(_cleaned(spark, d, "rag"), "rag", ["title", "text"]).select("status", "source", "category", "row_idx", "sample_rank", "preview", "normalized_length")


@query(S.KEPT_IDS)
def kept_documents(spark, d):
    """Kept records as numbered document files."""
    found = clean.export_documents(clean.kept(_cleaned(spark, d, "rag"), "rag"))
    return found.select("doc_file", F.md5("content").alias("content_md5"))


@query(S.KEPT_ROW_IDS)
def kept_ids(spark, d):
    """Ids of kept records, made up where there is none."""
    return clean.kept(_cleaned(spark, d, "rag"), "rag").select("row_idx", "id")


# Splits and evaluation items


def _assigned(spark, d):
    kept = _verdicts(spark, d, "sft").where("quality_bucket is not null")
    return split.assign_splits(kept.select("row_idx", "id", "source", "quality_bucket"))


@query(S.SPLIT_ROWS)
def split_rows(spark, d):
    """The split of every kept pair, and whether the policy keeps it."""
    return _assigned(spark, d).select("row_idx", "split", "selected")


@query(S.SPLIT_COUNTS)
def split_counts(spark, d):
    """Rows and selected rows per split, source and bucket."""
    return split.split_summary(_assigned(spark, d)).withColumnRenamed("rows", "n_rows")


@query(S.AUTO_EVAL)
def auto_eval_items(spark, d):
    """Evaluation items made of the eval split."""
    return split.auto_eval(sft(spark, d).where("split = 'eval'"))


@query(S.EVAL_ERRORS)
def eval_validation(spark, d):
    """Errors of the evaluation items, with limits that some fail."""
    return evaluate.eval_errors(items(spark, d), query_chars=125, expected_chars=28)


@query(S.EVAL_SUMMARY)
def eval_validation_summary(spark, d):
    """Their number."""
    return evaluate.eval_summary(items(spark, d), query_chars=125, expected_chars=28)


# Profiles


@query(S.LENGTH_STATS)
def length_stats(spark, d):
    """Lengths of both text columns of records."""
    return profile.length_stats(rag(spark, d), "text").unionByName(profile.length_stats(rag(spark, d), "title"))


@query(S.DUP_RATE)
def dup_rate(spark, d):
    """Repeated texts and titles."""
    return profile.duplicate_rate(rag(spark, d), "text").unionByName(profile.duplicate_rate(rag(spark, d), "title"))


@query(S.SOURCE_COUNTS)
def source_counts(spark, d):
    """Records per source."""
    return profile.source_counts(rag(spark, d)).withColumnRenamed("rows", "n_rows")


@query(S.HISTOGRAM)
def length_histogram(spark, d):
    """Records per hundred characters of length."""
    return profile.length_histogram(rag(spark, d), "text").withColumnRenamed("rows", "n_rows")


@query(S.GATES)
def eda_gates(spark, d):
    """Shares of noise, foreign characters and near duplicates against their bounds."""
    return profile.gates(rag(spark, d), "text").withColumnRenamed("rows", "n_rows")


@query(S.NEAR_RATE)
def near_dup_rate(spark, d):
    """The share of near duplicates among the pairs of records at most forty places apart."""
    return profile.near_rate(rag(spark, d), "text")


@query(S.SIMHASH)
def simhash(spark, d):
    """The SimHash of every record's text."""
    return profile.simhash(rag(spark, d), "text")


@query(S.NEAR_BAND)
def near_dup_band(spark, d):
    """Records at most forty rows apart whose SimHashes nearly agree."""
    return profile.band_pairs(cut(profile.simhash(rag(spark, d).where("text is not null and trim(text) <> ''"), "text")))


# Chunks


@query(S.FIXED)
def fixed_chunks(spark, d):
    """Windows of every document, with a digest of each."""
    found = chunk.fixed_chunks(spread(table(spark, d, "documents")), 700, 80)
    return found.select("doc_id", "pos", "start_char", "end_char", F.md5("chunk_text").alias("chunk_md5"))


@query(S.LINKED)
def chunk_links(spark, d):
    """Windows with their ids and neighbours."""
    found = chunk.linked(chunk.fixed_chunks(spread(table(spark, d, "documents")), 1500, 100))
    return found.select("doc_id", "pos", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query(S.SENTENCES)
def sentences(spark, d):
    """Sentences of every document."""
    found = chunk.sentences(spread(table(spark, d, "documents")))
    return found.select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"), F.length("sentence").alias("sentence_length"))


def documents(spark, d) -> DataFrame:
    rows = spread(table(spark, d, "documents"))
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return chunk.document_records(rows, path, F.coalesce("source_name", F.lit("")))


@query(S.DOC_RECORDS)
def document_records(spark, d):
    """Document records of all texts that are not blank."""
    return documents(spark, d).select("doc_id", "source_name", "title", "section", F.length("text").alias("text_length"))


@query()
def paragraph_chunks(spark, d):
    """Paragraph chunks of all documents with sections and neighbours."""
    return chunk.chunk_records(documents(spark, d), 520, 80)


@query(S.CHUNK_INVARIANTS)
def chunk_invariants(spark, d):
    """Of paragraph chunks the documents that have some, chunks that are too long, empty or out of their place, and links that lead nowhere."""
    found = cut(paragraph_chunks(spark, d))
    after = found.select(F.col("chunk_id").alias("next_chunk_id"), F.col("prev_chunk_id").alias("back"), F.col("pos").alias("next_pos"))
    rows = found.join(after, "next_chunk_id", "left")
    last = F.col("pos") == F.col("last")
    linked = F.when(last, F.col("next_chunk_id").isNull()).otherwise((F.col("back") == F.col("chunk_id")) & (F.col("next_pos") == F.col("pos") + 1))
    rows = rows.join(found.groupBy("doc_id").agg(F.max("pos").alias("last"), F.count("*").alias("n")), "doc_id")
    count = lambda holds: F.sum(F.coalesce(holds, F.lit(True)).cast("bigint"))
    return rows.agg(
        F.count_distinct("doc_id").alias("documents"), count(F.length("chunk_text") > 520).alias("too_long"), count(F.trim("chunk_text") == "").alias("blank"),
        count(F.col("start_char") >= F.col("end_char")).alias("reversed"), count(F.col("n") != F.col("last") + 1).alias("with_gaps"), count(~linked).alias("badly_linked"),
    )


# Search


@query(S.KNN)
def knn_topk(spark, d):
    """The five nearest vectors of every fiftieth vector."""
    v = spread(table(spark, d, "embeddings"))
    vectors = v.select(F.col("vec_id").alias("chunk_idx"), "embedding")
    return retrieval.knn(vectors, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 5)


def passages(spark, d) -> DataFrame:
    """Documents as chunks of their own: what is searched in the queries that SQL can follow."""
    rows = spread(table(spark, d, "documents"))
    return rows.select(F.col("doc_id").alias("chunk_idx"), F.coalesce("title", F.lit("")).alias("title"), F.lit(None).cast("string").alias("section"), F.coalesce("text", F.lit("")).alias("text"))


def questions(spark, d) -> DataFrame:
    return items(spark, d).select(F.col("eval_index").cast("bigint").alias("qid"), "query")


@query(S.VOCABULARY)
def bm25_vocabulary(spark, d):
    """Document frequency and weight of every word."""
    p = passages(spark, d)
    return retrieval.vocabulary(retrieval.postings(p), retrieval.keyword_stats(p)).select("term", "df", F.round("idf", 9).alias("idf"))


def _bm25(spark, d, k):
    return retrieval.bm25_scan(passages(spark, d), questions(spark, d), k)


@query(S.BM25)
def bm25_topk(spark, d):
    """The ten best documents of every evaluation question by BM25."""
    return _bm25(spark, d, 10)


def _vector(spark, d, k):
    return retrieval.knn(retrieval.embed(passages(spark, d), "chunk_idx", "text"), retrieval.embed(questions(spark, d), "qid", "query"), k)


@query(S.VECTOR)
def vector_topk(spark, d):
    """The ten nearest documents of every question by hashed words."""
    return _vector(spark, d, 10)


@query(S.HYBRID)
def hybrid_rrf(spark, d):
    """Both lists fused."""
    return retrieval.fuse(_vector(spark, d, 15), _bm25(spark, d, 15), 5)


@query(S.RERANK)
def reranked(spark, d):
    """The twenty best by BM25, reranked by word overlap."""
    return retrieval.rerank(_bm25(spark, d, 20), questions(spark, d), passages(spark, d), 5)


@query(S.GATE)
def quality_gate(spark, d):
    """Whether what was found suffices."""
    return retrieval.quality_gate(_bm25(spark, d, 5), questions(spark, d), passages(spark, d), min_score=0.6, min_coverage=0.5, min_strong=2)


@query(S.GATE_OFF)
def quality_gate_off(spark, d):
    """The same where the gate is turned off."""
    found = retrieval.quality_gate(_bm25(spark, d, 5), questions(spark, d), passages(spark, d), enabled=False)
    return found.select("qid", "sufficient", "reason", "best_score", "total_results")


def _served(spark, d):
    indexed = pipeline.numbered_chunks(documents(spark, d), 520, 80)
    return indexed, cut(retrieval.retrieve(indexed, questions(spark, d), top_k=5, mode="hybrid", reranked=True))


@query()
def context_blocks(spark, d):
    """Context blocks of every question over paragraph chunks."""
    chunks, found = _served(spark, d)
    return context.context_blocks(found, chunks)


@query(S.CONTEXT_INVARIANTS)
def context_invariants(spark, d):
    """Questions with context blocks, and those with too many blocks, too many chunks of a document, too much text or a gap in their ranks."""
    rows = cut(context_blocks(spark, d))
    per_doc = rows.groupBy("qid", "doc_id").agg(F.sum(F.size("chunk_ids")).alias("own")).groupBy("qid").agg(F.max("own").alias("own"))
    each = rows.groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.sum(F.length("rendered_text")).alias("chars")).join(per_doc, "qid")
    count = lambda holds: F.sum(holds.cast("bigint"))
    return each.agg(
        F.count("*").alias("questions"), count(F.col("n") > 3).alias("too_many"), count(F.col("own") > 3).alias("too_many_of_one"), count((F.col("chars") > 1800) & (F.col("n") > 1)).alias("too_long"), count(F.col("n") != F.col("last")).alias("with_gaps")
    )


@query(S.ANSWER_INVARIANTS)
def answer_invariants(spark, d):
    """Answers, those without any text, those whose evidence is not what their sources say, and generated ones without a passed gate."""
    rows = answers(spark, d)
    count = lambda holds: F.sum(F.coalesce(holds, F.lit(True)).cast("bigint"))
    return rows.agg(
        F.count("*").alias("answers"), count(F.trim("answer") == "").alias("blank"), count(F.col("evidence_count") != F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0))).alias("wrong_evidence"),
        count((F.col("mode") == "rag") & ~F.col("grounded")).alias("ungrounded"), F.count("rag_error").alias("failed"),
    )


@query()
def answers(spark, d):
    """Answers with sources, by a stand-in for a model."""
    chunks, found = _served(spark, d)
    gate = retrieval.quality_gate(found, questions(spark, d), chunks, min_score=0.6, min_coverage=0.5)
    return context.answers(context.context_blocks(found, chunks), gate, questions(spark, d), mode="rag")


@query(S.PROMPTS)
def prompts(spark, d):
    """The prompt of every question with its three best documents' titles as contexts."""
    lists = _bm25(spark, d, 3).join(passages(spark, d).select("chunk_idx", "title"), "chunk_idx").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("c"))
    rows = questions(spark, d).join(lists, "qid", "left")
    contexts = F.coalesce(F.transform("c", lambda x: x["title"]), F.array().cast("array<string>"))
    return rows.select("qid", F.md5(context.prompt(F.col("query"), contexts)).alias("prompt_md5"))


# Integrity


@query(S.LEAK_EXACT)
def leak_exact(spark, d):
    """Pairs whose instruction is an evaluation question."""
    return integrity.exact_query_matches(sft(spark, d), items(spark, d))


@query(S.leak_contained("sft_instructions", "response"))
def leak_response(spark, d):
    """Responses that contain an expected text."""
    return integrity.expected_matches(sft(spark, d), items(spark, d), "response")


@query(S.leak_contained("rag_corpus", "text"))
def leak_text(spark, d):
    """Records that contain an expected text."""
    return integrity.expected_matches(rag(spark, d), items(spark, d), "text")


@query()
def leak_sft(spark, d):
    """The first pair that leaks each item, with all reasons."""
    return integrity.sft_leakage(sft(spark, d), items(spark, d))


@query()
def leak_rag(spark, d):
    """The first record that leaks each item, with all reasons."""
    return integrity.rag_leakage(rag(spark, d), items(spark, d))


@query()
def split_integrity(spark, d):
    """Counts of all checks: pairs and records against the items and against items made of the pairs, and these against each other."""
    e = items(spark, d)
    return integrity.split_integrity(sft(spark, d), rag(spark, d), e, split.auto_eval(sft(spark, d)).select(F.row_number().over(_by_row()).alias("eval_index"), "query", "expected_substring"))


def _by_row():
    from pyspark.sql import Window

    return Window.orderBy("row_idx")  # at most two hundred items


# Evaluation


def _ranks(spark, d):
    return evaluate.hit_ranks(_bm25(spark, d, 10), passages(spark, d), items(spark, d).withColumn("eval_index", F.col("eval_index").cast("bigint")))


@query(S.HIT_RANKS)
def hit_ranks(spark, d):
    """The first document of each question that holds the expected text."""
    return _ranks(spark, d)


@query(S.METRICS)
def hit_rate_mrr(spark, d):
    """Hit rate and mean reciprocal rank at 3, 5 and 10."""
    ranks = cut(_ranks(spark, d))
    return reduce(DataFrame.unionByName, [evaluate.metrics(ranks, k) for k in (3, 5, 10)])


@query(S.ABLATION)
def ablation_grid(spark, d):
    """All variants of a grid of parameters."""
    sizes, overlaps, ks = (evaluate.numbers_of(x, "numbers", least=0) for x in ("420,520, 700,420", "40,80,520", "3,5,8,"))
    return evaluate.variants(spark, evaluate.names_of("vector, hybrid", "modes"), sizes, overlaps, ks)


@query(S.LEADERBOARD)
def leaderboard(spark, d):
    """Places of three depths of search by their metrics."""
    return evaluate.leaderboard(hit_rate_mrr(spark, d).withColumn("ordinal", F.col("top_k"))).select("place", "top_k", "hit_rate", "mrr")


@query(S.REGRESSION)
def regression_check(spark, d):
    """Depth 3 against depth 10 as the baseline."""
    m = cut(hit_rate_mrr(spark, d))
    return evaluate.regression(m.where("top_k = 3"), m.where("top_k = 10"))


@query()
def ablation_run(spark, d):
    """The leaderboard of two modes, two sizes and two depths over all documents."""
    grid = evaluate.variants(spark, ["vector", "hybrid"], [520, 1000], [80], [3, 8])
    return pipeline.ablation(documents(spark, d), items(spark, d), grid)
