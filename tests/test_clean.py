"""Cleaning, scores, profiles and audit samples on small literal rows."""

from corpusmill.operators import clean

RAG = "row_idx bigint, id string, source string, title string, text string, tags array<string>"
SFT = "row_idx bigint, id string, source string, instruction string, response string"
GOOD = "Contrastive learning compares positive and negative pairs in representation space for robust embeddings."
LIMITS = clean.Limits(rag_chars=40, instruction_chars=10, response_chars=20)


def rag(spark, rows):
    return clean.clean_rag(spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], RAG), LIMITS)


def sft(spark, rows, limits=LIMITS):
    return clean.clean_sft(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SFT), limits)


def reasons(df):
    return [r.reason for r in df.orderBy("row_idx").collect()]


def test_records_end_to_end(spark):
    df = rag(spark, [
        ("r1", "openassistant", "Contrastive learning", GOOD), ("r2", "openassistant", "Contrastive learning", GOOD.upper()),
        ("r3", "openassistant", "bad", "Visit http://spam.example for lorem ipsum words and more words here"), ("r4", "arxiv", "tiny", "short"),
    ])
    assert reasons(df) == [None, "duplicate", "noise", "too_short_for_rag"]
    one = clean.summary(df).first()
    assert (one.before, one.after, one.removed, one.avg_quality, one.medium_rows) == (4, 1, 3, 0.522, 1)
    by = {r.source: r for r in clean.source_profile(df).collect()}
    assert (by["openassistant"].before, by["openassistant"].after, by["arxiv"].removed, by["arxiv"].avg_quality) == (3, 1, 1, 0.0)


def test_pairs_end_to_end(spark):
    pair = ("Explain FAISS index usage in simple words", "FAISS stores vectors and quickly returns nearest neighbors for semantic search tasks.")
    df = sft(spark, [("s1", "dolly", *pair), ("s2", "dolly", *pair), ("s3", "openassistant", "N/A", "http://spam")])
    assert reasons(df) == [None, "duplicate", "instruction_too_short"]
    assert df.where("reason is null").first().quality_score == 0.446


def test_rule_order(spark):
    six = "one two three four five six"
    df = rag(spark, [(None, None, "A title", GOOD), ("b", "arxiv", "", six + " and so on so"), ("c", "arxiv", "", six + " seven eight nine ten eleven twelve"), ("d", " ", "t", None)])
    assert reasons(df) == ["missing_source", "weak_title_text_pair", "arxiv_missing_title", "missing_source"]
    low = clean.Limits(instruction_chars=3, response_chars=2)
    df = sft(spark, [
        ("a", "x", "What is that?", "yes"), ("b", "x", "the same four words", "The same four words"), ("c", "openassistant", "What now then?", "Thanks, happy to help."),
        ("d", "stackoverflow", "How to do it?", "use `print(x)` like this"), ("e", "x", None, "something else"), ("f", "x", "What is it?", "  "),
    ], low)
    assert reasons(df) == ["weak_response", "invalid_instruction_response_pair", "openassistant_weak_assistant_reply", "stackoverflow_low_signal_answer", "empty_instruction", "empty_response"]


def test_title_and_text_share_one_key(spark):
    body = "the quick brown fox jumps over the lazy dog again and again in the long evening"
    df = rag(spark, [("a", "s", "first", "words " + body), ("b", "s", "first words", body)])
    assert reasons(df) == [None, "duplicate"]


def test_samples_and_ids(spark):
    df = rag(spark, [(None, "s", f"Title number {i}", f"{GOOD} {i}") for i in range(5)])
    picked = clean.audit_samples(df, "rag", ["title", "text"], 2).collect()
    assert sorted(r.row_idx for r in picked) == [0, 1]
    kept = clean.kept(df, "rag").orderBy("row_idx").collect()
    assert [r.id for r in kept] == [f"rag-{i}" for i in range(5)]
    files = clean.export_documents(clean.kept(df, "rag")).orderBy("doc_file").collect()
    assert files[4].doc_file == "doc_0000004.txt" and files[4].content.startswith("Title number 4\n\n")


def test_empty_table(spark):
    df = rag(spark, [])
    assert df.count() == 0 and clean.source_profile(df).count() == 0
    assert clean.summary(df).count() == 0
