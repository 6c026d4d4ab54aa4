"""Text functions, chunks, splits, pairing and ordering, against literal cases and plain Python."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunk, prepare, split
from corpusmill.operators.ordering import global_ordinal, hash_rank


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.normalized, "  a\x1c\tb　") == "a b" and one(spark, T.normalized, None) == ""
    assert one(spark, lambda c: T.word_count(c), "Größe ist groß_1, été") == 4
    assert one(spark, T.bucket_name, " Stack Overflow! ") == "stack_overflow" and one(spark, T.bucket_name, "!!") == "unknown"
    assert one(spark, T.non_ascii_ratio, "aé") == 0.5 and one(spark, T.non_ascii_ratio, "") == 0.0
    assert one(spark, lambda c: T.preview(c, 10), "abcdefg hijk") == "abcdefg..."
    assert one(spark, T.section_of, "\n\n## Head \nbody") == "Head" and one(spark, T.section_of, "body") is None
    assert one(spark, lambda c: T.title_of(c, F.lit("f")), "###\nx") == "f" and one(spark, lambda c: T.title_of(c, F.lit("f")), None) == "f"
    assert one(spark, lambda c: T.snippet(c, 5, 20), "One two. Three? Four and more words here") == "One two."
    assert one(spark, lambda c: T.snippet(c, 3, 10), "abcdefghijklmnop") == "abcdefghij"
    assert one(spark, T.answer_part, "x [ASSISTANT]\n Grounded answer [USER] y") == "Grounded answer"
    assert one(spark, T.trigrams, "ab") == ["ab"] and one(spark, T.trigrams, "abcd") == ["abc", "bcd"]
    assert one(spark, T.on_topic, "html page") and not one(spark, T.on_topic, "plain")
    assert one(spark, T.split_list, "520, 700,,520 ") == ["520", "700"]
    assert one(spark, T.run_label, "ablation hybrid c=520/o=80 k=5") == "ablation_hybrid_c_520_o_80_k_5"
    assert one(spark, lambda c: T.tokens(c, "literal_backslash_w"), "usual text") == []


def windows(spark, text, size, overlap):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return [(r.start_char, r.end_char, r.chunk_text) for r in chunk.fixed_chunks(df, size, overlap).orderBy("pos").collect()]


def test_fixed_windows(spark):
    assert [w[2] for w in windows(spark, "abcdefghij", 4, 1)] == ["abcd", "defg", "ghij", "j"]
    assert windows(spark, "abcdefgh", 3, 1) == [(0, 3, "abc"), (2, 5, "cde"), (4, 7, "efg"), (6, 8, "gh")]
    assert windows(spark, "", 3, 1) == [] and windows(spark, None, 3, 1) == []
    for size, overlap in ((0, 0), (3, -1), (3, 3)):
        with pytest.raises(ValueError):
            chunk.check(size, overlap)


def test_paragraph_chunks():
    text = "# What is RAG\n\nRAG combines retrieval with generation to ground answers.\n\n# Benefits\n\nIt reduces hallucinations by using external evidence."
    found = chunk.paragraph_chunks(text, 90, 0)
    assert [f[3] for f in found] == ["What is RAG", "Benefits"] and found[0][0] == 0 and found[1][1] == len(text)
    long = " ".join(f"Sentence number {i} is here." for i in range(40))
    parts = chunk.paragraph_chunks(long, 100, 20)
    assert all(len(p[2]) <= 100 for p in parts) and parts[0][2].startswith("Sentence number 0")
    assert all(long[a:b].split() == t.split() for a, b, t, _ in parts)
    solid = "x" * 250
    assert [p[:2] for p in chunk.paragraph_chunks("ab\n\n" + solid, 100, 0)] == [(0, 2), (4, 104), (104, 204), (204, 254)]
    assert chunk.paragraph_chunks("ab\n\n" + solid, 100, 0, offsets="reference")[1][:2] == (0, 100)
    small = chunk.paragraph_chunks("aa\n\nbb\n\ncc\n\ndd", 6, 2)
    assert [p[2] for p in small] == ["aa\n\nbb", "bb\n\ncc", "cc\n\ndd"]
    assert chunk.paragraph_chunks("", 10, 0) == [] and chunk.paragraph_chunks(" \n\n ", 10, 0) == []


def test_chunk_records(spark):
    rows = [(1, "n", "Head line\n\nfirst part here\n\nsecond part here"), (2, "n", None), (3, "n", " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source_name string, text string")
    records = chunk.document_records(docs, F.concat(F.lit("p/"), F.col("doc_id").cast("string")), F.col("source_name"))
    found = chunk.chunk_records(records, 20, 0).orderBy("pos").collect()
    assert [r.chunk_id for r in found] == ["p_1__0000", "p_1__0001", "p_1__0002"]
    assert found[0].prev_chunk_id is None and found[1].next_chunk_id == "p_1__0002" and found[2].title == "Head line"


@pytest.mark.parametrize("n,expected", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (4, (2, 1, 1)), (5, (3, 1, 1)), (7, (5, 1, 1)), (10, (8, 1, 1)), (12, (10, 1, 1)), (15, (12, 2, 1)), (16, (13, 2, 1)), (25, (20, 3, 2)), (99, (79, 10, 10))])
def test_allocation(spark, n, expected):
    row = spark.range(1).select(*split.allocation(F.lit(n), (0.8, 0.1, 0.1))).first()
    assert tuple(row) == expected


def test_splits_do_not_depend_on_partitions(spark):
    rows = [(i, f"id{i}", "s" if i % 3 else None, ["high", "medium", "low", "odd"][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_idx bigint, id string, source string, quality_bucket string")
    a = {tuple(r) for r in split.assign_splits(df.repartition(1)).select("row_idx", "split", "selected").collect()}
    b = {tuple(r) for r in split.assign_splits(df.repartition(13)).select("row_idx", "split", "selected").collect()}
    assert a == b and len(a) == 400 and {x[1] for x in a} == {"train", "dev", "eval"}
    with pytest.raises(ValueError):
        split.parse_policy("high=2")
    assert split.parse_policy("low=0.5") == {"high": 1.0, "medium": 1.0, "low": 0.5}


def test_ordinals_and_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 2) for i in range(101)], "row_idx bigint, g int").repartition(5)
    assert all(r.row_idx == r.ordinal for r in global_ordinal(df, "row_idx").collect())
    ranked = hash_rank(df, ["g"], F.md5(F.col("row_idx").cast("string")), "row_idx").collect()
    for g in (0, 1):
        assert sorted(r["rank"] for r in ranked if r.g == g) == list(range(1, sum(r.g == g for r in ranked) + 1))


def test_pairs_of_messages(spark):
    rows = [(0, "c", "user", "q1"), (1, "c", "Assistant ", "a1"), (2, "c", None, "q2"), (3, "d", "assistant", "no"), (4, "c", "assistant", "a2"), (5, "c", "user", " "), (6, "c", "assistant", "a3"), (7, None, "user", "q")]
    df = spark.createDataFrame(rows, "row_idx bigint, conv_id string, role string, text string")
    for block in (1, 3, 100):
        found = prepare.adjacent_pairs(df, block=block).orderBy("row_idx").collect()
        assert [(r.instruction, r.response) for r in found] == [("q1", "a1"), ("q2", "a2")]
    found = prepare.ordinal_pairs(df).orderBy("row_idx").collect()
    assert [(r.instruction, r.response) for r in found] == [("q1", "a1"), ("q", "no")]


def test_documents_of_one_key_keep_their_own_chunks(spark):
    rows = [("a.b", "one two three.\n\nfour five six."), ("a-b", "seven eight nine.\n\nten."), ("a", "zero.")]
    records = chunk.document_records(spark.createDataFrame(rows, "path string, text string"), F.col("path"), F.col("path"))
    found = chunk.chunk_records(records, 20, 0)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # texts stay where they are
    own = sorted((r.source_path, r.pos, r.next_chunk_id, r.chunk_text) for r in found.collect())
    assert [x[:3] for x in own] == [("a", 0, None), ("a-b", 0, "a_b__0001"), ("a-b", 1, None), ("a.b", 0, "a_b__0001"), ("a.b", 1, None)] and own[2][3] == "ten."


def test_white_space_at_ends(spark):
    odd = "a" + T.SPACES + "\u200b\u0084\u180e\ufeff"
    rows = [(f"{c}{d} x{c}y {d}{c}",) for c in odd for d in odd] + [(T.SPACES,), ("",), (None,), ("\u00e9 \n",)]
    was = F.regexp_replace(F.coalesce("s", F.lit("")), f"^{T.SPACE}+|{T.SPACE}+$", "")
    assert spark.createDataFrame(rows, "s string").where(was != T.stripped(F.col("s"))).count() == 0
