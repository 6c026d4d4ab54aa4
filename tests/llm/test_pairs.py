"""Near duplicates, format copies and split overlaps, against brute force on made-up texts."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import links
from corpusmill.llm.bags import signatures
from corpusmill.llm.fields import canonical, fields
from corpusmill.llm.formatting import format_copies, format_copy_rows
from corpusmill.llm.links import components, pairs_within
from corpusmill.llm.near_duplicates import near_duplicate_pairs, near_duplicates
from corpusmill.llm.split_overlap import overlap_report, split_overlap_pairs

WORD = re.compile(r"[^\W_]+")


def runs(text):
    w = WORD.findall((text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    out = []
    while len(out) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.randint(15, 60))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            edited = list(words)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            out.append(" ".join(edited).title())
    return out[:n] + [None, "", "  ", "one two", out[0], out[0], out[0].upper(), "x " * 4000]


def grouped(sets, least):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        if likeness(sets[a], sets[b]) >= least:
            parent[root(a)] = root(b)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if root(a) == root(b)}


def test_signatures_are_unbiased():
    a, b = {i: 1 + i % 5 for i in range(30)}, {i: 1 + (i * 7) % 9 for i in range(10, 45)}
    both = set(a) | set(b)
    true = sum(min(a.get(x, 0), b.get(x, 0)) for x in both) / sum(max(a.get(x, 0), b.get(x, 0)) for x in both)
    doc = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    h, w = np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()])
    same = [(s[0] == s[1]).mean() for s in (signatures(doc, h, w, 2, 128, seed=k) for k in range(1, 120))]
    assert abs(np.mean(same) - true) < 0.012
    assert np.isinf(signatures(doc[:0], h[:0], w[:0], 1, 8)).all()


def test_groups_equal_brute_force(spark):
    own = texts(1, 250)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(own)], "row_idx bigint, text string, root string")
    truth = grouped({i: s for i, t in enumerate(own) if (s := runs(t))}, 0.6)
    for heads in (1, 8):
        found = {tuple(r) for r in near_duplicate_pairs(df, F.coalesce("text", F.lit("")), width=3, least=0.6, bags=False, heads=heads).collect()}
        assert found == truth and len(truth) > 100
    assert near_duplicates(df.limit(0), F.coalesce("text", F.lit(""))).count() == 0


def test_rows_without_numbers_are_left_out(spark):
    rows = [(None, "a b c d e f", "train"), (None, "a b c d e f", "eval"), (1, "a b c d e f", "train"), (2, "a b c d, e f", "eval")]
    df = spark.createDataFrame(rows, "row_idx bigint, text string, split string")
    assert {tuple(r) for r in near_duplicate_pairs(df, F.col("text"), width=3, least=0.6).collect()} == {(1, 2)}
    assert {tuple(r) for r in format_copy_rows(df, fielded=["text"]).collect()} == {(1, 2)}
    assert {tuple(r) for r in split_overlap_pairs(df, F.col("text"), F.col("split") == "train", width=3, least=0.6).collect()} == {(1, 2)}


def test_repeated_passages(spark):
    """Sets of runs don't change when a passage comes again; multisets do."""
    rng, rows, truth = random.Random(11), [], set()
    for i in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(90)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words * (2 + i % 4), *(f"x{i}y{j}" for j in range(5))]))]
        truth.add((10 * i, 10 * i + 1))
    df = spark.createDataFrame(rows, "row_idx bigint, text string")
    assert {tuple(r) for r in near_duplicate_pairs(df, F.col("text"), width=3, least=0.6, bags=False).collect()} == truth
    assert near_duplicate_pairs(df, F.col("text"), width=3, least=0.6).count() == 0
    twice = [(i, " ".join([*w, *w[: 60 + i]])) for w in [[f"v{j}" for j in range(90)]] for i in (0, 4, 30)]  # 0.96, 0.81 and 0.83 as multisets
    found = near_duplicate_pairs(spark.createDataFrame(twice, "row_idx bigint, text string"), F.col("text"), width=3, least=0.9)
    assert {tuple(r) for r in found.collect()} == {(0, 4)}


def test_hot_buckets_in_cells(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 50 + i % 3], *(f"e{i}f{j}" for j in range(i % 4))])) for i in range(200)]
    rows += [(1000 + i, " ".join([*base[30:], *(f"g{j}" for j in range(30))])) for i in range(3)]
    df = spark.createDataFrame(rows, "row_idx bigint, text string")
    truth = grouped({i: runs(t) for i, t in rows}, 0.6)
    for cell in (10, 50_000):
        assert {tuple(r) for r in near_duplicate_pairs(df, F.col("text"), width=3, least=0.6, bags=False, heads=2, cell=cell).collect()} == truth


def test_hot_group_is_whole(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:39], f"e{i}"])) for i in range(120)]
    found = near_duplicate_pairs(spark.createDataFrame(rows, "row_idx bigint, text string"), F.col("text"), width=3, least=0.6, bags=False, heads=2)
    assert found.count() == 120 * 119 // 2


def test_components_of_a_chain(spark, monkeypatch):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(101, 100), (7, 7)], "a bigint, b bigint")
    for few in (1000, 0):  # by one task, and round by round
        monkeypatch.setattr(links, "FEW", few)
        assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(df.limit(0)).count() == 0
    members = spark.createDataFrame([(i, 0) for i in range(30)] + [(99, 1)], "row_idx bigint, root bigint")
    assert pairs_within(members).count() == 435


def test_fields():
    bar = "Next step: run A-5, 12 | Owner note: B c 7"
    for other in ("Owner note: B c 7\nNext step: run A-5, 12", "- owner note: b C 7.\n- NEXT  STEP: run a 5 12.", '{"Owner note": "B c 7", "Next step": "run A-5, 12"}', "Next step: run A-5, 12; Owner note: B c 7"):
        assert canonical(other) == canonical(bar), other
    assert canonical("Next step: B c 7 | Owner note: run A-5, 12") != canonical(bar)
    assert fields("In short: this is prose. It goes on: so it does.") is None and fields("") is None and fields("a: b") is None
    assert canonical(None) == "" and canonical("STRASSE!") == canonical("straße")


def test_fields_of_a_line_each():
    assert [k for k, _ in fields("Model: bert\nOwner: alice")] == ["Model", "Owner"]
    assert canonical("Model: bert\nOwner: alice\nNext step: go on") == canonical("- next step: Go on\n- owner: Alice\n- model: BERT") == canonical("Owner: alice; Model: bert; Next step: go on")
    long = "Note: " + "word " * 80 + "end\nOwner: alice. She left it\nModel: bert"
    assert canonical(long) == canonical("\n".join(reversed(long.split("\n")))) and len(fields(long)) == 3
    assert fields("So it goes: this is prose.\nThe next line has no name\nand this: neither. It goes on.") is None


def test_format_copies(spark):
    rows = [(0, "Ask it", "Some answer, here."), (1, "ask IT!", "some\tanswer here"), (2, "Ask it", "Other"), (3, None, "..."), (4, "", None), (5, "ask-it", "Goal: x 1\nRisk: y 2"), (6, "askit", "risk: Y 2; goal: X 1"), (7, "Ask it", "Some answer, here.")]
    df = spark.createDataFrame(rows, "row_idx bigint, instruction string, response string").withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))
    how = dict(plain=["instruction"], fielded=["response"])
    assert {tuple(r) for r in format_copy_rows(df, **how).collect()} == {(0, 1), (0, 7), (5, 6)}
    assert {tuple(r) for r in format_copies(df, **how).collect()} == {(0, 3), (2, 1), (5, 2)}
    assert format_copy_rows(df.limit(0), **how).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("row_idx"), F.lit("a").alias("instruction"), F.when(F.col("id") % 2 == 0, "B b").otherwise("b, B").alias("response"))
    assert format_copy_rows(hot, **how).count() == 2999


def test_overlaps_equal_brute_force(spark):
    own = texts(2, 260)
    splits = ["train", "eval", "Train ", None, "train"]
    df = spark.createDataFrame([(i, t, splits[i % 5], "S") for i, t in enumerate(own)], "row_idx bigint, text string, split string, source string")
    train = {i for i in range(len(own)) if i % 5 in (0, 2, 4)}
    sets = {i: s for i, t in enumerate(own) if (s := runs(t))}
    truth = {(a, b) for a, b in combinations(sets, 2) if (a in train) != (b in train) and likeness(sets[a], sets[b]) >= 0.6}
    is_train = F.lower(F.trim("split")) == "train"
    for block in (1, 4096):
        found = {tuple(r) for r in split_overlap_pairs(df, F.coalesce("text", F.lit("")), is_train, width=3, least=0.6, block=block).collect()}
        assert found == truth and truth
    report = overlap_report(df, F.coalesce("text", F.lit("")), is_train, width=3, least=0.6).collect()
    assert sum(r.overlapping for r in report) == len({x for p in truth for x in p if x not in train})
    assert split_overlap_pairs(df.limit(0), F.coalesce("text", F.lit("")), is_train).count() == 0
