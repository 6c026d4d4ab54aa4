"""Languages, kinds, defects, packing, leaks and cuts on small cases."""

import copy
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import line_model
from corpusmill.llm.bitmap import bitmap
from corpusmill.llm.broken_pairs import broken_pairs, copies, opening, unrelated_prompts
from corpusmill.llm.endings import ending, open_endings
from corpusmill.llm.fm_index import FMIndex
from corpusmill.llm.language_labels import fit, language_cases, language_segments, text_languages
from corpusmill.llm.languages import declared
from corpusmill.llm.leaks import leaked_items, leaked_phrases, removal_spans
from corpusmill.llm.packing import OpenBins, pack, packing_report
from corpusmill.llm.text_kinds import LineModel, Statistics
from corpusmill.llm.text_statistics import text_statistics, unnatural_texts
from corpusmill.llm.truncation import length_hazards, truncated_texts, truncation_report
from corpusmill.llm.values import long_form
from corpusmill.llm.words import word_list

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def common(spark):
    return spark.read.parquet(f"{DATA}/common_word.parquet")


@pytest.fixture(scope="module")
def model(spark, common):
    return fit(spark.read.parquet(f"{DATA}/lang_sample.parquet"), common)


def values(spark, rows):
    df = spark.createDataFrame([(i, t, label) for i, (t, label) in enumerate(rows)], "row_idx bigint, text string, lang string")
    return long_form([(df, "t", "text", "lang")])


def test_held_out_sentences_get_their_language(spark, common):
    samples = spark.read.parquet(f"{DATA}/lang_sample.parquet")
    held = samples.where("sample_id % 4 = 0").collect()
    model = fit(samples.where("sample_id % 4 <> 0"), common)
    found = model.languages([r.text for r in held])
    assert sum(len(x) > 0 and x[0][0] == r.lang for r, x in zip(held, found)) >= 0.97 * len(held)


def test_languages(spark, model, common):
    en, de = "The team found that the answer was not what they had in mind.", "Die Arbeitsgruppe prüfte das Modell nach der Freigabe und fand keine Abweichung."
    rows = [(en, "en-US"), (en, None), (en, "??"), (en, "de"), (f"{en} {de}", "en"), (None, None), ("", "en"), ("word", None), ("x " * 5000, None), ("| a | b |\n| 1 | 2 |\n| 3 | 4 | 5 | 6 | 7 |", None), (de.upper(), "GER")]
    v = values(spark, rows)
    found = {(r.row_idx, r.lang) for r in language_cases(v, model, common, natural_only=["text"]).collect()}
    assert found == {(1, "en"), (2, "en"), (3, "en"), (4, "en"), (4, "de")}
    assert all(0 < r.confidence <= 1 and 0 < r.share <= 1 for r in text_languages(v, model).collect())
    segments = [r.lang for r in language_segments(v.where("row_idx = 4"), model).orderBy("segment").collect()]
    assert segments == ["en", "de"]
    assert text_languages(v.limit(0), model).count() == 0
    assert declared("pt-BR") == "pt" and declared("English") == "en" and declared("unknown") is None


@pytest.mark.parametrize("memo", [40, 500, 2000])
def test_more_unknown_words_than_are_kept(spark, model, memo):
    """A batch may pass the number of unknown words that a model keeps, and may hold more than it, as may the known ones."""
    rnd = random.Random(5)
    en, de = "The team found that the answer was not what they had in mind.", "Die Arbeitsgruppe prüfte das Modell nach der Freigabe und fand keine Abweichung."
    new = [["".join(rnd.choices("abdegiklmnoprstuz", k=9)) for _ in range(8)] for _ in range(1200)]
    texts = [" ".join([(en, de, f"{en} {de}", "")[i % 4], *own]) for i, own in enumerate(new)]
    small, wide = copy.deepcopy(model), copy.deepcopy(model)
    small.memo = memo
    for i in range(0, len(texts), 30):
        assert small.segments(texts[i : i + 30]) == wide.segments(texts[i : i + 30])
        assert len(small.rows) - small.known <= memo + 30 * 20
    assert len(wide.rows) - wide.known > 9000 and small.known > 40
    v = values(spark, [(t, None) for t in texts]).coalesce(1)
    found = [{(r.row_idx, r.lang, r.share, r.confidence) for r in text_languages(v, m).collect()} for m in (small, wide)]
    assert found[0] == found[1] and {i for i in range(len(texts)) if i % 4 < 3} <= {i for i, *_ in found[0]}


def test_kinds(spark, common):
    prose = "The notes on the model call the reranker fragile, because the chunks overlapped too much. It is cheap to run it next to the other one."
    rows = [
        prose, prose.replace(" ", "\n"), "- one item here\n- another item\n- third item of it\n- and more", "1) first thing 2) second thing 3) third thing 4) fourth thing", "a,b,c\n1,2,3\n4,5,6\nx,y,z\nred,blue,green",
        "| a | b |\n|---|---|\n| c | d |\n| e | f |", "Goal: do this 5\nRisk: that 7\nOwner: me 9\nData: none of it", "3f2a9c01 77be0d12 9a0c1d2e 00ff12ab 5d5d5d5d 12345678", "foo-1 bar-2 " * 12, "ok", None, "   ",
        prose + "\n\n- item one\n- item two", "y" * 90_000,
    ]
    v = values(spark, [(t, None) for t in rows])
    kinds = {r.row_idx: r.kind for r in text_statistics(v, common).collect()}
    assert [kinds.get(i) for i in range(13)] == ["prose", "prose", "list", "list", "table", "table", "fields", "junk", "junk", "prose", None, None, "prose"]
    assert {r.row_idx for r in unnatural_texts(v, common).collect()} == {2, 3, 4, 5, 6, 7, 8, 13} - ({4} if len(rows[4]) < 40 else set()) - ({5} if len(rows[5]) < 40 else set())
    one = Statistics(frozenset({"the"}))("The cat.\nthe dog")
    assert one[0] == 4 and one[1] == 3.0 and one[3] in (1, 2) and one[5] == 0.5


def test_prose_that_opens_like_a_field(common):
    kinds = Statistics(word_list(common))
    flow = "The query encoder of Hestuv and the vector index share one budget of 67 tokens. Compare both for every stale snapshot. It was slow at first."
    assert all(kinds(f"{opens}: {flow}")[-1] == "prose" for opens in ("You ask", "In short", "Note"))
    assert kinds('You asked: "Our evaluation group told me that Wim is robust once the cache was warm. Why would it change?"')[-1] == "prose"
    assert kinds("recall at five of Ulmgis\nZorgra slow\nquery encoder for Erls\nFenxan well calibrated\nvalidation loss of Othnok")[-1] == "list"
    assert kinds("run\tsplit\thit_rate\tloss\nGranok-Mini\tdev\t0.646\t98407\nErlorv-12\teval\t0.957\t23782")[-1] == "table"


def test_line_model_is_estimated(spark):
    rows = ["0"] * 50 + ["222"] * 20 + ["0333"] * 10 + ["", None]
    signs = spark.createDataFrame([(r,) for r in rows], "signs string")
    model, before = line_model.fit(signs), LineModel()
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.move.sum(axis=1), 1) and np.allclose(model.start.sum(), 1)
    assert model.emit[0, 0] > before.emit[0, 0] and model.emit[4, 6] <= before.emit[4, 6]
    assert model.judge((2, 2, 2), [3, 3, 3])[1] == "list" and model.judge((5,), [9])[1] == "prose"
    assert (line_model.fit(signs.limit(0)).emit == before.emit).all()


def test_empty_tables_and_nulls(spark, model, common):
    v = values(spark, [(None, None), ("", None), (" \n", "en")])
    for own in (v, v.limit(0)):
        assert text_statistics(own, common).where("kind is not null").count() == 0 and unnatural_texts(own, common).count() == 0
        assert language_cases(own, model, common, natural_only=["text"]).count() == 0
    row = text_statistics(v.where("row_idx = 1"), common).first()
    assert (row.words, row.lines, row.mean_word_length, row.prose_share) == (0, 0, 0.0, 0.0)
    twice = text_statistics(v.where("row_idx = 1").union(v.where("row_idx = 1")), common)
    assert twice.count() == 2


def test_bounds_of_samples(spark, common):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "ru").otherwise("de").alias("lang"), F.concat(F.lit("wort "), F.col("id").cast("string")).alias("text"))
    model = fit(many, common, most=20)
    assert {"ru", "de"} <= set(model.codes)
    with pytest.raises(ValueError):
        word_list(common, most=10)


def test_openings_and_copies():
    assert opening("I'm sorry, but I cannot help with Zorvex-5. Bye") == ["i", "m", "sorry", "but", "i", "cannot", "help", "with", "*", "0"]
    a = "explain how the model works and what it does".split()
    assert copies(a, a) and copies(a, ["you", "asked", *a][1:]) and not copies(a, [*a, *"it does so because of many other things that matter here".split()]) and not copies(a, [])


def test_broken_pairs(spark, model, common):
    ask = "Explain how the model reads the passages and what it does with the titles when traffic doubled."
    good = "The model reads the passages twice because the titles were missing. It was slow at first, and the team then removed the second pass. Nobody looked at it again until the spring release, when the cache was warm and the index had been rebuilt from the oldest shards."
    de = "Die Arbeitsgruppe prüfte das Modell nach der Freigabe und fand keine Abweichung, weil die Antworten gekürzt wurden."
    rows = [(ask, good), (ask, None), (ask, "[No answer]"), (ask, ask), (ask, "I'm sorry, but I cannot help with that model."), (ask, de), (ask + " Answer in German.", de), (None, good), (ask, good + " It was slo"), (ask, good[:-1])]
    rows += [(ask + f" Case {i}.", good) for i in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx bigint, instruction string, response string").withColumn("opening", F.lit(1))
    found = {r.row_idx: r.defect for r in broken_pairs(df, model, common).collect()}
    assert found == {1: "empty", 2: "empty", 3: "copy", 5: "other_language", 8: "truncated"}  # one refusal is no template
    assert broken_pairs(df.limit(0), model, common).count() == 0


def test_templates_reveal_refusals(spark, model, common):
    names = ["Zorvex", "Balim", "Krano", "Wimtar", "Solhes", "Pligol", "Tuvdem", "Ristan", "Molgar", "Fenwix"]
    rows = [(f"What does {n} do with the passages, number {i}?", f"We would prefer to leave the matter of {n} aside.") for i, n in enumerate(names)]
    rows += [(f"What is item {i}?", f"The item is number {i} of the list, and it was added because the others had been removed by the team before the spring release, so that nobody had to look for it again later on.") for i in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx bigint, instruction string, response string")
    assert {r.row_idx for r in broken_pairs(df, model, common).where("defect = 'refusal'").collect()} == set(range(10))


def test_templates_are_found_at_any_size(spark, model, common):
    names = [f"{a}{b}" for a in ("Zor", "Bal", "Kran", "Wim", "Sol", "Plig", "Tuv", "Rist") for b in ("vex", "im", "tar", "hes", "gol", "dem", "an", "wix")]
    asks = [f"item {i}a{i} part {i}b{i} what happens in {n} at step {i}c{i} of {i}d{i}, please tell me now as I need to know it" for i, n in enumerate(names)]
    rows = [(f"Note: {a}", f"We would prefer to leave the matter of {n} aside.") for n, a in zip(names, asks)]
    rows += [(f"Say what the oldest shard of the index holds after the spring release, run {i}.", f"It keeps a record of {n} there.") for i, n in enumerate(names)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx bigint, instruction string, response string")
    assert {r.row_idx for r in broken_pairs(df, model, common).where("defect = 'refusal'").collect()} == set(range(64))
    asked = spark.createDataFrame([(0, 1, "One two three four five."), (1, 1, "one two three four, five"), (2, 1, "Why"), (3, 1, "why?"), (4, 1, None), (5, 2, "six seven eight nine")], "row_idx bigint, template bigint, instruction string")
    assert {tuple(r) for r in unrelated_prompts(asked).collect()} == {(1, 3), (2, 1)}


def test_openings_go_on(model):
    assert opening("Sorry.\nI  cannot\nhelp. Bye") == ["sorry", "i", "cannot", "help"] and opening("  ") == [] and opening("...?!") == []
    assert opening("Zorvex-5 is something I have to refuse.", model.knows)[:2] == ["*", "0"]
    one = "The team found that the answer was not what they had in mind at all".lower().split()
    two = "Die Arbeitsgruppe und der Bericht sind nicht von der Art die wir mit dem Modell hatten".lower().split()
    assert model.alike(one, one[::-1]) and not model.alike(one, two) and not model.alike(one, []) and not model.alike(one[:1], one)


def test_bins():
    rng = random.Random(3)
    for most in (1, 4, 64):
        bins, held = OpenBins(100, most), {}
        for _ in range(2000):
            n = rng.randint(0, 100)
            b = bins.put(n)
            held[b] = held.get(b, 0) + n
            assert held[b] <= 100 and bins.open <= most
        assert 1 - sum(held.values()) / (100 * len(held)) < {1: 0.4, 4: 0.2, 64: 0.06}[most]


def test_packing(spark):
    rows = [(i, "word " * (i * 37 % 300)) for i in range(200)] + [(200, None), (201, ""), (202, "long word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("container", F.lit(1))
    sizes = spark.createDataFrame([(1, "a", 64), (2, "b", 1024)], "capacity_id int, capacity_name string, capacity_tokens int")
    out = pack(df, sizes).collect()
    full = {}
    for r in out:
        full[(r.capacity_id, r.container)] = full.get((r.capacity_id, r.container), 0) + r.tokens
    assert all(v <= {1: 64, 2: 1024}[k[0]] for k, v in full.items())
    for c, cap in ((1, 64), (2, 1024)):
        for doc in range(203):
            parts = sorted((r.part, r.start_token, r.tokens) for r in out if r.capacity_id == c and r.doc_id == doc)
            total = sum(p[2] for p in parts)
            assert parts and len(parts) == max(1, -(-total // cap)) and [p[1] for p in parts] == [i * cap for i in range(len(parts))]
    assert packing_report(pack(df, sizes), sizes).count() == 2
    assert pack(df.limit(0), sizes).count() == 0
    with pytest.raises(ValueError):
        pack(df, spark.createDataFrame([(1, "a", 0)], "capacity_id int, capacity_name string, capacity_tokens int"))


def test_fm_index_finds_all():
    rng = np.random.default_rng(1)
    for n in (1, 30, 3000):
        text = np.r_[rng.integers(0, 5, n), 0]
        index = FMIndex(text, 4)
        for width in (1, 3, 6):
            phrases = rng.integers(1, 5, (40, width))
            low, high = index.find(phrases)
            for p, a, b in zip(phrases, low, high):
                at = sorted(index.locate(np.arange(a, b)))
                assert at == [i for i in range(len(text) - width + 1) if (text[i : i + width] == p).all()]


def test_leaks(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(20), say(50)) for i in range(20)] + [(20, None, say(3)), (21, items_query := say(15), None)]
    docs = []
    for d in range(60):
        _, q, p = items[d % 20]
        cut = p.split()[: rng.choice([11, 12, 30])]
        docs.append((d, f"{say(rng.randint(0, 40))} zzz. {' '.join(cut).upper()}! qqq {say(5)}"))
    docs += [(100, None), (101, ""), (102, items_query), (102, "x"), (103, (say(40) + " ") * 200)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(1))
    held = spark.createDataFrame(items, "eval_index int, query string, passage string")
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {i: {tuple(w[k : k + 12]) for t in (q, p) for w in [norm(t)] for k in range(len(w) - 11)} for i, q, p in items}
    truth = {(d, i) for d, t in docs for w in [norm(t)] for g in [{tuple(w[k : k + 12]) for k in range(len(w) - 11)}] for i, own in grams.items() if g & own}
    assert len(truth) > 20
    for how in ({}, {"block": 40, "shard": 50}, {"shard": 13}):
        assert {tuple(r) for r in leaked_items(corpus, held, **how).collect()} == truth
    spans = {r.doc_id: (r.first_word, r.last_word) for r in removal_spans(corpus, held).collect()}
    assert spans[102] == (0, 14)
    assert leaked_phrases(corpus.limit(0), held).count() == 0 and leaked_phrases(corpus, held.limit(0)).count() == 0


def test_bitmap(spark):
    keys = spark.range(0, 5000, 7).select((F.col("id") * 1_000_003).alias("key"))
    own = np.arange(0, 5000, 7) * 1_000_003
    for most in (1 << 28, 1 << 10):  # the second is full
        cells = bitmap(keys, keys.count(), most=most)
        assert cells.passes(own).all() and (most < 1 << 20 or cells.passes(own + 1).mean() < 0.1)
    assert not bitmap(keys.limit(0), 0).passes(own).any()
    levels = bitmap(keys.withColumn("level", F.lit(5)).union(keys.limit(1).withColumn("level", F.lit(7))), 800, planes=3)
    assert set(levels.levels(own)) == {5, 7} and bitmap(spark.createDataFrame([(None,)], "key bigint"), 1).levels(own).sum() == 0


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    from corpusmill.llm import bitmap as module
    from corpusmill.llm.near_duplicates import near_duplicate_pairs
    from corpusmill.llm.split_overlap import split_overlap_pairs

    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts = [say(40) + rng.choice([".", "", " and th"]) for _ in range(60)]
    rows = [(i, t, "train" if i < 60 else "eval") for i, t in enumerate(texts + [t + " more of it" for t in texts[:30]])]
    df = spark.createDataFrame(rows, "row_idx bigint, text string, split string")

    def found():
        pairs = {tuple(r) for r in near_duplicate_pairs(df, F.col("text"), width=3, least=0.6, bags=False).collect()}
        across = {tuple(r) for r in split_overlap_pairs(df, F.col("text"), F.col("split") == "train", width=3, least=0.6).collect()}
        ends = {(r.id, r.mark, round(r.odds, 9)) for r in open_endings(df.select(F.col("row_idx").alias("id"), "text")).collect()}
        return pairs, across, ends

    sized = found()
    monkeypatch.setattr(module, "MOST", 64)
    assert sized == found() and all(sized)


def test_endings():
    assert ending("All is done.")[0] == "done" and ending("All is done. (end)")[0] == "done" and ending("It is done [trunc")[:2] == ("open", "torn")
    assert ending("and then he said...")[:2] == ("open", "omitted") and ending("text\n\n- an item")[0] == "listed" and ending("text\n\n-- the group")[0] == "listed"
    assert ending("| a | b |\n| c | d |")[0] == "listed" and ending("x = 1\n```\ncode(a)\n```")[0] == "listed" and ending("stops in the midd")[0] == "open"


def test_cuts(spark):
    rng = random.Random(8)
    sentences = ["The team removed the second pass because it was slow.", "Nobody looked at the titles in the spring release.", "The index stayed small after the long rebuild.", "Two readers compared the answers with the older ones."]
    rows, cut = [], set()
    for i in range(900):
        text = " ".join(rng.choice(sentences) for _ in range(rng.randint(3, 12)))
        if i % 3 == 0 and len(text) > 300:
            text = text[:300]
            if text[-1] not in ". " and not text.endswith(tuple(s[:-1] for s in sentences)):
                cut.add(i)
        elif i % 10 == 1:
            text = text[:-1]
        rows.append((i, text, [" Site", "site"][i % 2]))
    rows += [(2000, None, "site"), (2001, " ", None), (2002, "Nobody looked at the titles in the spri &am", "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("length", F.lit(0)).withColumn("odds", F.lit(0))
    found = {r.doc_id for r in truncated_texts(df).collect()}
    assert len(cut) > 100 and len(found & cut) >= 0.97 * len(cut) and 2002 in found
    assert all(len(rows[i][1]) == 300 for i in found - cut - {2002})  # cut between the last word and its mark
    sized = df.where("text is not null").select(F.lower(F.trim("source")).alias("source"), "text", F.length("text").alias("length"))
    peaks = length_hazards(sized).where("significant").orderBy("p").collect()  # few sentences make peaks of their own
    assert (peaks[0].source, peaks[0].length) == ("site", 300)
    report = {r.source: r for r in truncation_report(df).collect()}
    assert report["site"].texts == 901 and report["site"].truncated > 100 and report[""].truncated == 0
    assert truncated_texts(df.limit(0)).count() == 0 and open_endings(df.select(F.col("doc_id").alias("id"), "text").limit(0)).count() == 0
