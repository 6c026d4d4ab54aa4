"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .broken_pairs import broken_pairs
from .formatting import format_copies, format_copy_rows
from .language_labels import fit, language_cases, language_report, language_segments
from .leaks import leaked_items, removal_spans
from .lineage import cut
from .near_duplicates import near_duplicate_pairs, near_duplicates
from .packing import pack, packing_report
from .split_overlap import overlap_report, split_overlap_pairs
from .sql import SQL  # noqa: F401
from .text_statistics import text_statistics, unnatural_texts
from .truncation import length_hazards, truncated_texts, truncation_report
from .values import long_form


def titled():
    """A retrieval record: its title, a line break and its text."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))


def paired():
    """An instruction, a line break and its response."""
    return F.concat(F.coalesce("instruction", F.lit("")), F.lit("\n"), F.coalesce("response", F.lit("")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "rag_corpus"), titled(), width=3, least=0.6, bags=False)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's class and group at five words and 0.8, and the group's size."""
    rows = near_duplicates(table(spark, sf_dir, "rag_corpus"), titled())
    return rows.join(rows.groupBy("root").agg(F.count("*").alias("group_size")), "root").select("row_idx", "class_id", "root", "group_size")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rag = format_copy_rows(table(spark, sf_dir, "rag_corpus"), fielded=["text"])
    sft = format_copy_rows(table(spark, sf_dir, "sft_instructions"), plain=["instruction"], fielded=["response"])
    rag, sft = (x.select(F.lit(n).alias("table_name"), "*") for x, n in ((rag, "rag_corpus"), (sft, "sft_instructions")))
    return rag.unionByName(sft)


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept row of each group and its number of copies, of both tables."""
    rag = format_copies(table(spark, sf_dir, "rag_corpus"), fielded=["text"])
    sft = format_copies(table(spark, sf_dir, "sft_instructions"), plain=["instruction"], fielded=["response"])
    rag, sft = (x.select(F.lit(n).alias("table_name"), "*") for x, n in ((rag, "rag_corpus"), (sft, "sft_instructions")))
    return rag.unionByName(sft)


def p2_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of retrieval texts by their letters and digits alone, named fields in their order."""
    return format_copies(table(spark, sf_dir, "rag_corpus"), plain=["text"], fielded=[])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of both tables that have a declared language."""
    rag, sft = table(spark, sf_dir, "rag_corpus"), table(spark, sf_dir, "sft_instructions")
    return long_form(
        [
            (rag, "rag_corpus", "text", "lang"),
            (sft, "sft_instructions", "instruction", "instruction_lang"),
            (sft, "sft_instructions", "response", "response_lang"),
        ]
    )


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that should be prose."""
    rag, sft = table(spark, sf_dir, "rag_corpus"), table(spark, sf_dir, "sft_instructions")
    return long_form([(rag, "rag_corpus", "text", None), (sft, "sft_instructions", "response", None)])


def language_model(spark: SparkSession, sf_dir: str):
    return fit(table(spark, sf_dir, "lang_sample"), table(spark, sf_dir, "common_word"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = labelled(spark, sf_dir)
    return language_cases(values, language_model(spark, sf_dir), table(spark, sf_dir, "common_word"), natural_only=["text", "response"])


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's language and confidence."""
    return language_segments(labelled(spark, sf_dir), language_model(spark, sf_dir))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared labels against the languages found."""
    return language_report(labelled(spark, sf_dir), language_model(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnatural_texts(written(spark, sf_dir), table(spark, sf_dir, "common_word"))


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value's statistics, shares and kind."""
    return text_statistics(written(spark, sf_dir), table(spark, sf_dir, "common_word"))


def p4_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every value's statistics those of its words."""
    found = p4_statistics(spark, sf_dir)
    return found.select("table_name", "row_idx", "words", *(F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_ratio", "common_share")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "sft_instructions"), language_model(spark, sf_dir), table(spark, sf_dir, "common_word"))


def p5_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs without an answer."""
    return p5_found(spark, sf_dir).where("defect = 'empty'").select("row_idx")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and defects per source."""
    pairs = table(spark, sf_dir, "sft_instructions")
    found = p5_found(spark, sf_dir)
    source = F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source")
    joined = pairs.select("row_idx", source).join(found, "row_idx", "left")
    return joined.groupBy("source", F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count("*").alias("pairs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap_pairs(table(spark, sf_dir, "sft_instructions"), paired(), F.lower(F.trim("split")) == "train", width=3, least=0.6)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and source at five words and 0.8."""
    return overlap_report(table(spark, sf_dir, "sft_instructions"), paired(), F.lower(F.trim("split")) == "train")


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's containers of each size."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused share of each size."""
    sizes = table(spark, sf_dir, "pack_capacity")
    return packing_report(pack(table(spark, sf_dir, "documents"), sizes), sizes)


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each size the documents packed, containers that hold too much, documents divided though they fit, and documents whose parts leave a gap."""
    sizes = table(spark, sf_dir, "pack_capacity")
    packed = cut(pack(table(spark, sf_dir, "documents"), sizes))
    room = F.broadcast(sizes.select("capacity_id", "capacity_tokens"))
    full = packed.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("n")).join(room, "capacity_id")
    full = full.groupBy("capacity_id").agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("bigint")).alias("overfull_containers"))
    docs = packed.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("parts"), F.max(F.col("start_token") + F.col("tokens")).alias("end")).join(room, "capacity_id")
    divided, gaps = (F.col("parts") > 1) & (F.col("n") <= F.col("capacity_tokens")), F.col("end") != F.col("n")
    docs = docs.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.sum(divided.cast("bigint")).alias("needlessly_divided"), F.sum(gaps.cast("bigint")).alias("with_gaps"))
    return docs.join(full, "capacity_id").select("capacity_id", "documents", "overfull_containers", "needlessly_divided", "with_gaps")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.select("doc_id", F.col("item").cast("int").alias("eval_index"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of words to remove from each document, with the items they come from."""
    found = removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_texts(table(spark, sf_dir, "documents")).select("doc_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of each source."""
    return truncation_report(table(spark, sf_dir, "documents"))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths at which texts of a source end significantly often."""
    df = table(spark, sf_dir, "documents").where("text is not null")
    source = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    return length_hazards(df.select(source.alias("source"), "text", F.length("text").alias("length"))).where("significant")


def p9_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of a source end at each length, of how many that long, and how many are to be expected by the lengths around."""
    df = table(spark, sf_dir, "documents").where("text is not null")
    source = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    found = length_hazards(df.select(source.alias("source"), "text", F.length("text").alias("length")))
    return found.select("source", "length", "texts", "at_risk", F.round("expected", 6).alias("expected"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p2_plain": p2_plain,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_statistics": p4_statistics,
    "p4_words": p4_words,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_empty": p5_empty,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_assignment": p7_assignment,
    "p7_report": p7_report,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_limits": p9_limits,
    "p9_hazards": p9_hazards,
}
