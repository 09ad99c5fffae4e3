"""Queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import forms, leakage, levels, packing, repetition, runs, sentences
from lectern.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    x = repetition.repetitive(table(spark, sf, "segments_raw"), ["video_id", "id"])
    return x.select("video_id", F.col("id").alias("seg_id"))


def p1_by_video(spark: SparkSession, sf: str) -> DataFrame:
    """Repetitive segments of each video and their mean share."""
    x = repetition.repetitive(table(spark, sf, "segments_raw"), ["video_id", "id"])
    return x.groupBy("video_id").agg(F.count("*").alias("n_segments"), F.round(F.avg("repeated_share"), 6).alias("mean_share"))


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The repeated share of every segment."""
    x = repetition.with_every_share(table(spark, sf, "segments_raw").select("video_id", "id", "text")).where("text is not null")
    return x.groupBy("video_id", F.col("id").alias("seg_id")).agg(F.round(F.max("repeated_share"), 6).alias("repeated_share"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse(table(spark, sf, "segments_raw")).select("video_id", "first_id", "last_id")


def p2_events(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse(table(spark, sf, "segments_raw"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the three tables that holds text: ``kind, key_a, key_b, text``."""
    seg = table(spark, sf, "segments_raw").select(F.lit("segment").alias("kind"), F.col("video_id").alias("key_a"), F.col("id").alias("key_b"), "text")
    rule = table(spark, sf, "correction_rules").select(F.lit("rule").alias("kind"), F.col("rule_id").alias("key_a"), F.lit(0).cast("bigint").alias("key_b"), F.col("from_text").alias("text"))
    term = table(spark, sf, "glossary_files").select(F.col("glossary_id").alias("key_a"), F.posexplode("terms").alias("key_b", "text"))
    term = term.select(F.lit("term").alias("kind"), "key_a", F.col("key_b").cast("bigint").alias("key_b"), "text")
    return seg.unionByName(rule).unionByName(term)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    x = forms.deviations(_values(spark, sf)).where("deviates")
    return x.select("kind", "key_a", "key_b").distinct()


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return forms.same_looking(_values(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    x = sentences.sentences(table(spark, sf, "segments_raw"), ["video_id", "id"]).where("sentence_no > 0")
    return x.select("video_id", F.col("id").alias("seg_id"), "begin_char").distinct()


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """All sentence units, exact copies of a segment once."""
    x = sentences.sentences(table(spark, sf, "segments_raw"), ["video_id", "id"])
    return x.groupBy("video_id", "id", "sentence_no", "begin_char", "end_char").agg(F.max("sentence").alias("sentence"))


def p3_unmarked(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of texts read without regard to marks: any likely boundary ends one, except the first of each segment."""
    x = sentences.sentences(table(spark, sf, "segments_raw"), ["video_id", "id"], unmarked=True).where("sentence_no > 0")
    return x.select("video_id", F.col("id").alias("seg_id"), "begin_char").distinct()


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.assign(table(spark, sf, "documents"), table(spark, sf, "pack_targets"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p8_pack(spark, sf), table(spark, sf, "pack_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("item_id", "doc_id")


def p9_by_item(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the documents that hold them and the largest part that one of them gives."""
    x = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return x.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.round(F.max("part"), 6).alias("largest_part"))


def p9_longest(spark: SparkSession, sf: str) -> DataFrame:
    """The longest verbatim match of each item in the whole corpus, and where it is."""
    return leakage.longest_matches(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold no passage of an item."""
    return leakage.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    x = levels.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))
    return x.where("demanding").select("doc_id")


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """How the harmonic rounds come to rest."""
    return levels.rounds(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_video, p1_shares, p2_found, p2_events, p3_found, p3_sentences, p3_unmarked, p5_found, p5_groups, p8_pack, p8_fill, p9_found, p9_by_item, p9_longest, p9_kept, p10_found, p10_levels, p10_rounds)}
ORACLE: dict[str, str] = {}
