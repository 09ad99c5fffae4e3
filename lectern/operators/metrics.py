"""Quality of transcripts against what they should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.similarity import word_distance


def nearest_segment(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Each sample (video_id, sample_s, …) with the segment of its video that starts nearest, the first by id on a tie."""
    cols = [c for c in samples.columns if c != "video_id"]
    x = samples.join(segments.select("video_id", "id", "start_s", "text"), "video_id")
    near = F.min_by(F.struct("id", "start_s", "text"), F.struct(F.abs(F.col("start_s") - F.col("sample_s")), "id"))
    x = x.where("start_s is not null").groupBy("video_id", *cols).agg(near.alias("x"))
    return x.select("video_id", *cols, F.col("x.id").alias("id"), F.col("x.start_s").alias("start_s"), F.col("x.text").alias("text"))


def found_terms(text: Column, terms: Column) -> Column:
    """How many of an array of terms stand in a text as they are."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def recall(text: Column, terms: Column) -> Column:
    """The found part of the terms in percent; null without terms."""
    return F.when(F.size(terms) > 0, found_terms(text, terms) * 100.0 / F.size(terms))


def forbidden(text: Column, terms: Column) -> Column:
    """How many forbidden terms stand in a text; null without terms."""
    return F.when(F.size(terms) > 0, found_terms(text, terms))


def word_error_rate(reference: Column, heard: Column) -> Column:
    """Edit distance in words over the words of the reference; null where that is blank."""
    ref = T.tokens(reference)
    return F.when(F.size(ref) > 0, word_distance(ref, T.tokens(heard)) / F.size(ref))


def real_time_factor(processing: Column, length: Column) -> Column:
    return processing / F.greatest(F.coalesce(length, F.lit(0.0)), F.lit(1e-4))


def mean_word_error_rate(samples: DataFrame, keys: list[str], reference: str, heard: str) -> DataFrame:
    """``keys, n_samples, mean_wer``: the mean over samples in percent, two decimals; blank references are left out."""
    x = samples.withColumn("__w", word_error_rate(F.col(reference), F.col(heard))).where("__w is not null")
    return x.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.round(F.avg("__w") * 100, 2).alias("mean_wer"))


def token_sums(asked: DataFrame) -> DataFrame:
    """``video_id, tokens_in, tokens_out``: what the batches of each video took."""
    return asked.groupBy("video_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def score_grid(videos: DataFrame, backends: list[str], models: list[str]) -> DataFrame:
    """A row for each video, backend and model to be tried."""
    return videos.select("*", F.explode(F.array(*map(F.lit, backends))).alias("backend")).select("*", F.explode(F.array(*map(F.lit, models))).alias("model"))


def counters(decided: DataFrame) -> DataFrame:
    """What happened to the segments of each video: flagged, asked, corrected by whom, rejected, left for review.

    ``decided``: video_id, flags, n_case, rule_hits, asked, accepted, rejected_reason, needs_review.
    """
    n = lambda c, name: F.count_if(c).alias(name)
    x = decided.groupBy("video_id").agg(
        n(F.size("flags") > 0, "flagged"), n(F.col("asked"), "sent_to_llm"), n(F.col("accepted"), "applied_llm"),
        F.sum(F.size("rule_hits")).alias("applied_rule"), F.sum("n_case").cast("bigint").alias("applied_case"),
        n(F.col("rejected_reason").isNotNull(), "rejected"), n(F.col("needs_review"), "needs_review"),
    )
    return x.withColumn("corrected", F.col("applied_case") + F.col("applied_rule") + F.col("applied_llm"))
