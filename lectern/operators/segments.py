"""Segments as the operators below take them: each once, with its neighbours, checks and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Limits beyond which a segment is flagged.
LOW_LOGPROB, HIGH_NOSPEECH, HIGH_COMPRESSION = -0.70, 0.60, 2.4
ACCEPT = 0.85
FAST_CHARS_A_SECOND, SHORT_SECONDS, SHORT_CHARS, LEAST_SECONDS = 25.0, 0.35, 12, 0.001
#: One or two words, said four times or more on end.
REPEATED = r"(?iuU)\b(\w+(?:\s+\w+)?)\b(?:\s+\1\b){3,}"


def once(segments: DataFrame) -> DataFrame:
    """Exact copies of a segment once."""
    return segments.dropDuplicates(["video_id", "id"])


def with_neighbours(segments: DataFrame, text: str = "text") -> DataFrame:
    """``prev`` and ``next``: the texts beside each segment by id, empty at the ends and for null."""
    w = Window.partitionBy("video_id").orderBy("id")
    t = F.coalesce(F.col(text), F.lit(""))
    return segments.withColumn("prev", F.lag(t, 1, "").over(w)).withColumn("next", F.lead(t, 1, "").over(w))


def flags_of(text: str = "text", near_miss: Column | None = None, candidate: Column | None = None) -> Column:
    """Names of all checks that a segment fails, in a fixed order. Null scores and NaN fail none, null text is empty."""
    t = T.strip(F.coalesce(F.col(text), F.lit("")))
    seconds = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(LEAST_SECONDS))
    above = lambda c, x: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > x)
    checks = [
        ("LOW_LOGPROB", F.col("avg_logprob") < LOW_LOGPROB),
        ("HIGH_NOSPEECH", above("no_speech_prob", HIGH_NOSPEECH)),
        ("HIGH_COMPRESSION", above("compression_ratio", HIGH_COMPRESSION)),
        ("REPETITION", F.regexp_like(t, F.lit(REPEATED))),
        ("FAST_TEXT", F.length(t) / seconds > FAST_CHARS_A_SECOND),
        ("SHORT_SEGMENT", (seconds < SHORT_SECONDS) & (F.length(t) > SHORT_CHARS)),
    ]
    checks += [("GLOSSARY_NEAR_MISS", near_miss)] if near_miss is not None else []
    checks += [("CORRECTION_CANDIDATE", candidate)] if candidate is not None else []
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks]))


def flag_histogram(flagged: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """``keys, flag, n``; with ``top``, the most frequent of each key, ties by first appearance (id, then place)."""
    x = flagged.select(*keys, "id", F.posexplode("flags").alias("place", "flag"))
    x = x.groupBy(*keys, "flag").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("first"))
    if top is None:
        return x.drop("first")
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first", "flag")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("first")


def gate(raw: Column, corrected: Column, changed: Column, confidence: Column, shared: Column, least: float = ACCEPT) -> Column:
    """Why a proposed text is refused, the first reason holding; null where it is accepted or nothing is proposed.

    ``raw`` and ``corrected`` are stripped, ``shared`` is the length of their common subsequence. Null confidence is 0.
    """
    a, b = F.length(raw), F.length(corrected)
    words = lambda c: F.size(T.tokens(c))
    return (
        F.when(~F.coalesce(changed, F.lit(False)), F.lit(None).cast("string"))
        .when(corrected.isNull() | (corrected == ""), F.lit("empty_correction"))
        .when(corrected == raw, F.lit("identical_to_raw"))
        .when(F.coalesce(confidence, F.lit(0.0)) < least, F.lit(f"confidence_below_{least:.2f}"))
        .when(shared * 200 < (a + b) * 60, F.lit("fuzz_ratio_below_60"))
        .when((b * 10 < F.greatest(a, F.lit(1)) * 7) | (b * 10 > F.greatest(a, F.lit(1)) * 14), F.lit("length_ratio_outside_0.7_1.4"))
        .when(T.digit_runs(raw) != T.digit_runs(corrected), F.lit("numbers_modified"))
        .when(F.abs(words(raw) - words(corrected)) > 3, F.lit("word_count_diff_exceeds_3"))
    )


def batches(flagged: DataFrame, size: int = 10) -> DataFrame:
    """``batch``: flagged segments of a video in groups of ``size`` by id."""
    w = Window.partitionBy("video_id").orderBy("id")
    return flagged.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def request_hash(model: Column, text: str = "text") -> Column:
    """The key under which an answer for a segment in its surroundings is cached; needs ``prev``, ``next``, ``flags``."""
    parts = [F.coalesce(model, F.lit("None")), F.lit("v1"), F.col("prev"), F.coalesce(F.col(text), F.lit("")), F.col("next"), F.array_join(F.array_sort("flags"), ",")]
    return F.sha2(F.concat_ws(":", *parts), 256)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: how a replacing insert leaves a table. Combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return x.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def chosen(raw: DataFrame, corrected: DataFrame) -> DataFrame:
    """The corrected segments of each video that has any, and the raw ones of the others."""
    have = corrected.select("video_id").distinct()
    return corrected.unionByName(raw.join(have, "video_id", "left_anti"), allowMissingColumns=True)


def fresh_over(cached: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Cached and fresh answers together; where both are, the fresh one holds."""
    return fresh.unionByName(cached.join(fresh.select(*keys), keys, "left_anti"))


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, to ask): requests by (video_id, id, request_hash) with their cached answer, and those without.

    Answers that are no JSON are as good as none.
    """
    keys = ["video_id", "id", "request_hash"]
    good = cache.where(F.try_parse_json("answer").isNotNull()).select(*keys, "answer")
    return requests.join(good, keys), requests.join(good, keys, "left_anti")


ANSWER = "id bigint, changed boolean, corrected string, reason string, confidence double, needs_review boolean"


def decide(segments: DataFrame, answers: DataFrame, least: float = ACCEPT) -> DataFrame:
    """Segments joined with the last answer of each and the gate's verdict.

    ``segments`` has video_id, id, raw_text, text (after the rules), flags; ``answers`` has video_id, ord and the fields of
    ANSWER. Adds ``accepted``, ``rejected_reason``, ``needs_review``, and ``text`` is replaced where accepted. Flagged
    segments without an answer need review, unflagged ones don't; answers to unknown segments are ignored.
    """
    from lectern.functions.similarity import common

    last = latest(answers, ["video_id", "id"], ["ord"]).withColumn("answered", F.lit(True))
    x = segments.join(last.select("video_id", "id", "changed", "corrected", "confidence", F.col("needs_review").alias("doubt"), "answered"), ["video_id", "id"], "left")
    raw, new = T.strip("raw_text"), T.strip("corrected")
    x = x.withColumn("rejected_reason", gate(raw, new, F.col("changed"), F.col("confidence"), common(raw, new), least))
    x = x.withColumn("accepted", F.coalesce(F.col("changed"), F.lit(False)) & F.col("rejected_reason").isNull())
    flagged = F.size("flags") > 0
    review = F.when(F.col("answered").isNull(), flagged).when(F.col("rejected_reason").isNotNull(), True).when(F.col("accepted"), F.coalesce("doubt", F.lit(False))).otherwise(F.coalesce("doubt", F.lit(False)))
    return x.withColumn("needs_review", review).withColumn("text", F.when(F.col("accepted"), new).otherwise(F.col("text"))).drop("changed", "corrected", "doubt", "answered")


def projected(items: DataFrame) -> DataFrame:
    """Recognised items of a window as segments of their video: offset by the window's start, cut at its end, given at
    least 0.1 s, in milliseconds, numbered by window and place, empty texts left out.

    ``items``: video_id, window_index, place, window_start, window_end, start_s, end_s, text.
    """
    x = items.withColumn("text", T.strip("text")).where(F.length("text") > 0)
    s = F.rint((F.col("window_start") + F.col("start_s")) * 1000)
    e = F.rint(F.least(F.col("window_start") + F.col("end_s"), F.col("window_end")) * 1000)
    x = x.withColumn("start_ms", s.cast("bigint")).withColumn("end_ms", F.when(e <= s, s + 100).otherwise(e).cast("bigint"))
    w = Window.partitionBy("video_id").orderBy("window_index", "place")
    return x.select("video_id", (F.row_number().over(w) - 1).cast("bigint").alias("id"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text", "window_index")
