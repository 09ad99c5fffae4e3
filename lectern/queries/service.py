"""Queries of the operators around the service: cache, answers, gate, usage, choice of source, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import metrics, segments, state
from lectern.plans import pipeline, report
from lectern.queries.reference import _SEG, _W, _WORDS, _human, _segments, _strip, _tokens, request_keys
from lectern.session import table
from lectern.sinks import render


class Counting:
    """Answers that nothing changes, and counts characters in and answers out as tokens."""

    tokens_in = tokens_out = 0

    def __call__(self, batch: list[dict]) -> list[dict]:
        self.tokens_in += sum(len(r["text"] or "") for r in batch)
        self.tokens_out += len(batch)
        return [{"id": r["id"], "changed": False, "confidence": 1.0, "needs_review": r["id"] % 10 == 0} for r in batch]


def video_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup past all selections: the first path of the listing."""
    videos = table(spark, sf, "videos")
    return state.by_path(videos, videos.agg(F.min("path")).first()[0]).select("id", "path", "status")


def files_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "videos").select("path", "size_bytes").orderBy("path")


def cache_after_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Cached answers left when the failed videos are reset."""
    reset = table(spark, sf, "videos").where("status = 'FAILED'").select(F.col("id").alias("video_id"))
    return state.without_cache_of(_segments(spark, sf), reset).groupBy("video_id").agg(F.count("*").alias("n"))


def merged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Cached answers for even ids and fresh ones for those divisible by three: the fresh ones hold."""
    x = _segments(spark, sf)
    cached = x.where("id % 2 = 0").withColumn("origin", F.lit("cached"))
    fresh = x.where("id % 3 = 0").withColumn("origin", F.lit("fresh"))
    return segments.fresh_over(cached, fresh, ["video_id", "id"]).groupBy("video_id", "origin").agg(F.count("*").alias("n"))


def latest_sightings(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each video, as a replacing insert leaves a table."""
    x = table(spark, sf, "video_scans").select("video_id", "run_id", "seen_at", "size_bytes", "status")
    return segments.latest(x, ["video_id"], ["run_id", "seen_at"]).select("video_id", "run_id", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"), "status")


def chosen_source(spark: SparkSession, sf: str) -> DataFrame:
    """Corrected segments where a video has any, raw ones elsewhere."""
    raw = _segments(spark, sf, "text").withColumn("source", F.lit("raw"))
    corrected = raw.where("video_id % 3 = 0 and text is not null").withColumn("source", F.lit("corrected"))
    return segments.chosen(raw, corrected).groupBy("video_id", "source").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def spoken_texts(spark: SparkSession, sf: str) -> DataFrame:
    return render.spoken(_segments(spark, sf, "text"))


def _proposed(x: DataFrame) -> DataFrame:
    """Deterministic proposals for every text, one kind for each remainder of the id."""
    raw = T.strip(F.coalesce("text", F.lit("")))
    kinds = [raw, F.concat(raw, F.lit("!")), F.concat(raw, F.lit(" 7")), F.lit(""), F.concat(raw, F.lit(" "), raw), F.concat(raw, F.lit(" a b c d"))]
    new = F.lit(None).cast("string")
    for k, c in enumerate(kinds):
        new = F.when(F.col("id") % 6 == k, c).otherwise(new)
    return x.select("video_id", "id", raw.alias("raw"), new.alias("corrected"), F.when(F.col("id") % 11 == 0, 0.5).otherwise(0.9).alias("confidence"))


def gate_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The gate over whole texts: what becomes of a proposal for each segment."""
    from lectern.functions.similarity import common

    x = _proposed(_segments(spark, sf, "text"))
    verdict = segments.gate(F.col("raw"), F.col("corrected"), F.lit(True), F.col("confidence"), common(F.col("raw"), F.col("corrected")))
    return x.select("video_id", "id", F.coalesce(verdict, F.lit("accepted")).alias("verdict"))


def decided_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all segments asked in batches, joined with their answers and decided."""
    x = segments.with_neighbours(_segments(spark, sf, "text")).withColumn("flags", F.when(F.col("id") % 4 == 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")))
    asked = pipeline.ask(x.where("id % 4 = 0 and id % 8 = 0"), Counting(), 10)
    y = segments.decide(x.withColumn("raw_text", F.col("text")), pipeline.answers_of(asked))
    return y.groupBy("video_id").agg(F.count_if("needs_review").alias("needs_review"), F.count_if("accepted").alias("accepted"), F.count("*").alias("n"))


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of all requests, summed over the batches of each video."""
    x = segments.with_neighbours(_segments(spark, sf, "text")).withColumn("flags", F.array().cast("array<string>"))
    return metrics.token_sums(pipeline.ask(x, Counting(), 10))


def cached_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by their key against a cache with broken answers: these are asked again."""
    asked = request_keys(spark, sf)
    cache = asked.where("video_id % 2 = 0").withColumn("answer", F.when(F.col("id") % 5 == 0, F.lit("{broken")).otherwise(F.lit('{"changed": false}')))
    hit, miss = segments.split_cached(asked, cache)
    return hit.select("video_id", "id", F.lit("hit").alias("outcome")).unionByName(miss.select("video_id", "id", F.lit("miss").alias("outcome")))


def mean_wer(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_word_error_rate(table(spark, sf, "correction_rules").select("match_kind", "from_text", "to_text"), ["match_kind"], "to_text", "from_text")


def word_confidences(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each segment with a probability by their length; every second video is timed by words."""
    x = _segments(spark, sf, "text")
    words = F.transform(T.tokens(F.coalesce("text", F.lit(""))), lambda w: F.struct(w.alias("word"), (F.lit(1.0) / F.length(w)).alias("probability")))
    return x.select("video_id", "id", F.round(report.word_confidence(words, F.col("video_id") % 2 == 0), 6).alias("confidence"))


def completion_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is told when a video is done."""
    v = table(spark, sf, "videos").join(table(spark, sf, "transcripts").distinct().select(F.col("video_id").alias("id"), "processing_seconds"), "id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return v.select("id", report.completed(F.col("path"), F.col("duration_seconds"), F.col("processing_seconds"), n("segment_count"), n("needs_review_count")).alias("message"))


def terms_by_length(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct terms in the order in which they are spelled: the longest first, then as the files have them."""
    x = table(spark, sf, "glossary_files").select("glossary_id", F.posexplode("terms").alias("place", "term")).where(F.length(T.strip("term")) > 0)
    x = x.groupBy("term").agg(F.min(F.struct("glossary_id", "place")).alias("first"))
    return x.select("term", F.row_number().over(Window.orderBy(F.desc(F.length("term")), "first")).cast("bigint").alias("place"))


def prompt_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The first terms of the glossary, which a request shows: a limit that is the feature."""
    x = table(spark, sf, "glossary_files").select("glossary_id", F.posexplode("terms").alias("place", "term")).where(F.length(T.strip("term")) > 0)
    x = x.groupBy("term").agg(F.min(F.struct("glossary_id", "place")).alias("first"))
    return x.orderBy("first").limit(report.TERMS_SHOWN).select("term")


QUERIES = {
    f.__name__: f
    for f in (
        video_by_path, files_by_path, cache_after_reset, merged_answers, latest_sightings, chosen_source, spoken_texts, gate_segments, decided_segments, token_usage, cached_requests, mean_wer,
        word_confidences, completion_texts, terms_by_length, prompt_terms,
    )
}

_RAW = _strip("coalesce(text, '')")
_TERMS = f"t AS (SELECT glossary_id AS g, generate_subscripts(terms, 1) AS p, unnest(terms) AS term FROM glossary_files), f AS (SELECT term, min((g, p)) AS first FROM t WHERE length({_strip('term')}) > 0 GROUP BY term)"

ORACLE = {
    "video_by_path": "SELECT id, path, status FROM videos WHERE path = (SELECT min(path) FROM videos)",
    "files_by_path": "SELECT path, size_bytes FROM videos ORDER BY path",
    "cache_after_reset": f"WITH {_SEG} SELECT video_id, count(*) AS n FROM seg WHERE video_id NOT IN (SELECT id FROM videos WHERE status = 'FAILED') GROUP BY video_id",
    "merged_answers": f"WITH {_SEG} SELECT video_id, CASE WHEN id % 3 = 0 THEN 'fresh' ELSE 'cached' END AS origin, count(*) AS n FROM seg WHERE id % 2 = 0 OR id % 3 = 0 GROUP BY 1, 2",
    "latest_sightings": "SELECT video_id, run_id, coalesce(size_bytes, -1) AS size_bytes, status FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY run_id DESC, seen_at DESC) AS k FROM video_scans) q WHERE k = 1",
    "chosen_source": f"""WITH {_SEG}, have AS (SELECT DISTINCT video_id FROM seg WHERE video_id % 3 = 0 AND text IS NOT NULL)
SELECT s.video_id, CASE WHEN h.video_id IS NULL THEN 'raw' ELSE 'corrected' END AS source, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars
FROM seg s LEFT JOIN have h ON h.video_id = s.video_id WHERE h.video_id IS NULL OR s.text IS NOT NULL GROUP BY 1, 2""",
    "spoken_texts": f"""WITH {_SEG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id) AS no FROM seg)
SELECT video_id, (no - 1) // 1000 AS part, count(*) AS n_cues, string_agg(coalesce(text, ''), ' ' ORDER BY no) AS content FROM numbered GROUP BY 1, 2""",
    "gate_segments": rf"""WITH {_SEG}, r AS (SELECT video_id, id, {_RAW} AS a FROM seg), p AS (SELECT *, CASE id % 6 WHEN 0 THEN a WHEN 1 THEN a || '!' WHEN 2 THEN a || ' 7' WHEN 3 THEN '' WHEN 4 THEN a || ' ' || a ELSE a || ' a b c d' END AS b FROM r)
SELECT video_id, id, CASE WHEN b = '' THEN 'empty_correction' WHEN a = b THEN 'identical_to_raw' WHEN id % 11 = 0 THEN 'confidence_below_0.85'
  WHEN length(a) * 200 < (length(a) + length(b)) * 60 THEN 'fuzz_ratio_below_60' WHEN length(b) * 10 < greatest(length(a), 1) * 7 OR length(b) * 10 > greatest(length(a), 1) * 14 THEN 'length_ratio_outside_0.7_1.4'
  WHEN regexp_extract_all(a, '\p{{Nd}}+') <> regexp_extract_all(b, '\p{{Nd}}+') THEN 'numbers_modified' WHEN abs(len({_tokens("a")}) - len({_tokens("b")})) > 3 THEN 'word_count_diff_exceeds_3' ELSE 'accepted' END AS verdict FROM p""",
    "decided_segments": f"""WITH {_SEG} SELECT video_id, count(*) FILTER (CASE WHEN id % 8 = 0 THEN id % 10 = 0 ELSE id % 4 = 0 END) AS needs_review, 0::BIGINT AS accepted, count(*) AS n FROM seg GROUP BY video_id""",
    "token_usage": f"WITH {_SEG} SELECT video_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS tokens_in, count(*) AS tokens_out FROM seg GROUP BY video_id",
    "cached_requests": f"WITH {_SEG} SELECT video_id, id, CASE WHEN video_id % 2 = 0 AND id % 5 <> 0 THEN 'hit' ELSE 'miss' END AS outcome FROM seg",
    "mean_wer": f"WITH {_WORDS} SELECT match_kind, count(*) AS n_samples, round(avg(d / n) * 100, 2) AS mean_wer FROM dist JOIN (SELECT rule_id, match_kind FROM correction_rules) k ON k.rule_id = dist.rule_id WHERE n > 0 GROUP BY match_kind",
    "word_confidences": f"""WITH {_SEG}, w AS (SELECT video_id, id, {_tokens("coalesce(text, '')")} AS w FROM seg)
SELECT video_id, id, CASE WHEN video_id % 2 = 0 AND len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: 1.0::DOUBLE / length(x))) / len(w), 6) END AS confidence FROM w""",
    "completion_texts": f"""SELECT v.id, 'completed' || chr(10) || 'output: ' || v.path || chr(10) || 'duration: ' || {_human("v.duration_seconds")} || chr(10) || 'processing: ' || {_human("t.processing_seconds")} || chr(10)
  || 'segments: ' || coalesce(v.segment_count, 0) || chr(10) || 'needs_review: ' || coalesce(v.needs_review_count, 0) AS message FROM videos v JOIN (SELECT DISTINCT video_id, processing_seconds FROM transcripts) t ON t.video_id = v.id""",
    "terms_by_length": f"WITH {_TERMS} SELECT term, row_number() OVER (ORDER BY length(term) DESC, first) AS place FROM f",
    "prompt_terms": f"WITH {_TERMS} SELECT term FROM f ORDER BY first LIMIT {report.TERMS_SHOWN}",
}
