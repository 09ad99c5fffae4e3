"""Queries of the general training-data operators: intervals (4), incremental work (6), readings (7)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import control_chart, incremental, intervals
from lectern.session import shared_dir, table

WINDOW = ["video_id", "window_index"]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.gaps(table(spark, sf, "segments_raw"), WINDOW)


def p4_periods(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.periods(table(spark, sf, "segments_raw"), WINDOW)


def _view(spark: SparkSession, sf: str, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-2-{hashlib.sha256(sf.encode()).hexdigest()[:24]}"


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    # the view outlives the call: the next over the same tables remakes only partitions that changed
    return incremental.work_lists(spark, table(spark, sf, "video_scans"), table(spark, sf, "scan_runs"), _view(spark, sf, "work-lists"))


def p6_next_run(spark: SparkSession, sf: str) -> DataFrame:
    """The work lists after one more run, succeeded, that saw the videos whose id is divisible by 100, changed.

    The view of all runs is brought up to date first, so this run adds its own partitions and remakes no other."""
    scans, runs = table(spark, sf, "video_scans"), table(spark, sf, "scan_runs").select("run_id", "outcome")
    new = runs.agg((F.max("run_id") + 1).alias("run_id"), F.lit("succeeded").alias("outcome"))
    seen = scans.where("video_id % 100 = 0 and size_bytes is not null and mtime is not null").groupBy("video_id").agg(F.max_by(F.struct("path", "size_bytes", "mtime"), F.struct("run_id", "seen_at")).alias("x"), F.max("scan_id").alias("scan_id"), F.max("seen_at").alias("seen_at"))
    seen = seen.crossJoin(F.broadcast(new.select("run_id"))).select("scan_id", "run_id", "video_id", "x.path", (F.col("x.size_bytes") + 1).alias("size_bytes"), "x.mtime", F.lit("COMPLETED").alias("status"), "seen_at")
    path = _view(spark, sf, "next-run")
    incremental.WorkLists(spark, path, scans, runs).refresh()
    return incremental.work_lists(spark, scans.unionByName(seen), runs.unionByName(new), path)


def p6_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Videos to process in each run, by the run's outcome."""
    runs = table(spark, sf, "scan_runs").select("run_id", "outcome").distinct()
    return p6_found(spark, sf).join(runs, "run_id", "left").groupBy("run_id", "outcome").agg(F.count("*").alias("n_videos"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return control_chart.unbelievable(table(spark, sf, "segments_raw")).select("video_id", "seg_id", "field").distinct()


def p7_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Unbelievable readings of each video by field and reason."""
    x = control_chart.unbelievable(table(spark, sf, "segments_raw"))
    return x.groupBy("video_id", "field", "reason").agg(F.count("*").alias("n_readings"))


QUERIES = {f.__name__: f for f in (p4_found, p4_periods, p6_found, p6_next_run, p6_backlog, p7_found, p7_reasons)}

_SPANS = """spans AS (
  SELECT DISTINCT video_id, window_index, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e
  FROM segments_raw WHERE end_s > start_s AND isfinite(start_s) AND isfinite(end_s)),
reached AS (
  SELECT *, max(e) OVER (PARTITION BY video_id, window_index ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans)"""

_WORK = """seen AS (
  SELECT DISTINCT v.run_id, v.video_id, v.size_bytes, v.mtime,
    coalesce(r.outcome = 'succeeded', false) AND coalesce(v.status IN ('COMPLETED', 'NEEDS_REVIEW'), false) AS done
  FROM video_scans v LEFT JOIN scan_runs r ON r.run_id = v.run_id
  WHERE v.size_bytes IS NOT NULL AND v.mtime IS NOT NULL),
latest AS (
  SELECT s.run_id, s.video_id, s.size_bytes, s.mtime, max(d.run_id) AS done_run
  FROM seen s LEFT JOIN seen d ON d.video_id = s.video_id AND d.run_id < s.run_id AND d.done
  GROUP BY s.run_id, s.video_id, s.size_bytes, s.mtime),
work AS (
  SELECT l.run_id, l.video_id FROM latest l LEFT JOIN seen d ON d.video_id = l.video_id AND d.run_id = l.done_run
  WHERE l.done_run IS NULL OR d.size_bytes <> l.size_bytes OR abs(d.mtime - l.mtime) > 1e-4)"""

_FIELDS = (("avg_logprob", "avg_logprob <= 0"), ("no_speech_prob", "no_speech_prob BETWEEN 0 AND 1"), ("compression_ratio", "compression_ratio > 0"))
_EACH = " UNION ALL ".join(f"SELECT video_id, id, '{f}' AS field, {f} AS x, isfinite({f}) AND {ok} AS ok FROM seg WHERE {f} IS NOT NULL" for f, ok in _FIELDS)
_READINGS = f"""seg AS (SELECT DISTINCT video_id, id, avg_logprob, no_speech_prob, compression_ratio FROM segments_raw),
readings AS ({_EACH}),
levels AS (SELECT video_id, field, median(x) AS m FROM readings WHERE ok GROUP BY video_id, field),
spreads AS (SELECT r.video_id, r.field, any_value(m) AS m, median(abs(x - m)) * 1.4826 AS s FROM readings r JOIN levels l ON l.video_id = r.video_id AND l.field = r.field WHERE ok GROUP BY r.video_id, r.field),
islands AS (SELECT *, id - row_number() OVER (PARTITION BY video_id, field, x ORDER BY id) AS g FROM readings WHERE NOT isnan(x)),
stuck AS (SELECT video_id, id, field FROM (SELECT *, count(*) OVER (PARTITION BY video_id, field, x, g) AS n FROM islands) q WHERE n >= 10),
reasons AS (SELECT video_id, id, field, 'impossible' AS reason FROM readings WHERE NOT ok UNION ALL SELECT video_id, id, field, 'stuck' FROM stuck
  UNION ALL SELECT r.video_id, r.id, r.field, 'spike' FROM readings r JOIN spreads s ON s.video_id = r.video_id AND s.field = r.field WHERE ok AND abs(x - m) > 8 * s)"""

ORACLE = {
    # exact medians, where the operator has quantile sketches
    "p7_found": f"WITH {_READINGS} SELECT DISTINCT video_id, id AS seg_id, field FROM reasons",
    "p7_reasons": f"WITH {_READINGS} SELECT video_id, field, reason, count(*) AS n_readings FROM reasons GROUP BY video_id, field, reason",
    "p4_found": f"WITH {_SPANS} SELECT video_id, window_index, m AS gap_from_ms, s AS gap_to_ms FROM reached WHERE s > m",
    "p4_periods": f"""WITH {_SPANS}, numbered AS (
  SELECT video_id, window_index, s, e, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, window_index ORDER BY s, e) AS p FROM reached)
SELECT video_id, window_index, min(s) AS from_ms, max(e) AS to_ms FROM numbered GROUP BY video_id, window_index, p""",
    "p6_found": f"WITH {_WORK} SELECT run_id, video_id FROM work",
    "p6_next_run": f"""WITH last AS (SELECT video_id, max((run_id, seen_at)) AS l FROM video_scans WHERE video_id % 100 = 0 AND size_bytes IS NOT NULL AND mtime IS NOT NULL GROUP BY video_id),
added AS (SELECT DISTINCT (SELECT max(run_id) + 1 FROM scan_runs) AS run_id, v.video_id, v.size_bytes + 1 AS size_bytes, v.mtime, 'COMPLETED' AS status FROM video_scans v JOIN last ON last.video_id = v.video_id AND (v.run_id, v.seen_at) = last.l WHERE v.size_bytes IS NOT NULL AND v.mtime IS NOT NULL),
{_WORK.replace("video_scans v LEFT JOIN scan_runs r", "(SELECT run_id, video_id, size_bytes, mtime, status FROM video_scans UNION ALL SELECT * FROM added) v LEFT JOIN (SELECT run_id, outcome FROM scan_runs UNION ALL SELECT max(run_id) + 1, 'succeeded' FROM scan_runs) r")}
SELECT run_id, video_id FROM work""",
    "p6_backlog": f"WITH {_WORK}, runs AS (SELECT DISTINCT run_id, outcome FROM scan_runs) SELECT w.run_id, r.outcome, count(*) AS n_videos FROM work w LEFT JOIN runs r ON r.run_id = w.run_id GROUP BY w.run_id, r.outcome",
}
