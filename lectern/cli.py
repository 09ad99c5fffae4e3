"""Commands over a folder of tables: ``python -m lectern.cli COMMAND --tables DIR [--out DIR]``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import segments, state
from lectern.plans import pipeline
from lectern.session import materialise, table
from lectern.sinks import render
from lectern.sources import media
from lectern.sources.settings import Settings


FORMATS = (".srt", ".txt", ".md")


def scan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The videos table as a scan of a folder leaves it."""
    return state.upsert(media.listing(spark, a.videos), table(spark, a.tables, "videos"), F.current_timestamp(), a.rescan)


def status(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return state.shares(table(spark, a.tables, "videos")).orderBy("place").select("status", "n", F.format_string("%.1f%%", "percent").alias("share"))


def correct(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Corrected segments of the videos whose turn it is."""
    videos = table(spark, a.tables, "videos")
    ids = _selected(videos, state.to_correct(videos, a.force, a.limit), a).select(F.col("id").alias("video_id"))
    raw = table(spark, a.tables, "segments_raw").join(ids, "video_id", "left_semi")
    return pipeline.correct(raw, table(spark, a.tables, "correction_rules"), table(spark, a.tables, "glossary_files"), Settings.load(a.settings))


def _selected(videos: DataFrame, chosen: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The selection of a command, or the one video it was given, whatever its state."""
    return state.by_path(videos, a.video) if a.video else chosen


FACTS = "filename string, duration_seconds double, model string, backend string, language string, size_bytes bigint, created_at timestamp, tool_version string, processing_seconds double, real_time_factor double"


def _headers(spark: SparkSession, a: argparse.Namespace, videos: DataFrame) -> DataFrame:
    """``videos`` with the facts of their transcripts; what a video's transcript doesn't have is null."""
    x = table(spark, a.tables, "transcripts")
    if "video_id" not in x.columns:
        x = spark.createDataFrame([], "video_id bigint")
    facts = [(F.col(n) if n in x.columns else F.lit(None)).cast(kind).alias(n) for n, kind in (f.split() for f in FACTS.split(", "))]
    return videos.join(x.dropDuplicates(["video_id"]).select("video_id", *facts), "video_id", "left")


def write_json(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """raw.json, corrected.json and corrections.json of the videos whose turn it is, each replaced as a whole below --out."""
    videos = table(spark, a.tables, "videos")
    videos = _selected(videos, state.to_correct(videos, a.force, a.limit), a).select(F.col("id").alias("video_id"), "slug")
    heads = _headers(spark, a, videos).drop("slug")
    raw = segments.once(table(spark, a.tables, "segments_raw")).join(videos.select("video_id"), "video_id", "left_semi")
    done = materialise(pipeline.correct(raw, table(spark, a.tables, "correction_rules"), table(spark, a.tables, "glossary_files"), Settings.load(a.settings)), "decided")
    scores = ["id", "start_s", "end_s", "text", "avg_logprob", "no_speech_prob", "compression_ratio", "temperature", "confidence", "window_index"]
    changed = pipeline.differences(done)
    documents = (("raw", raw, scores), ("corrected", done, [*scores, "raw_text", "needs_review"]), ("corrections", changed, [c for c in changed.columns if c != "video_id"]))
    out = [render.write_documents(render.json_transcript(x, heads, fields).join(videos, "video_id"), a.out, suffix=".json", last=render.JSON_END, stem=stem) for stem, x, fields in documents]
    return out[0].unionByName(out[1]).unionByName(out[2])


def export(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Subtitles, text and Markdown of the videos whose turn it is, written below --out; the corrected segments of a video
    where --corrected has any. Documents newer than their video's last change stay, unless --force."""
    every = table(spark, a.tables, "videos")
    videos = _selected(every, state.to_export(every, a.limit), a).select(F.col("id").alias("video_id"), "slug", F.unix_micros("updated_at").alias("modified"))
    have = [(slug, suffix, int(os.stat(path).st_mtime * 1e6)) for slug in (os.listdir(a.out) if os.path.isdir(a.out) else []) for suffix in FORMATS if os.path.exists(path := os.path.join(a.out, slug, "transcript" + suffix))]
    stale = render.outdated(videos.select("slug", "modified"), spark.createDataFrame(have, "slug string, suffix string, modified bigint"), FORMATS, a.force)
    videos = videos.join(stale, "slug", "left_semi")
    x = segments.once(table(spark, a.tables, "segments_raw"))
    if a.corrected:
        x = segments.chosen(x, spark.read.parquet(a.corrected).select("video_id", "id", "start_s", "end_s", "text", "needs_review"))
    else:
        x = x.withColumn("needs_review", F.lit(False))
    x = x.withColumn("needs_review", F.coalesce("needs_review", F.lit(False))).join(videos.select("video_id"), "video_id", "left_semi")
    heads = _headers(spark, a, videos.select("video_id", "slug"))
    made = zip(FORMATS, (render.srt(x), render.txt(x), render.markdown(x, heads)), ("", "\n", ""))
    out = [render.write_documents(d.join(videos.select("video_id", "slug"), "video_id"), a.out, suffix=suffix, last=last) for suffix, d, last in made]
    return out[0].unionByName(out[1]).unionByName(out[2])


def doctor(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Which tables there are and how many rows they have."""
    names = ("videos", "segments_raw", "transcripts", "correction_rules", "glossary_files")
    return spark.createDataFrame([(n, table(spark, a.tables, n).count()) for n in names], "name string, n bigint")


COMMANDS = {f.__name__: f for f in (doctor, scan, status, correct, write_json, export)}
#: What writes files as it runs, so that its result is run once and not shown from the plan.
WRITE = ("write_json", "export")


def spark_rows(x: DataFrame) -> DataFrame:
    """The paths written, so that showing them doesn't write again."""
    return x.sparkSession.createDataFrame(x.collect(), x.schema)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--tables", required=True)
    p.add_argument("--videos")
    p.add_argument("--out")
    p.add_argument("--settings")
    p.add_argument("--corrected")
    p.add_argument("--video")
    p.add_argument("--dry-run", action="store_true", help="correct without writing the result")
    p.add_argument("--limit", type=int)
    p.add_argument("--force", action="store_true")
    p.add_argument("--rescan", action="store_true")
    a = p.parse_args(args)
    x = COMMANDS[a.command](spark or SparkSession.builder.appName("lectern").getOrCreate(), a)
    if a.command in WRITE:
        x = spark_rows(x)
    if a.dry_run:
        x.show(1000, False)
    elif a.out and a.command in ("scan", "correct"):
        x.write.mode("overwrite").parquet(a.out)
    else:
        x.show(1000, False)
    return x


if __name__ == "__main__":
    main()
