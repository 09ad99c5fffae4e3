"""Processing state of videos: selections, history, upsert of a listing, unique slugs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# States, and the order in which a report shows them.
SHOWN = ("PENDING", "EXTRACTING", "TRANSCRIBING", "TRANSCRIBED", "COMPLETED", "NEEDS_REVIEW", "FAILED")
STATES = ("PENDING", "EXTRACTING", "TRANSCRIBING", "TRANSCRIBED", "CORRECTING", "COMPLETED", "NEEDS_REVIEW", "FAILED")
FINISHED = ("COMPLETED", "NEEDS_REVIEW", "FAILED", "TRANSCRIBED")
TOLERANCE = 1e-4


def _first(x: DataFrame, limit: int | None) -> DataFrame:
    x = x.orderBy("path")
    return x.limit(limit) if limit and limit > 0 else x


def to_transcribe(videos: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    want = F.col("status").isin("PENDING", "EXTRACTING", "TRANSCRIBING") | ((F.col("status") == "FAILED") & F.col("failed_stage").isin("extract", "transcribe"))
    return _first(videos if force else videos.where(want), limit)


def to_correct(videos: DataFrame, force: bool = False, limit: int | None = None, stuck: bool = True) -> DataFrame:
    """``stuck``: also what a crash left in CORRECTING."""
    want = (F.col("status") == "TRANSCRIBED") | ((F.col("status") == "FAILED") & (F.col("failed_stage") == "correct"))
    want |= (F.col("status") == "CORRECTING") if stuck else F.lit(False)
    want |= F.col("status").isin("TRANSCRIBED", "COMPLETED", "NEEDS_REVIEW", "FAILED") if force else F.lit(False)
    return _first(videos.where(want), limit)


def to_export(videos: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(videos.where(F.col("status").isin("TRANSCRIBED", "COMPLETED", "NEEDS_REVIEW")), limit)


def by_path(videos: DataFrame, path: str) -> DataFrame:
    return videos.where(F.col("path") == path)


def counts(videos: DataFrame) -> DataFrame:
    return videos.groupBy("status").agg(F.count("*").alias("n"))


def shares(videos: DataFrame) -> DataFrame:
    """``place, status, n, percent``: every shown state in its order, with none where no video is in it."""
    shown = videos.sparkSession.createDataFrame(list(enumerate(SHOWN)), "place int, status string")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    every = counts(videos).withColumn("total", total)  # as many rows as states
    x = shown.join(every, "status", "left")
    whole = F.coalesce(F.max("total").over(Window.partitionBy(F.lit(0))), F.lit(0))
    n = F.coalesce("n", F.lit(0))
    return x.select("place", "status", n.alias("n"), (n * 100.0 / F.greatest(whole, F.lit(1))).alias("percent"))


def finished_at(status: Column, now: Column) -> Column:
    return F.when(status.isin(*FINISHED), now)


def final_status(needs_review: Column) -> Column:
    return F.when(needs_review > 0, F.lit("NEEDS_REVIEW")).otherwise(F.lit("COMPLETED"))


def transition(history: DataFrame) -> DataFrame:
    """The state of each video after its history (video_id, seq, status, stage, error, at).

    ``attempts`` counts failures; ``failed_stage`` and ``error`` are those of the last row if it failed, so success
    clears them; ``completed_at`` is when it last came to an end.
    """
    bad = history.where(~F.col("status").isin(*STATES)).select("status").limit(1).collect()
    if bad:
        raise ValueError(f"no state: {bad[0].status}")
    x = history.groupBy("video_id").agg(
        F.max_by(F.struct("status", "stage", "error", "at"), F.struct("at", "seq")).alias("x"),
        F.count_if(F.col("status") == "FAILED").alias("attempts"),
        F.max(F.when(F.col("status").isin("COMPLETED", "NEEDS_REVIEW"), F.col("at"))).alias("completed_at"),
    )
    failed = F.col("x.status") == "FAILED"
    return x.select("video_id", "x.status", F.when(failed, F.col("x.stage")).alias("failed_stage"), F.when(failed, F.col("x.error")).alias("error"), "attempts", "completed_at", F.col("x.at").alias("updated_at"))


def running_attempts(history: DataFrame, order: list[str]) -> DataFrame:
    """``attempts``: failures up to each row, at least 1 beside a row that isn't one."""
    w = Window.partitionBy("video_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("status") == "FAILED").cast("bigint")).over(w)
    return history.withColumn("attempts", F.when(F.col("status") == "FAILED", n).otherwise(F.greatest(n, F.lit(1))))


def listing_actions(listing: DataFrame, videos: DataFrame, rescan: bool = True) -> DataFrame:
    """``path, action``: added, updated (size or mtime differ, and ``rescan``), unchanged. Videos not listed stay."""
    had = videos.select("path", F.col("size_bytes").alias("__size"), F.col("mtime").alias("__mtime"), F.lit(True).alias("__had"))
    x = listing.join(had, "path", "left")
    differs = ~F.col("size_bytes").eqNullSafe(F.col("__size")) | F.coalesce(F.abs(F.col("mtime") - F.col("__mtime")) > TOLERANCE, ~F.col("mtime").eqNullSafe(F.col("__mtime")))
    action = F.when(F.col("__had").isNull(), "added").when(differs & F.lit(rescan), "updated").otherwise("unchanged")
    return x.withColumn("action", action).drop("__size", "__mtime", "__had")


def upsert(listing: DataFrame, videos: DataFrame, now: Column, rescan: bool = True) -> DataFrame:
    """``videos`` after a scan: new files are PENDING with an unused slug, changed ones are reset, others are as they were.

    ``listing``: path, size_bytes, mtime. New rows have no id: that is the table's to give.
    """
    acts = listing_actions(listing.dropDuplicates(["path"]), videos, rescan)
    changed = acts.where("action = 'updated'").select("path", F.col("size_bytes").alias("__size"), F.col("mtime").alias("__mtime"), F.lit(True).alias("__reset"))
    x = videos.join(changed, "path", "left")
    reset = F.col("__reset").isNotNull()
    new = {"size_bytes": F.col("__size"), "mtime": F.col("__mtime"), "status": F.lit("PENDING"), "failed_stage": F.lit(None), "error": F.lit(None), "updated_at": now}
    kept = x.select(*[(F.when(reset, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)) for c in videos.columns])
    fresh = unique_slugs(acts.where("action = 'added'"), videos)
    fresh = fresh.withColumn("status", F.lit("PENDING")).withColumn("created_at", now).withColumn("updated_at", now)
    return kept.unionByName(fresh.drop("action").select(*[c for c in fresh.columns if c in videos.columns]), allowMissingColumns=True)


def without_cache_of(cache: DataFrame, reset: DataFrame) -> DataFrame:
    """Cached answers of videos that weren't reset."""
    return cache.join(reset.select("video_id").distinct(), "video_id", "left_anti")


def unique_slugs(files: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """``filename, slug``: for each file in order of path the first of base, base-2, base-3 … that nobody has yet.

    Slugs can only collide where they agree without a numeric tail, so that is the unit of distribution; within it rows
    are folded in order while only the numbers taken are held.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    x = files.withColumn("filename", name).withColumn("slug", T.slugify(stem)).withColumn("__taken", F.lit(False))
    if videos is not None:
        had = videos.select("path", "slug", F.lit(True).alias("__taken"))
        x = x.unionByName(had, allowMissingColumns=True)
    x = x.withColumn("__root", F.regexp_replace("slug", r"(-[0-9]+)+$", ""))
    x = x.repartition("__root").sortWithinPartitions("__root", F.desc("__taken"), "path")
    schema = x.schema

    def name_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, used, tried = None, set(), {}
        for b in batches:
            slugs = []
            for r, s, taken in zip(b.column("__root").to_pylist(), b.column("slug").to_pylist(), b.column("__taken").to_pylist()):
                if r != root:
                    root, used, tried = r, set(), {}
                new = s
                if not taken and new in used:
                    n = tried.get(s, 2)
                    while f"{s}-{n}" in used:
                        n += 1
                    tried[s] = n + 1
                    new = f"{s}-{n}"
                used.add(new)
                slugs.append(new)
            at = b.schema.get_field_index("slug")
            yield b.set_column(at, b.schema.field(at), pa.array(slugs, pa.string()))

    return x.mapInArrow(name_all, schema).where("not __taken").drop("__taken", "__root")
