"""Speech windows out of chunks, by a greedy fold with a cap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow_groups import column


def merge_chunks(chunks: DataFrame, gap_ms: int = 1000, most_ms: int = 300_000, least_ms: int = 300, total: DataFrame | None = None) -> DataFrame:
    """``video_id, start_ms, end_ms``: chunks of each video in order of (start, end), joined while the gap is below
    ``gap_ms`` and the joined window is no longer than ``most_ms``; a longer chunk stays whole, shorter windows go.

    With ``total`` (video_id, total_ms) windows are cut to [0, total], and a video without any left gets one over all of
    it. The cap makes the fold sequential, but it starts anew wherever the gap is too wide: such islands are folded apart,
    each row after the other without holding them, so a long recording doesn't have to fit in memory.
    """
    x = chunks.where("video_id is not null and start_ms is not null and end_ms is not null").select("video_id", "start_ms", "end_ms")
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) >= gap_ms, F.lit(True))
    x = x.withColumn("island", F.sum(new.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.repartition("video_id", "island").sortWithinPartitions("video_id", "island", "start_ms", "end_ms")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] | None = None  # video, island, start, end
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for v, i, s, e in zip(*(column(b, c).tolist() for c in ("video_id", "island", "start_ms", "end_ms"))):
                if now and now[0] == v and now[1] == i and s - now[3] < gap_ms and e - now[2] <= most_ms:
                    now[3] = e
                    continue
                if now:
                    out.append((now[0], now[2], now[3]))
                now = [v, i, s, e]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(out, np.int64).T], names=["video_id", "start_ms", "end_ms"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in (now[0], now[2], now[3])], names=["video_id", "start_ms", "end_ms"])

    x = x.mapInArrow(fold, "video_id bigint, start_ms bigint, end_ms bigint")
    if total is None:
        return x.where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    x = x.join(total, "video_id")
    s = F.greatest(F.lit(0), F.least("start_ms", "total_ms"))
    x = x.select("video_id", s.alias("start_ms"), F.greatest(s, F.least("end_ms", "total_ms")).alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    whole = total.join(x.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("total_ms").alias("end_ms"))
    return x.unionByName(whole)


def progress(windows: DataFrame) -> DataFrame:
    """``window_no, progress``: the share of a video's windows done when each ends."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    done = F.sum(F.col("end_ms") - F.col("start_ms"))
    share = done.over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(done.over(Window.partitionBy("video_id")), F.lit(1))
    return windows.select("*", (F.row_number().over(w) - 1).alias("window_no"), F.least(share, F.lit(1.0)).alias("progress"))
