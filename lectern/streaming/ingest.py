"""Segments as they arrive: files into tables, exactly once, and running figures with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from lectern.operators import segments


def arriving(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 1000) -> DataFrame:
    """Parquet files as they come to a folder, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def flagged_into(stream: DataFrame, out: str, checkpoint: str, done: Callable[[int], None] | None = None) -> StreamingQuery:
    """Everything there is by now, flagged and written below ``out`` by batch. A batch that is run again after a failure
    replaces its own folder, so nothing is written twice; the checkpoint knows what has been taken."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["video_id", "id"]).withColumn("flags", segments.flags_of()).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if done:
            done(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window, of a stream or a table; a stream's rows later than ``late`` are left out."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    x = x.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
