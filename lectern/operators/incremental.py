"""Views kept up to date by partition fingerprints, and the work list of each run built on them.

A view is stored in partitions. The fingerprint of a partition is a count and a sum of row hashes of all that its result
depends on: both are additive, so Spark combines them before the shuffle. Each written partition carries the fingerprint
it was made from. On refresh only partitions whose fingerprint differs are recomputed, and dynamic partition overwrite
replaces each as a whole, data and fingerprint together: a run that dies leaves old partitions or none, whose
fingerprints don't match, and the next refresh makes them again.

A run's work list depends on its own sightings and on the earlier sightings that brought a video to an end, and on nothing
else. The view is therefore partitioned by run and by a bucket of videos, and a fingerprint covers just these rows, each
with its own run's outcome: a new run adds partitions and remakes none, a late sighting remakes its own partition and,
if it ended a video's work, those of its bucket's later runs.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sightings of one run in a partition, about; the number of buckets follows from it.
ROWS_A_PARTITION = 500_000
LEAST_BUCKETS = 8
MTIME_TOLERANCE = 1e-4
DONE = ("COMPLETED", "NEEDS_REVIEW")
#: A lock that its holder hasn't touched for so many seconds is left behind by one that died.
STALE_S = 60.0


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; doubles are hashed as they are, nulls by position."""
    cols = sorted(df.columns)
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols], *[F.col(f"`{c}`").isNull() for c in cols])


def fingerprints(df: DataFrame, *parts: str, of: list[str] | None = None) -> DataFrame:
    """``parts, fp_rows, fp_hash``: count and additive hash of each partition's rows, of the columns ``of`` or all others."""
    rows = df.select(*(of or [c for c in df.columns if c not in parts]))
    x = df.select(*parts, row_hash(rows).cast("decimal(38,0)").alias("h"))
    return x.groupBy(*parts).agg(F.count("*").alias("fp_rows"), F.sum("h").cast("decimal(38,0)").alias("fp_hash"))


class PartitionedView:
    """Rows of ``schema`` kept in ``path`` by the partition columns ``parts`` (bigint), each partition with its fingerprint.

    Any number of sessions may refresh one view: a lock file beside it lets them in one after another, and one that its
    holder no longer touches is taken over. The file system must create files exclusively (HDFS and POSIX do).
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: list[str]):
        self.spark, self.path, self.schema, self.parts = spark, path, schema, parts
        extra = [T.StructField("fp_rows", T.LongType()), T.StructField("fp_hash", T.DecimalType(38, 0)), *(T.StructField(p, T.LongType()) for p in parts)]
        self.stored = T.StructType([*schema.fields, *extra])

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self) -> bool:
        fs, p = self._at(self.path)
        return fs.exists(p)

    @contextmanager
    def locked(self):
        fs, p = self._at(self.path + ".lock")
        fs.mkdirs(p.getParent())
        while not fs.createNewFile(p):
            try:
                if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > STALE_S:
                    fs.delete(p, False)
                    continue
            except Exception:  # noqa: BLE001 - the holder has just let go
                continue
            time.sleep(0.5)
        free = threading.Event()

        def hold() -> None:
            while not free.wait(STALE_S / 6):
                fs.setTimes(p, int(time.time() * 1000), -1)

        keeper = threading.Thread(target=hold, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            free.set()
            keeper.join()
            fs.delete(p, False)

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def changed(self, now: DataFrame) -> list[tuple[int, ...]]:
        """Partitions to make again, out of the fingerprints they should have; as many rows reach the driver, whatever the source's size."""
        if not self._exists():
            return sorted(tuple(r) for r in now.select(*self.parts).collect())
        had = self._table().where("fp_rows is not null").select(*self.parts, "fp_rows", "fp_hash")
        both = now.alias("n").join(had.alias("h"), self.parts, "full")
        same = F.col("n.fp_rows").eqNullSafe(F.col("h.fp_rows")) & F.col("n.fp_hash").eqNullSafe(F.col("h.fp_hash"))
        emptied = F.col("n.fp_rows").isNull() & (F.col("h.fp_rows") == 0)
        return sorted(tuple(r) for r in both.where(~same & ~emptied).select(*self.parts).collect())

    def refresh(self, now: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> list[tuple[int, ...]]:
        """Bring the view up to the fingerprints ``now``; returns the partitions made again.

        ``compute``: the partitions to make (a small table of ``parts``) -> their rows, with ``parts``. Partitions that no
        longer are get an empty one.
        """
        with self.locked():
            todo = self.changed(now)
            if not todo:
                return todo
            wanted = self.spark.createDataFrame(todo, ", ".join(f"{p} bigint" for p in self.parts))
            marks = wanted.join(now, self.parts, "left")
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.parts]
            marks = marks.select(*self.parts, *none, F.coalesce("fp_rows", F.lit(0).cast("bigint")).alias("fp_rows"), "fp_hash")
            rows = compute(wanted).select(*dict.fromkeys([*self.parts, *self.schema.fieldNames()]), F.lit(None).cast("bigint").alias("fp_rows"), F.lit(None).cast("decimal(38,0)").alias("fp_hash"))
            # a writer task writes its partitions one after another and holds none of them
            tasks = 2 * self.spark.sparkContext.defaultParallelism
            out = rows.unionByName(marks).repartition(min(len(todo), tasks), *self.parts)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.path)
            return todo

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        return self._table().where("fp_rows is null").select(*self.schema.fieldNames())


WORK_SCHEMA = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("video_id", T.LongType())])


def sightings(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run's sighting of each video, once, with ``done``: a succeeded run read it and brought it to an end.

    Exact copies count once. Should a (run, video) have several different rows, the one seen last holds, a tie going to
    the greater row. Sightings of unknown runs count as not succeeded.
    """
    cols = ["size_bytes", "mtime", "status"]
    one = scans.where("run_id is not null and video_id is not null").groupBy("run_id", "video_id").agg(F.max(F.struct("seen_at", *cols)).alias("x")).select("run_id", "video_id", *[f"x.{c}" for c in cols])
    ok = runs.where("outcome = 'succeeded'").select("run_id", F.lit(True).alias("succeeded")).distinct()
    readable = F.col("size_bytes").isNotNull() & F.col("mtime").isNotNull() & ~F.isnan("mtime")
    return one.where(readable).join(ok, "run_id", "left").select("run_id", "video_id", "size_bytes", "mtime", (F.coalesce("succeeded", F.lit(False)) & F.coalesce(F.col("status").isin(*DONE), F.lit(False))).alias("done"))


def work(seen: DataFrame) -> DataFrame:
    """(run_id, video_id) that a run had to process: never brought to an end before, or changed since."""
    w = Window.partitionBy("video_id").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("done"), F.struct("size_bytes", "mtime")), ignorenulls=True).over(w)
    x = seen.withColumn("last", last)
    changed = (F.col("last.size_bytes") != F.col("size_bytes")) | (F.abs(F.col("last.mtime") - F.col("mtime")) > MTIME_TOLERANCE)
    return x.where(F.col("last").isNull() | changed).select("run_id", "video_id")


class WorkLists:
    """The work list of every run, kept in ``path``.

    The number of video buckets is the power of two that gives a run's partition ROWS_A_PARTITION sightings or fewer; it
    is part of the folder's name, so data that have doubled are made once anew and a view never mixes two numbers.
    """

    def __init__(self, spark: SparkSession, path: str, scans: DataFrame, runs: DataFrame):
        self.spark = spark
        self.scans = scans.select("run_id", "video_id", "size_bytes", "mtime", "status", "seen_at")
        self.runs = runs.select("run_id", "outcome")
        most = self.scans.groupBy("run_id").count().agg(F.max("count").alias("n")).first().n or 0
        self.buckets = LEAST_BUCKETS
        while self.buckets * ROWS_A_PARTITION < most:
            self.buckets *= 2
        self.view = PartitionedView(spark, f"{path}/{self.buckets}", WORK_SCHEMA, ["run_id", "bucket"])

    def seen(self) -> DataFrame:
        return sightings(self.scans, self.runs).withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(self.buckets)))

    def marks(self) -> DataFrame:
        """The fingerprint of each (run, bucket): its own sightings, and the earlier ones that ended a video's work."""
        own = ["video_id", "size_bytes", "mtime"]
        x = self.seen()
        mine = fingerprints(x, "run_id", "bucket", of=own)
        ended = fingerprints(x.where("done"), "run_id", "bucket", of=[*own, "run_id"]).select("run_id", "bucket", F.col("fp_rows").alias("d_rows"), F.col("fp_hash").alias("d_hash"))
        # as many rows as there are partitions
        before = Window.partitionBy("bucket").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
        y = mine.join(ended, ["run_id", "bucket"], "left")
        rows = F.col("fp_rows") + F.coalesce(F.sum("d_rows").over(before), F.lit(0))
        total = F.col("fp_hash") + F.coalesce(F.sum("d_hash").over(before), F.lit(0)) * 3
        return y.select("run_id", "bucket", rows.alias("fp_rows"), total.cast("decimal(38,0)").alias("fp_hash"))

    def compute(self, wanted: DataFrame) -> DataFrame:
        # a bucket's later runs need none of its rows that ended nothing, but its earlier ends reach every later run
        x = self.seen().join(F.broadcast(wanted.groupBy("bucket").agg(F.max("run_id").alias("__last"))), "bucket").where(F.col("run_id") <= F.col("__last"))
        due = F.broadcast(wanted.withColumn("__due", F.lit(True)))
        x = x.join(due, ["run_id", "bucket"], "left").where(F.col("done") | F.col("__due"))
        return work(x).withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(self.buckets))).join(F.broadcast(wanted), ["run_id", "bucket"])

    def refresh(self) -> list[tuple[int, ...]]:
        return self.view.refresh(self.marks(), self.compute)

    def read(self) -> DataFrame:
        return self.view.read()


def work_lists(spark: SparkSession, scans: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """The work list of every run, through a view in ``path`` that later calls only bring up to date.

    Readable is a sighting with size and mtime; others are neither work nor an end. Nulls in other columns are harmless,
    empty tables give an empty list, extra columns are ignored.
    """
    lists = WorkLists(spark, path, scans, runs)
    lists.refresh()
    return lists.read()
