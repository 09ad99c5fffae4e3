"""Subtitles, plain text, Markdown and JSON of transcripts.

A document is made of parts of PART cues each, which follow each other by number: no row grows with a recording, and a
writer appends the parts of its document in order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

PART = 1000


def _numbered(segments: DataFrame) -> DataFrame:
    x = segments.withColumn("no", F.row_number().over(Window.partitionBy("video_id").orderBy("id")))
    return x.withColumn("part", F.floor((F.col("no") - 1) / PART))


def _cues(segments: DataFrame) -> DataFrame:
    return _numbered(segments.withColumn("line", T.one_line(F.coalesce("text", F.lit("")))))


def _joined(x: DataFrame, cue: Column, between: str) -> DataFrame:
    y = x.select("video_id", "part", "no", cue.alias("cue")).groupBy("video_id", "part").agg(F.array_sort(F.collect_list(F.struct("no", "cue"))).alias("c"), F.count("*").alias("n_cues"))
    return y.select("video_id", "part", "n_cues", F.array_join(F.transform("c", lambda s: s["cue"]), between).alias("content"))


def srt(segments: DataFrame) -> DataFrame:
    """``video_id, part, n_cues, content``: numbered cues with a blank line between; parts join by a line break.

    A cue needs both times, so segments without start or end are left out; text and Markdown keep them.
    """
    cue = F.concat(F.col("no").cast("string"), F.lit("\n"), T.srt_time("start_s"), F.lit(" --> "), T.srt_time("end_s"), F.lit("\n"), F.col("line"), F.lit("\n"))
    return _joined(_cues(segments.where("start_s is not null and end_s is not null")), cue, "\n")


def txt(segments: DataFrame) -> DataFrame:
    """A line for each segment; parts join by a line break, and one more ends the document."""
    return _joined(_cues(segments), F.col("line"), "\n")


def spoken(segments: DataFrame) -> DataFrame:
    """The texts of a transcript with one space between, null as empty; parts join by a space."""
    return _joined(_numbered(segments), F.coalesce("text", F.lit("")), " ")


def markdown(segments: DataFrame, headers: DataFrame, timed_only: bool = False) -> DataFrame:
    """The first part opens with title and facts of its transcript; cues say where review is needed.

    ``segments`` has needs_review; ``headers``: video_id, slug, filename, duration_seconds, model, language.
    Lines without start or end have the time that is known beside the hyphen, those without both no span; ``timed_only``
    leaves both out, though the facts count them.
    """
    stats = segments.groupBy("video_id").agg(F.count("*").alias("__n"), F.count_if("needs_review").alias("__review"), F.max_by("end_s", "id").alias("__end"))
    length = F.coalesce(F.nullif("duration_seconds", F.lit(0.0)), F.col("__end"), F.lit(0.0))
    lines = ["# ", T.title_of("slug"), "\n\n- source: `", F.col("filename"), "`\n- duration: ", T.clock(length), "\n- model: ", F.col("model"), "\n- language: ", F.col("language"), "\n- segments: ", F.col("__n").cast("string"), "\n- needs_review: ", F.col("__review").cast("string"), "\n\n## Transcript\n\n"]
    head = F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("None")) for x in lines])
    heads = headers.join(stats, "video_id").select("video_id", head.alias("head"))
    begin, end = (F.when(F.col(c).isNotNull(), T.clock(c)) for c in ("start_s", "end_s"))
    span = F.when(begin.isNotNull() | end.isNotNull(), F.concat(F.lit("["), F.coalesce(F.concat(begin, F.lit(" ")), F.lit("")), F.lit("-"), F.coalesce(F.concat(F.lit(" "), end), F.lit("")), F.lit("]")))
    marked = F.concat_ws(" ", span, F.when(F.col("needs_review"), "<!-- needs_review -->"))
    cue = F.concat(F.when(marked != "", F.concat(marked, F.lit("\n"))).otherwise(""), F.col("line"), F.lit("\n"))
    kept = segments.where("start_s is not null and end_s is not null") if timed_only else segments
    x = _joined(_cues(kept), cue, "\n").join(heads, "video_id")
    return x.select("video_id", "part", "n_cues", F.when(F.col("part") == 0, F.concat("head", "content")).otherwise(F.col("content")).alias("content"))


def as_json(c: str | Column) -> Column:
    """A struct as JSON, nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def json_transcript(segments: DataFrame, headers: DataFrame, fields: list[str]) -> DataFrame:
    """A JSON document for each video, its facts first, then its segments in order: raw, corrected, or what was changed.

    ``headers``: video_id and the facts; ``fields``: those of a segment. Parts join by a line break, and JSON_END ends the
    document; a video without segments has an empty list of them.
    """
    facts = F.to_json(F.struct(*[c for c in headers.columns if c != "video_id"]), {"ignoreNullFields": "false"})
    heads = headers.select("video_id", F.concat(F.lit('{"video": '), facts, F.lit(', "segments": [')).alias("head"))
    x = _joined(_numbered(segments), as_json(F.struct(*fields)), ",\n")
    x = heads.join(x, "video_id", "left").select("video_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("n_cues", F.lit(0)).alias("n_cues"), "head", F.coalesce("content", F.lit("")).alias("content"))
    return x.select("video_id", "part", "n_cues", F.concat(F.when(F.col("part") == 0, F.col("head")).otherwise(","), "content").alias("content"))


#: What ends a document of :func:`json_transcript`.
JSON_END = "]}\n"


def replace_file(path: str, chunks: Iterator[str]) -> None:
    """Write a text file as a whole or not at all: a temporary file beside it, synced, takes its place."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".", suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            for x in chunks:
                f.write(x)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    d = os.open(os.path.dirname(path), os.O_RDONLY)
    try:
        os.fsync(d)
    finally:
        os.close(d)


def write_documents(parts: DataFrame, folder: str, name: str = "slug", suffix: str = ".srt", last: str = "", stem: str = "transcript") -> DataFrame:
    """Files ``folder/<name>/<stem><suffix>`` in a folder all executors share; returns ``path, n_parts`` of each.

    ``parts`` has ``name``, part, content. The parts of a document stream through one task in order.
    """
    x = parts.select(name, "part", "content").repartition(name).sortWithinPartitions(name, "part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(name).to_pylist(), b.column("content").to_pylist()))
        row = next(rows, None)
        while row is not None:
            current, n = row[0], 0

            def chunks() -> Iterator[str]:
                nonlocal row, n
                while row is not None and row[0] == current:
                    yield ("\n" if n else "") + row[1]
                    n += 1
                    row = next(rows, None)
                yield last

            path = os.path.join(folder, str(current), stem + suffix)
            replace_file(path, chunks())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_parts"])

    return x.mapInArrow(write, "path string, n_parts bigint")


def outdated(sources: DataFrame, outputs: DataFrame, suffixes: tuple[str, ...] = (".srt", ".txt", ".md"), force: bool = False) -> DataFrame:
    """``slug`` of sources (slug, modified) that lack an output (slug, suffix, modified) or are newer than one."""
    have = outputs.where(F.col("suffix").isin(*suffixes)).groupBy("slug").agg(F.countDistinct("suffix").alias("n"), F.min("modified").alias("oldest"))
    x = sources.join(have, "slug", "left")
    stale = F.coalesce(F.col("n") < len(suffixes), F.lit(True)) | F.coalesce(F.col("oldest") < F.col("modified"), F.lit(True))
    return x.where(F.lit(force) | stale).select("slug")
