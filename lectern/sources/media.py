"""Where transcripts come from: media listings, transcripts in JSON, settings in YAML, audio."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO = ("mp4", "m4v", "mov")
RATE = 16_000
SEGMENT = "id bigint, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, temperature double, confidence double, window_index int"
TRANSCRIPT = (
    "schema_version string, video struct<filename:string,relative_path:string,duration_seconds:double,size_bytes:bigint>, "
    "transcription struct<model:string,backend:string,language:string,word_timestamps:boolean,vad:string,created_at:string,tool_version:string,processing_seconds:double,real_time_factor:double>, "
    "segments array<struct<" + ",".join(c.replace(" ", ":", 1) for c in SEGMENT.split(", ")) + ">>"
)
KEYS = {"$": {"schema_version", "video", "transcription", "segments"}, "$.segments[0]": {c.split()[0] for c in SEGMENT.split(", ")}}


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size_bytes, mtime`` of video files below a folder, by path; hidden files don't count. No content is read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    x = x.where(kind.isin(*VIDEO) & ~name.startswith(".")).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), (F.unix_millis("modificationTime") / 1000).alias("mtime"))
    return x.orderBy("path")


def probed(files: DataFrame, probe: Callable[[str], float | None]) -> DataFrame:
    """``duration_seconds`` by an injected prober; null where it fails."""

    @F.arrow_udf("double")
    def seconds(a: pa.Array) -> pa.Array:
        out = []
        for p in a.to_pylist():
            try:
                out.append(probe(p))
            except Exception:  # noqa: BLE001 - any failure of a prober is an unknown duration
                out.append(None)
        return pa.array(out, pa.float64())

    return files.withColumn("duration_seconds", seconds("path"))


def transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) transcripts in JSON files, each with its ``path``; invalid ones with a ``problem``.

    Strict: no unknown or missing keys at the top or in segments, version 1.0, dense ids from 0.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value"))
    parsed = F.from_json("value", TRANSCRIPT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    x = raw.withColumn("t", parsed).withColumn("top", F.json_object_keys("value"))
    want = F.array(*[F.lit(k) for k in sorted(KEYS["$"])])
    seg = F.from_json(F.get_json_object("value", "$.segments"), "array<map<string,string>>")
    known = F.array(*[F.lit(k) for k in sorted(KEYS["$.segments[0]"])])
    odd = F.exists(seg, lambda s: F.size(F.array_except(F.map_keys(s), known)) > 0)
    s = F.col("t.segments")
    ids = F.transform(s, lambda e: e["id"])
    dense = F.when(F.size(s) == 0, F.lit(True)).otherwise(ids == F.sequence(F.lit(0).cast("bigint"), F.size(s).cast("bigint") - 1))
    complete = ~F.exists(s, lambda e: e["id"].isNull() | e["start"].isNull() | e["end"].isNull() | e["text"].isNull())
    problem = (
        F.when(F.col("top").isNull() | F.col("t._corrupt").isNotNull(), "no valid JSON")
        .when(F.array_sort("top") != want, "unknown or missing keys")
        .when(~F.col("t.schema_version").eqNullSafe("1.0"), "unknown version")
        .when(F.coalesce(odd, F.lit(True)), "unknown keys in segments")
        .when(~F.coalesce(complete, F.lit(False)), "incomplete segments")
        .when(~F.coalesce(dense, F.lit(False)), "ids aren't dense")
    )
    x = x.withColumn("problem", problem)
    return x.where("problem is null").select("path", "t.schema_version", "t.video", "t.transcription", "t.segments"), x.where("problem is not null").select("path", "problem")


def segments_of(valid: DataFrame, key: str = "path") -> DataFrame:
    """A row for each segment of valid transcripts."""
    x = valid.select(key, F.explode("segments").alias("s")).select(key, "s.*")
    return x.withColumnRenamed("start", "start_s").withColumnRenamed("end", "end_s")


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """``glossary_id, version, terms`` of a YAML glossary."""
    y = _yaml(path)
    return spark.createDataFrame([(1, int(y["version"]), [str(t) for t in y["terms"]])], "glossary_id bigint, version bigint, terms array<string>")


def correction_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a YAML file in its order."""
    rows = [(i, r["from"], r["to"], r.get("match", "literal"), bool(r.get("auto", True)), list(r.get("requires_context") or [])) for i, r in enumerate(_yaml(path).get("corrections", []), 1)]
    return spark.createDataFrame(rows, "rule_id bigint, from_text string, to_text string, match_kind string, auto boolean, requires_context array<string>")


def audio(spark: SparkSession, path: str) -> DataFrame:
    """``path, n_samples, seconds, peak, rms`` of 16 kHz mono 16-bit WAV files; ``problem`` where one is something else."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    x = decode(content)
                    rows.append((p, len(x), len(x) / RATE, float(np.abs(x).max(initial=0)), float(np.sqrt((x.astype(np.float64) ** 2).mean())) if len(x) else 0.0, None))
                except (ValueError, wave.Error, EOFError) as e:
                    rows.append((p, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "n_samples", "seconds", "peak", "rms", "problem"])

    return raw.mapInArrow(read, "path string, n_samples bigint, seconds double, peak double, rms double, problem string")


def decode(content: bytes) -> np.ndarray:
    """Samples of a WAV file from -1 to below 1."""
    with wave.open(io.BytesIO(content)) as w:
        for what, have, want in (("channels", w.getnchannels(), 1), ("rate", w.getframerate(), RATE), ("sample width", w.getsampwidth(), 2)):
            if have != want:
                raise ValueError(f"{what} {have}, not {want}")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768


def ground_truth(spark: SparkSession, folder: str, slugs: list[str]) -> DataFrame:
    """``slug, must_contain, must_not_contain, samples`` of YAML files ``slug.yml`` or ``slug.yaml``; others, and broken ones, have none."""
    import os

    rows = []
    for s in slugs:
        for suffix in (".yml", ".yaml"):
            path = os.path.join(folder, s + suffix)
            if os.path.exists(path):
                try:
                    y = _yaml(path)
                except Exception:  # noqa: BLE001 - a broken file is as good as none
                    break
                rows.append((s, list(y.get("must_contain") or []), list(y.get("must_not_contain") or []), [(float(x.get("start", 0)), str(x.get("text", ""))) for x in y.get("sample_segments") or []]))
                break
    return spark.createDataFrame(rows, "slug string, must_contain array<string>, must_not_contain array<string>, samples array<struct<sample_s:double,text:string>>")
