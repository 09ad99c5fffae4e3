"""The whole way from segments to exports as one plan, and the parts that a deployment plugs in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import rules, segments
from lectern.session import materialise
from lectern.sources.settings import Settings


class Answerer(Protocol):
    """What proposes corrections: a batch of requests in, an answer for each it knows, or an exception."""

    def __call__(self, batch: list[dict]) -> list[dict]: ...


class Recogniser(Protocol):
    """Speech to text: samples of a window in, items with start, end, text and scores out."""

    def __call__(self, samples: bytes, window_start: float, window_end: float) -> list[dict]: ...


RECOGNISERS: dict[str, Recogniser] = {}


def recogniser(name: str) -> Recogniser:
    if name not in RECOGNISERS:
        raise ValueError(f"unknown recogniser {name}; there are {', '.join(sorted(RECOGNISERS)) or 'none'}")
    return RECOGNISERS[name]


def ask(requests: DataFrame, answerer: Answerer, size: int) -> DataFrame:
    """``video_id, batch, answer, error, tokens_in, tokens_out``: one call a batch of at most ``size`` requests; a failed call
    fails only its batch. Tokens are those that the answerer counted for the batch, if it counts any."""
    x = segments.batches(requests, size).groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(F.struct("id", "prev", "text", "next", "flags"))).alias("r"))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            out, errors, used = [], [], []
            for r in b.column("r").to_pylist():
                before = [getattr(answerer, n, 0) for n in ("tokens_in", "tokens_out")]
                try:
                    out.append(json.dumps({"results": answerer(r)}, ensure_ascii=False))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a failed batch is data
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                used.append([getattr(answerer, n, 0) - k for n, k in zip(("tokens_in", "tokens_out"), before)])
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("batch"), pa.array(out, pa.string()), pa.array(errors, pa.string()), *(pa.array([u[k] for u in used], pa.int64()) for k in (0, 1))], names=["video_id", "batch", "answer", "error", "tokens_in", "tokens_out"])

    return x.mapInArrow(call, "video_id bigint, batch bigint, answer string, error string, tokens_in bigint, tokens_out bigint")


def answers_of(asked: DataFrame) -> DataFrame:
    """A row for each answer in the batches' JSON, ``ord`` by batch and place; what isn't JSON gives none."""
    from lectern.functions.text import salvage_json

    x = asked.withColumn("a", F.from_json(salvage_json("answer"), f"results array<struct<{','.join(c.replace(' ', ':', 1) for c in segments.ANSWER.split(', '))}>>"))
    return x.select("video_id", "batch", F.posexplode("a.results").alias("place", "r")).select("video_id", (F.col("batch") * 1_000_000 + F.col("place")).alias("ord"), "r.*").where("id is not null")


def flagged(raw: DataFrame, rule_table: DataFrame, glossary: DataFrame) -> DataFrame:
    """Segments spelled and corrected, with ``flags`` by all eight checks on the corrected text.

    Corrections are written once, since the near misses and the segments themselves both start from them."""
    made, terms = rules.settings_of(rule_table, glossary)
    x = materialise(rules.correct(segments.once(raw), made, terms), "corrected")
    near = rules.near_misses(x, terms).withColumn("__near", F.lit(True))
    return x.join(near, ["video_id", "id"], "left").withColumn("flags", segments.flags_of("text", F.col("__near"), F.size("candidates") > 0)).drop("__near")


def correct(raw: DataFrame, rule_table: DataFrame, glossary: DataFrame, settings: Settings | None = None, answerer: Answerer | None = None) -> DataFrame:
    """Segments spelled, corrected, flagged and, with an answerer, asked about and decided. Without an answerer every flagged segment needs review."""
    settings = settings or Settings()
    x = flagged(raw, rule_table, glossary)
    if answerer is None:
        return x.withColumn("asked", F.lit(False)).withColumn("accepted", F.lit(False)).withColumn("rejected_reason", F.lit(None).cast("string")).withColumn("needs_review", F.size("flags") > 0)
    x = segments.with_neighbours(x)
    answers = answers_of(ask(x.where(F.size("flags") > 0), answerer, settings.batch_size))
    return segments.decide(x.withColumn("asked", F.size("flags") > 0), answers, settings.accept_confidence).drop("prev", "next")


def differences(decided: DataFrame) -> DataFrame:
    """Segments that were changed, need review or have flags, with what was done to them."""
    changed = ~F.col("raw_text").eqNullSafe(F.col("text"))
    source = F.when(F.col("accepted") | F.col("rejected_reason").isNotNull(), "llm").when(F.size("rule_hits") > 0, "rule").when(F.col("n_case") > 0, "glossary_case")
    x = decided.where(changed | F.col("needs_review") | (F.size("flags") > 0))
    return x.select("video_id", "id", "start_s", "end_s", F.col("raw_text").alias("raw"), F.col("text").alias("corrected"), source.alias("source"), changed.alias("accepted"), "rejected_reason", "flags", "needs_review")
