"""What people and services are told: progress, benchmark reports, requests."""

from __future__ import annotations

import json
import resource
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Terms of the glossary that a request shows.
TERMS_SHOWN = 40


def _block(*rows: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v.cast("string")) if k else v.cast("string") for k, v in rows])


def in_flight(index: Column, total: Column, slug: Column, share: Column, n_segments: Column, n_flagged: Column, status: Column) -> Column:
    """The text shown while a video is worked on; the share in whole percent, halves to even."""
    head = F.concat(F.format_string("[%03d/%03d] ", index, total), slug)
    return _block(("", head), ("progress", F.concat(F.rint(share * 100).cast("bigint").cast("string"), F.lit("%"))), ("segments", n_segments), ("suspicious", n_flagged), ("status", status))


def completed(path: Column, length: Column, took: Column, n_segments: Column, n_review: Column) -> Column:
    return _block(("", F.lit("completed")), ("output", path), ("duration", T.duration(length)), ("processing", T.duration(took)), ("segments", n_segments), ("needs_review", n_review))


def request(terms: list[str], batch: list[dict]) -> str:
    """The JSON of a request: the first terms and the segments with their surroundings."""
    items = [{k: r[k] for k in ("id", "prev", "text", "next", "flags")} for r in batch]
    return json.dumps({"glossary": terms[:TERMS_SHOWN], "segments": items}, ensure_ascii=False)


def host(url: Column) -> Column:
    """Host and port of an address, or all of it where it has none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), url)


def word_confidence(words: Column, timed: Column) -> Column:
    """The mean probability of an item's words, where words were timed at all."""
    p = F.filter(F.transform(words, lambda w: w["probability"]), lambda x: x.isNotNull())
    return F.when(timed & (F.size(p) > 0), F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p))


def peak_rss_mb() -> float:
    """The most memory this process has had; Linux counts in KiB, macOS in bytes."""
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return peak / (1 << 20 if sys.platform == "darwin" else 1 << 10)


def benchmark(results: DataFrame) -> tuple[str, str]:
    """(JSON, Markdown) of a benchmark's results: video, backend, model, real_time_factor, mean_logprob, flags (map),
    recall, wer. Flags are shown as their number and the three most frequent, ties by name."""
    rows = [r.asDict(recursive=True) for r in results.orderBy("video", "backend", "model").toLocalIterator()]
    show = lambda x: "-" if x is None else f"{x:g}" if isinstance(x, float) else str(x)
    lines = ["| video | backend | model | RTF | log-probability | flags | recall % | WER % |", "|-|-|-|-|-|-|-|-|"]
    for r in rows:
        flags = r.get("flags") or {}
        top = ", ".join(f"{k} {n}" for k, n in sorted(flags.items(), key=lambda x: (-x[1], x[0]))[:3])
        lines.append("| " + " | ".join([r["video"], r["backend"], r["model"], show(r["real_time_factor"]), show(r["mean_logprob"]), f"{sum(flags.values())}{f' ({top})' if top else ''}", show(r["recall"]), show(r["wer"])]) + " |")
    return json.dumps(rows, ensure_ascii=False, indent=2), "\n".join(lines) + "\n"
