"""Runs of equal or nearly equal consecutive events, by regular expressions over strings of symbols (2).

Events are mapped to code points: an event that is the same as the one before takes its symbol, any other takes the
symbol of its canonical text. The symbols of a chunk of consecutive ids make one string, in which a back reference finds
the runs, and the spans of its matches lead back to ids and times. Chunks share one event with the chunk before, so runs
across chunks meet in that event and are joined, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow_groups import column, starts_of, whole_groups
from lectern.llm.forms import letters_of

CHUNK = 1024
#: Nearly the same: this part of the characters may differ.
DIFFER = 0.1
RUN = re.compile(r"([^\n])\1+")
#: Distances up to this are as soon found as bounded.
CHEAP, GRAM = 8, 5
DIGITS = re.compile(r"\d+")
#: Symbols are the code points from here on, taken in turn.
FIRST_SYMBOL, SYMBOLS = 0xF0000, 0xFFF0
BLANK = "\n"


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``most``, by furthest reaching diagonals."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False

    def slide(i: int, j: int) -> int:
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    reach = {0: slide(0, 0)}
    if reach[0] == n == m:
        return True
    for e in range(1, most + 1):
        new = {}
        for d in range(-e, e + 1):  # diagonal: position in a less position in b
            i = max(reach.get(d - 1, -2) + 1, reach.get(d, -2) + 1, reach.get(d + 1, -2))
            if i < 0:
                continue
            i = min(i, n)
            j = i - d
            if j < 0 or j > m:
                continue
            i = slide(i, j)
            if i == n and i - d == m:
                return True
            new[d] = i
        reach = new
    return False


def _apart(a: str, b: str, most: int) -> bool:
    """Whether the runs of GRAM characters show that the edit distance is above ``most``: an edit changes GRAM of either text."""
    x, y = (Counter(t[i : i + GRAM] for i in range(len(t) - GRAM + 1)) for t in (a, b))
    return max((x - y).total(), (y - x).total()) > GRAM * most


def same(a: str, b: str) -> bool:
    """The same letters and digits, or with equal numbers at most a tenth of the characters differ; both not empty."""
    if a == b:
        return True
    longest = max(len(a), len(b))
    most = int(longest * DIFFER + 1e-9)
    if not most or abs(len(a) - len(b)) > most or DIGITS.findall(a) != DIGITS.findall(b):
        return False
    return not (most > CHEAP and _apart(a, b, most)) and within(a, b, most)


def symbols(texts: list[str], follows: list[bool]) -> str:
    """One code point an event. ``follows``: the event is the next id after the one before."""
    known: dict[str, int] = {}
    out: list[str] = []
    last, code = "", -1
    fresh = 0
    for key, near in zip(texts, follows):
        if not key:
            out.append(BLANK)
            code = -1
        else:
            if code >= 0 and near and same(last, key):
                pass  # the symbol of the event before
            else:
                before = code
                code = known.get(key, -1)
                if code < 0 or code == before:
                    code = fresh = (fresh + 1) % SYMBOLS
                    if code == before:
                        code = fresh = (fresh + 1) % SYMBOLS
                    known[key] = code
            out.append(chr(FIRST_SYMBOL + code))
        last = key
    return "".join(out)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["video_id", "chunk"], 10_000):
        fresh = starts_of(*(column(t, c) for c in ("video_id", "chunk", "id")))
        if not fresh.all():
            t = t.filter(pa.array(fresh)).combine_chunks()
        video, chunk, ids, begin, end = (column(t, c) for c in ("video_id", "chunk", "id", "start_s", "end_s"))
        keys = [letters_of(x) if x else "" for x in t.column("text").to_pylist()]
        at = [*np.flatnonzero(starts_of(video, chunk)), len(ids)]
        rows = []
        for lo, hi in zip(at, at[1:]):
            follows = [False, *(ids[lo + 1 : hi] == ids[lo : hi - 1] + 1).tolist()]
            for m in RUN.finditer(symbols(keys[lo:hi], follows)):
                a, b = lo + m.start(), lo + m.end()
                s, e = begin[a:b], end[a:b]
                s, e = s[~np.isnan(s)], e[~np.isnan(e)]
                rows.append((int(video[a]), int(ids[a]), int(ids[b - 1]), b - a, float(s.min()) if len(s) else None, float(e.max()) if len(e) else None, bool(ids[a] // CHUNK < chunk[a] or ids[b - 1] % CHUNK == CHUNK - 1)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["video_id", "first_id", "last_id", "n_events", "start_s", "end_s", "edge"])


def collapse(df: DataFrame) -> DataFrame:
    """Runs of two or more: ``video_id, first_id, last_id, n_events, start_s, end_s, duration_s``.

    ``df`` has video_id, id, start_s, end_s, text. Events follow each other by id; a missing id ends a run. Null, blank
    and wordless texts belong to no run and end one. Times are the least start and the greatest end that aren't null;
    a run with none has null. Exact copies count once, rows without video or id not at all, other columns are ignored.
    """
    x = df.select("video_id", "id", "start_s", "end_s", "text").where("video_id is not null and id is not null")
    own = F.floor(F.col("id") / CHUNK)
    into = F.array_compact(F.array(own, F.when(F.col("id") - own * CHUNK == CHUNK - 1, own + 1)))
    x = x.select("*", F.explode(into).alias("chunk")).repartition("video_id", "chunk")
    x = x.sortWithinPartitions("video_id", "chunk", "id", "start_s", "end_s", "text")
    x = x.mapInArrow(_find, "video_id bigint, first_id bigint, last_id bigint, n_events bigint, start_s double, end_s double, edge boolean")
    # only runs at the edges of chunks meet in a window; the others stay apart by their first id
    w = Window.partitionBy("video_id", F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("first_id"))).orderBy("first_id", "last_id")
    new = F.coalesce(F.lag("last_id").over(w) != F.col("first_id"), F.lit(True))
    x = x.withColumn("new", F.when(new, F.col("first_id"))).withColumn("head", F.last("new", ignorenulls=True).over(w))
    x = x.groupBy("video_id", "head").agg(F.max("last_id").alias("last_id"), (F.sum("n_events") - F.count("*") + 1).alias("n_events"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return x.select("video_id", F.col("head").alias("first_id"), "last_id", "n_events", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"))
