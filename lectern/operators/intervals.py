"""Continuous periods and gaps of interval sets, by canonical dyadic blocks.

An integer interval is a union of few dyadic blocks [i*2^k, (i+1)*2^k). Blocks nest or are disjoint, so a union of
intervals is reduced by dropping blocks under an ancestor, merging sibling pairs into their parent and at last joining
neighbours. The step is associative: it runs over each Arrow batch before the shuffle and again behind it.

Time is cut into cells of 2^CELL_BITS ms, and (key, cell) is the unit of distribution, so that one hot key spreads over
tasks; behind the shuffle rows come sorted and one period is carried from batch to batch, so no group is ever held.
Across cells only a summary row for each cell is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow_groups import column, starts_of

CELL_BITS = 22
#: Times beyond this many ms from 0 (69 years) are no times.
FARTHEST_MS = 1 << 41


def dyadic_blocks(group: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, level) of the canonical blocks of each [start, end), 0 <= start < end <= 2^bits; repeats dropped."""
    gs, ss, ls = [], [], []
    g, lo, hi = group, start.copy(), end.copy()
    for level in range(bits + 1):
        if not len(g):
            break
        odd = (lo & 1 == 1) & (lo < hi)
        left = (g[odd], lo[odd])
        lo = lo + odd
        odd = (hi & 1 == 1) & (lo < hi)
        hi = hi - odd
        right = (g[odd], hi[odd])
        both_g, both_i = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
        if len(both_g):
            key = np.unique((both_g << (bits + 1)) | both_i)
            gs.append(key >> (bits + 1))
            ss.append((key & ((1 << (bits + 1)) - 1)) << level)
            ls.append(np.full(len(key), level))
        on = lo < hi
        g, lo, hi = g[on], lo[on] >> 1, hi[on] >> 1
    if not gs:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(gs), np.concatenate(ss), np.concatenate(ls)


def drop_covered(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without blocks below an ancestor. As blocks nest or are disjoint, those start before the furthest end so far."""
    if not len(group):
        return group, start, level
    order = np.lexsort((-level, start, group))
    group, start, level = group[order], start[order], level[order]
    width = np.int64(1) << np.int64(CELL_BITS + 2)
    reach = np.maximum.accumulate(group * width + start + (np.int64(1) << level))
    keep = np.ones(len(group), bool)
    keep[1:] = group[1:] * width + start[1:] >= reach[:-1]
    return group[keep], start[keep], level[keep]


def merge_siblings(group: np.ndarray, start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sibling blocks become their parent, from the lowest level upward."""
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    up_g, up_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(int(level.max(initial=0)) + CELL_BITS + 1):
        here = level == k
        g, s = np.concatenate([group[here], up_g]), np.concatenate([start[here], up_s])
        if not len(g):
            up_g, up_s = g, s
            if k > level.max(initial=0):
                break
            continue
        order = np.lexsort((s, g))
        g, s = g[order], s[order]
        first = np.zeros(len(g), bool)
        first[:-1] = (g[1:] == g[:-1]) & (s[1:] == s[:-1] + (1 << k)) & (s[:-1] >> k & 1 == 0)
        pair = first.copy()
        pair[1:] |= first[:-1]
        up_g, up_s = g[first], s[first]
        out.append((g[~pair], s[~pair], k))
    return np.concatenate([x[0] for x in out] or [up_g]), np.concatenate([x[1] for x in out] or [up_s]), np.concatenate([np.full(len(x[0]), x[2]) for x in out] or [np.zeros(0, np.int64)])


def union_of(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The disjoint, non-touching periods of each group, in order."""
    g, s, k = merge_siblings(*drop_covered(*dyadic_blocks(group, start, end)))
    if not len(g):
        return g, s, s
    order = np.lexsort((s, g))
    g, s, e = g[order], s[order], (s + (np.int64(1) << k))[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (s[1:] != e[:-1])
    last = np.append(first[1:], True)
    return g[first], s[first], e[last]


def _combine(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = [column(b, k) for k in [*keys, "cell"]]
            order = np.lexsort(raw[::-1])
            raw = [x[order] for x in raw]
            first = starts_of(*raw)
            g, s, e = union_of(np.cumsum(first) - 1, column(b, "s")[order], column(b, "e")[order])
            at = order[np.flatnonzero(first)[g]]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in [*keys, "cell"]), pa.array(s), pa.array(e)], names=[*keys, "cell", "s", "e"])

    return run


def _sweep(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows in; out: gaps inside a cell (kind 0) and, for each cell, its first start and last end (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # one row: the open period of the last cell, and the cell's first start in "f"
        names = [*keys, "cell"]
        schema: pa.Schema | None = None

        def rows(table: pa.Table, at: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            base = column(table, "cell")[at] << CELL_BITS
            t = table.select(names).take(pa.array(at)).combine_chunks()
            cols = [t.column(n).combine_chunks() if t.num_rows else pa.array([], t.schema.field(n).type) for n in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), kind, np.int32)), pa.array(a + base), pa.array(b + base)], names=[*names, "kind", "a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).append_column("f", b.column("s")).select([*names, "s", "e", "f"])
            schema = schema or t.schema
            if held is not None:
                t = pa.concat_tables([pa.Table.from_batches([held]).cast(schema), t]).combine_chunks()
            first = starts_of(*(column(t, k) for k in names))
            at = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            g, s, e = union_of(group, column(t, "s"), column(t, "e"))
            inner = np.flatnonzero(g[1:] == g[:-1])
            if len(inner):
                yield rows(t, at[g[inner]], 0, e[inner], s[inner + 1])
            first_s = column(t, "f")[at]
            last_e = e[np.append(np.flatnonzero(g[1:] != g[:-1]), len(g) - 1)]
            if len(at) > 1:
                yield rows(t, at[:-1], 1, first_s[:-1], last_e[:-1])
            open_ = t.select(names).slice(int(at[-1]), 1)
            held = pa.Table.from_arrays([*(open_.column(n) for n in names), pa.array(s[-1:]), pa.array(e[-1:]), pa.array(first_s[-1:])], names=[*names, "s", "e", "f"]).combine_chunks().to_batches()[0]
        if held is not None:
            t = pa.Table.from_batches([held])
            yield rows(t, np.array([0]), 1, column(t, "f"), column(t, "e"))

    return run


def _pieces(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    near = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < FARTHEST_MS / 1000)
    x = df.where(near(start) & near(end) & (F.col(end) > F.col(start))).select(*keys, ms(start).alias("from_"), ms(end).alias("to_")).where("to_ > from_")
    lo, hi = F.shiftright("from_", CELL_BITS), F.shiftright(F.col("to_") - 1, CELL_BITS)
    x = x.select("*", F.explode(F.sequence(lo, hi)).alias("cell"))
    base = F.shiftleft("cell", CELL_BITS)
    x = x.select(*keys, "cell", (F.greatest("from_", base) - base).alias("s"), (F.least("to_", base + (1 << CELL_BITS)) - base).alias("e"))
    kinds = ", ".join(f"`{k}` {dict(x.dtypes)[k]}" for k in keys)
    x = x.mapInArrow(_combine(keys), f"{kinds}, cell bigint, s bigint, e bigint")
    x = x.repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", "s")
    return x.mapInArrow(_sweep(keys), f"{kinds}, cell bigint, kind int, a bigint, b bigint")


def gaps(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Stretches of positive length between successive continuous periods of each key: keys, ``gap_from_ms``, ``gap_to_ms``.

    Keys are integers and may be null; null is a key of its own. Times are seconds. Rows whose start or end is null, not
    finite or beyond FARTHEST_MS, or whose end isn't after the start, count for nothing. Touching and nested intervals
    belong together, repeated rows change nothing. Other columns are ignored; an empty table gives none.
    """
    x = _pieces(df, keys, start, end)
    # cell summaries of a key meet in one window; the gaps inside cells stay with their cell
    w = Window.partitionBy(*keys, F.when(F.col("kind") == 1, F.lit(None)).otherwise(F.col("cell"))).orderBy("kind", "cell", "a")
    x = x.select(*keys, "kind", F.when(F.col("kind") == 0, F.col("a")).otherwise(F.lag("b").over(w)).alias("gap_from_ms"), F.when(F.col("kind") == 0, F.col("b")).otherwise(F.col("a")).alias("gap_to_ms"))
    return x.where("gap_to_ms > gap_from_ms").select(*keys, "gap_from_ms", "gap_to_ms")


def periods(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Continuous periods of each key: keys, ``from_ms``, ``to_ms``. Same rules as :func:`gaps`.

    A period runs from the end of one gap to the start of the next; each key's outermost bounds are one more row.
    """
    x = _pieces(df, keys, start, end)
    salt = F.when(F.col("kind") == 1, F.lit(None)).otherwise(F.col("cell"))
    w = Window.partitionBy(*keys, salt).orderBy("kind", "cell", "a")
    x = x.select(*keys, "cell", "kind", "a", "b", F.lag("b").over(w).alias("before"), F.lead("a").over(w).alias("after"))
    # a bound row: a period's start with the one end that may be known, or the reverse
    opens = F.when((F.col("kind") == 0), F.col("b")).when(F.col("before").isNull() | (F.col("before") < F.col("a")), F.col("a"))
    closes = F.when((F.col("kind") == 0), F.col("a")).when(F.col("after").isNull() | (F.col("after") > F.col("b")), F.col("b"))
    x = x.select(*keys, "cell", F.explode(F.array(F.struct(opens.alias("t"), F.lit(1).alias("o")), F.struct(closes.alias("t"), F.lit(0).alias("o")))).alias("x")).where("x.t is not null")
    # bounds pair up within their cell; a cell leaves at most an open start and an open end, and only these meet by key
    w = Window.partitionBy(*keys, "cell").orderBy("t", "o")
    x = x.select(*keys, "cell", F.col("x.t").alias("t"), F.col("x.o").alias("o"))
    x = x.withColumn("to_ms", F.lead("t").over(w)).withColumn("alone", F.when(F.col("o") == 1, F.col("to_ms").isNull()).otherwise(F.lag("t").over(w).isNull()))
    x = x.where(F.col("alone") | (F.col("o") == 1))
    w = Window.partitionBy(*keys, F.when(F.col("alone"), F.lit(None)).otherwise(F.col("cell"))).orderBy("t", "o")
    x = x.withColumn("to_ms", F.when(F.col("alone"), F.lead("t").over(w)).otherwise(F.col("to_ms")))
    return x.where("o = 1").select(*keys, F.col("t").alias("from_ms"), "to_ms")
