"""Streaming over sorted Arrow batches without splitting a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A numeric column as numpy; nulls of floats become NaN, of integers the least value."""
    x = batch.column(name)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    if pa.types.is_floating(x.type):
        return x.to_numpy(zero_copy_only=False).astype(np.float64)
    if x.null_count:
        x = x.fill_null(np.iinfo(np.int64).min if x.type == pa.int64() else np.iinfo(np.int32).min)
    return x.to_numpy(zero_copy_only=False).astype(np.int64)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """True at the first row of each run of equal keys."""
    first = np.zeros(len(keys[0]), bool)
    if len(first):
        first[0] = True
        for k in keys:
            first[1:] |= k[1:] != k[:-1]
    return first


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows or more out of batches sorted by ``keys``; no group spans two tables.

    Memory is bounded by ``least`` plus the largest group, so callers bound their groups (chunks of ids, cells of time).
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        first = np.flatnonzero(starts_of(*(column(t, k) for k in keys)))
        cut = int(first[-1])
        if cut:
            yield t.slice(0, cut)
            rest = t.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        else:
            held = t.to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()
