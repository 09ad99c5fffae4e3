"""Similarity of texts by their longest common subsequence, and edit distance over words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Words become the code points from here on.
FIRST, SURROGATES = 0x100, 0xD800


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        both = row & where.get(c, 0)
        row = ((row + both) | (row - both)) & mask
    return len(a) - row.bit_count()


@F.arrow_udf(IntegerType())
def common(a: pa.Array, b: pa.Array) -> pa.Array:
    """:func:`lcs` of two columns; null if either is."""
    return pa.array([None if x is None or y is None else lcs(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 100: twice the common subsequence over the sum of lengths; 100 for two empty texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(100.0)).otherwise(common(a, b) * F.lit(200.0) / both)


def at_least(a: Column, b: Column, percent: int) -> Column:
    """Whether the likeness is ``percent`` or more, in whole numbers."""
    return common(a, b) * 200 >= (F.length(a) + F.length(b)) * percent


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each word becomes one character, then Spark's own distance holds.

    Code points that stand for half a character are passed over, so there are a million of them.
    """
    words = F.array_distinct(F.concat(a, b))
    code = lambda k: k.cast("int") + F.when(k < SURROGATES - FIRST + 1, FIRST - 1).otherwise(FIRST - 1 + 0x800)
    mapped = lambda x: F.array_join(F.transform(x, lambda w: F.decode(F.unhex(F.lpad(F.hex(code(F.array_position(words, w))), 8, "0")), "UTF-32")), "")
    return F.levenshtein(mapped(a), mapped(b))
