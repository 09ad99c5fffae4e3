"""The share of a text that repeats what the same text has said before, by a short-circuit cascade of rules (1).

Each rule but the last can only reject: it bounds the repeated share from above, so the order of the rules changes the
cost and never the result. Their cost and selectivity are measured on a bounded sample, and they run in the order of
rejections per cost; only what no rule rejects meets the exact measure.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import words_of

#: A phrase has this many words, or characters where scripts have no spaces.
PHRASE_WORDS = 4
PHRASE_CHARS = 8
#: Shorter units count when said this often on end.
TIMES = 4
LEAST_SHARE = 0.5
#: Rows on which cost and selectivity of the rules are measured.
SAMPLE_ROWS = 2000
UNSPACED = re.compile("[฀-๿぀-ヿ㐀-䶿一-鿿豈-﫿]")


@dataclass
class Units:
    """A text in units: words, or single characters where most letters belong to scripts without spaces."""

    units: list[str]
    lengths: list[int]
    phrase: int
    total: int


def units_of(text: str) -> Units:
    words = words_of(text)
    total = sum(map(len, words))
    if 2 * len(UNSPACED.findall(text)) > total:
        flat = list("".join(words))
        return Units(flat, [1] * len(flat), PHRASE_CHARS, total)
    return Units(words, list(map(len, words)), PHRASE_WORDS, total)


def repeated(u: Units) -> int:
    """Characters of ``u`` in phrases said before, or in short units said TIMES or more times on end but for the first."""
    x, k, n = u.units, u.phrase, len(u.units)
    mark = bytearray(n)
    seen: dict[tuple[str, ...], int] = {}
    done = 0  # everything before is marked or passed
    for i in range(n - k + 1):
        gram = tuple(x[i : i + k])
        at = seen.setdefault(gram, i)
        if at + k <= i:
            lo = max(i, done)
            mark[lo : i + k] = b"\1" * (i + k - lo)
            done = i + k
    for unit in range(1, min(k - 1, n // TIMES) + 1):
        run = 0
        for i in range(unit, n + 1):
            if i < n and x[i] == x[i - unit]:
                run += 1
                continue
            if run >= (TIMES - 1) * unit:
                mark[i - run : i] = b"\1" * run
            run = 0
    lengths = u.lengths
    return sum(lengths[i] for i in range(n) if mark[i])


def _few(u: Units) -> bool:
    """Fewer units than any repetition needs."""
    return len(u.units) < TIMES


def _new_units(u: Units) -> bool:
    """Units said for the first time make up more than the rest may."""
    return sum(map(len, set(u.units))) > u.total * (1 - LEAST_SHARE)


def _new_pairs(u: Units) -> bool:
    """A repeated unit stands beside a neighbour it stood beside before: one unit of each new pair is new there."""
    x = u.units
    seen: set[tuple[str, str]] = set()
    repeats = bytearray(len(x))
    for i in range(len(x) - 1):
        pair = (x[i], x[i + 1])
        if pair in seen:
            repeats[i] = repeats[i + 1] = 1
        else:
            seen.add(pair)
    return sum(n for n, r in zip(u.lengths, repeats) if r) < u.total * LEAST_SHARE


RULES: dict[str, Callable[[Units], bool]] = {"few": _few, "new_units": _new_units, "new_pairs": _new_pairs}


def order_rules(texts: list[str]) -> list[str]:
    """Rule names by rejections per second over ``texts``, best first; ties and empty samples keep the order of RULES."""
    units = [units_of(t) for t in texts if t]
    score = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejected = sum(map(rule, units))
        score[name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(RULES, key=lambda r: -score[r]) if units else list(RULES)


def share(text: str, order: list[str] | None = None) -> float | None:
    """The repeated share of a text, or None where a rule shows that it is below LEAST_SHARE."""
    u = units_of(text)
    if not u.total:
        return None
    for name in order or RULES:
        if RULES[name](u):
            return None
    return repeated(u) / u.total


def exact_share(text: str | None) -> float:
    """The repeated share of any text; 0 for null and for texts without letters."""
    u = units_of(text or "")
    return repeated(u) / u.total if u.total else 0.0


def with_share(df: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """``df`` with ``repeated_share``: of the letters and digits of each text, the part that repeats what it said before.

    Below LEAST_SHARE the share is null, as the cascade stops where it is sure. Null, blank and very short texts have
    null; texts are taken whole; an existing column of that name is replaced. ``order`` is measured where not given.
    """
    if order is None:
        order = order_rules([r[0] for r in df.select(text).where(F.col(text).isNotNull()).limit(SAMPLE_ROWS).collect()])

    @F.arrow_udf("double")
    def shares(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else s if (s := share(t, order)) is not None and s >= LEAST_SHARE else None for t in a.to_pylist()], pa.float64())

    return df.withColumn("repeated_share", shares(F.col(text)))


def with_every_share(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``repeated_share`` of every text, however small: the exact measure without the cascade. Null for null."""

    @F.arrow_udf("double")
    def shares(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else exact_share(t) for t in a.to_pylist()], pa.float64())

    return df.withColumn("repeated_share", shares(F.col(text)))


def repetitive(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``repeated_share`` of texts at least LEAST_SHARE of which is repetition; exact copies count once."""
    x = with_share(df.select(*keys, text), text).where(F.col("repeated_share").isNotNull())
    return x.groupBy(*keys).agg(F.max("repeated_share").alias("repeated_share"))
