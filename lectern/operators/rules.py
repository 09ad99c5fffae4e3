"""Glossary spelling, context-gated correction rules and near misses."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.functions import text as T
from lectern.functions.arrow_groups import column
from lectern.functions.similarity import lcs
from lectern.functions.text import folded

#: Terms and rules are settings, sent to all tasks; more than this many characters of them are refused.
MOST_CHARS = 20_000_000
NEAR = 78


def words_pattern(phrase: str) -> str:
    """A phrase as whole words, whatever white space is between them."""
    return r"(?<!\w)" + r"\s+".join(map(re.escape, phrase.split())) + r"(?!\w)"


_BUILT: dict[str, object] = {}


class Shared:
    """Settings sent to all tasks, and what ``build`` makes of them once in each worker process."""

    def __init__(self, spark: SparkSession, settings: object, build: Callable[[object], object]):
        self.sent, self.build, self.name = spark.sparkContext.broadcast(settings), build, uuid.uuid4().hex

    @property
    def value(self) -> object:
        if self.name not in _BUILT:
            if len(_BUILT) > 8:
                _BUILT.clear()
            _BUILT[self.name] = self.build(self.sent.value)
        return _BUILT[self.name]


@dataclass
class Rule:
    source: str
    target: str
    literal: bool = True
    auto: bool = True
    context: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.pattern = re.compile(words_pattern(self.source) if self.literal else self.source, re.IGNORECASE)
        self.folded = [folded(c) for c in self.context]

    def in_context(self, window: str) -> bool:
        return not self.folded or any(c in window for c in self.folded)


_WORD = re.compile(r"\w+")


def _keyed(text: str) -> str:
    """Case folded so that what a pattern that ignores case takes for equal is equal."""
    return text if text.isascii() and text.islower() else text.casefold().replace("i\u0307", "i").replace("ı", "i")


class Index:
    """Which phrases a text can hold, by their first words: looked up instead of trying each pattern on each text."""

    def __init__(self, phrases: list[str | None]):
        self.by: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, p in enumerate(phrases):
            m = _WORD.search(_keyed(p)) if p is not None else None
            if m:
                self.by.setdefault(m[0], []).append(i)
            else:
                self.always.append(i)

    def possible(self, text: str) -> list[int]:
        """Places of phrases, in order."""
        hits = [self.by[w] for w in self.by.keys() & set(_WORD.findall(_keyed(text)))]
        return sorted({i for h in hits for i in h}.union(self.always)) if hits or self.always else []


class Speller:
    """Writes glossary terms as the glossary does, the longest first."""

    def __init__(self, terms: list[str]):
        ranked = sorted(filter(str.split, terms), key=len, reverse=True)
        self.ranked = [(t, t.casefold(), re.compile(words_pattern(t), re.IGNORECASE)) for t in ranked]
        self.index = Index(ranked)

    def spell(self, text: str) -> tuple[str, int]:
        """The text, and how many places changed."""
        changed = 0
        for k in self.index.possible(text):
            term, low, pattern = self.ranked[k]

            def put(m: re.Match[str], term: str = term, low: str = low) -> str:
                nonlocal changed
                if m[0] != term and m[0].casefold() == low:
                    changed += 1
                    return term
                return m[0]

            text = pattern.sub(put, text)
        return text, changed


class Rules:
    """Rules in order, found by the first words of the literal ones; a regular expression is tried on every text."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.index = Index([r.source if r.literal or re.fullmatch(r"[\w ]+", r.source) else None for r in rules])
        # a regular expression of letters and spaces may match inside words, unlike a literal rule
        self.index.always += [i for i, r in enumerate(rules) if not r.literal and i not in self.index.always]

    def matching(self, text: str) -> list[int]:
        return [i for i in self.index.possible(text) if self.rules[i].pattern.search(text)]

    def fix(self, prev: str, text: str, following: str) -> tuple[str, list[str]]:
        """Automatic rules in order, each on what those before it left; the context is that of the text as it came."""
        window: str | None = None
        hits: list[str] = []
        todo, last = self.index.possible(text), -1
        while todo:
            i = todo.pop(0)
            r = self.rules[i]
            if i <= last or not r.auto or not r.pattern.search(text):
                continue
            if window is None:
                window = folded(f"{prev} {text} {following}")
            if not r.in_context(window):
                continue
            text = r.pattern.sub(r.target, text)
            hits.append(r.source)
            todo, last = self.index.possible(text), i
        return text, hits

    def candidates(self, prev: str, text: str, following: str) -> list[str]:
        """Rules that match but aren't applied: ``manual`` ones, and those whose context is missing."""
        out = []
        window: str | None = None
        for i in self.matching(text):
            r = self.rules[i]
            if not r.auto:
                out.append(f"manual: {r.source}")
            elif r.context:
                window = folded(f"{prev} {text} {following}") if window is None else window
                if not r.in_context(window):
                    out.append(f"unmet context: {r.source}")
        return out


def settings_of(rules: DataFrame, glossary: DataFrame) -> tuple[list[Rule], list[str]]:
    """Rules in their order, and distinct terms in theirs, on the driver; their size is checked first."""
    size = rules.agg(F.sum(F.length("from_text") + F.length("to_text")).alias("n")).first().n or 0
    size += glossary.agg(F.sum(F.length(F.array_join("terms", ""))).alias("n")).first().n or 0
    if size > MOST_CHARS:
        raise ValueError(f"rules and glossary have {size} characters, more than {MOST_CHARS}")
    rows = rules.where("from_text is not null and to_text is not null").orderBy("rule_id").distinct().orderBy("rule_id").collect()
    made = [Rule(r.from_text, r.to_text, r.match_kind != "regex", bool(r.auto), list(r.requires_context or [])) for r in rows if r.from_text.strip()]
    terms = [t for r in glossary.orderBy("glossary_id").collect() for t in (r.terms or []) if t and t.strip()]
    return made, list(dict.fromkeys(terms))


def correct(segments: DataFrame, rules: list[Rule], terms: list[str]) -> DataFrame:
    """Spelling and automatic rules over each video in order of id.

    The text before a segment counts as already corrected, the one behind it as it came. A correction reaches the next
    segment only where that one matches an automatic rule too, so the fold runs over islands of consecutive segments that
    match one, and everything else is free of order: rows are spread by (video, chunk of ids), and islands that cross
    chunks are carried on from the rows before, which each chunk also gets back to where the island begins.

    Adds ``raw_text``, ``n_case``, ``rule_hits``, ``candidates`` (of the corrected text). Null texts stay null.
    """
    spark = segments.sparkSession
    spellers = Shared(spark, (rules, terms), lambda x: (Speller(x[1]), Rules([r for r in x[0] if r.auto])))
    shared = Shared(spark, rules, Rules)
    spelled_type = "struct<text:string,n_case:int,matches:boolean>"

    @F.arrow_udf(spelled_type)
    def spelled(a: pa.Array) -> pa.Array:
        speller, auto = spellers.value
        rows = [("", 0, False) if x is None else (*(y := speller.spell(x)), bool(auto.matching(y[0]))) for x in a.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.bool_()))], names=["text", "n_case", "matches"])

    x = segments.withColumn("raw_text", F.col("text")).withColumn("__s", spelled("text"))
    w = Window.partitionBy("video_id").orderBy("id")
    raw = F.coalesce("raw_text", F.lit(""))
    x = x.withColumn("__matches", F.col("__s.matches"))
    x = x.withColumn("__next", F.lead(raw, 1, "").over(w)).withColumn("__prev", F.lag("__s.text", 1, "").over(w))
    # an island begins at a match behind a segment without one; other segments are islands of their own
    fresh = ~F.col("__matches") | ~F.coalesce(F.lag("__matches").over(w), F.lit(False))
    x = x.withColumn("__island", F.last(F.when(fresh, F.col("id")), ignorenulls=True).over(w))
    islands = x.where("__matches").select("video_id", "id", "__island", F.col("__s.text").alias("text"), "__prev", "__next")
    islands = islands.repartition("video_id", "__island").sortWithinPartitions("video_id", "__island", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        last = (None, None, "")
        for b in batches:
            texts, hits = [], []
            video, island = column(b, "video_id").tolist(), column(b, "__island").tolist()
            for v, i, text, prev, following in zip(video, island, *(b.column(c).to_pylist() for c in ("text", "__prev", "__next"))):
                before = last[2] if last[:2] == (v, i) else prev
                text, hit = made.fix(before, text, following)
                texts.append(text)
                hits.append(hit)
                last = (v, i, text)
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("id"), pa.array(texts, pa.string()), pa.array(hits, pa.list_(pa.string()))], names=["video_id", "id", "__fixed", "rule_hits"])

    fixed = islands.mapInArrow(fold, "video_id bigint, id bigint, __fixed string, rule_hits array<string>")
    x = x.join(fixed, ["video_id", "id"], "left")
    none = F.array().cast("array<string>")
    x = x.withColumn("text", F.when(F.col("raw_text").isNotNull(), F.coalesce("__fixed", "__s.text"))).withColumn("n_case", F.col("__s.n_case")).withColumn("rule_hits", F.coalesce("rule_hits", none))

    @F.arrow_udf("array<string>")
    def left_over(prev: pa.Array, text: pa.Array, following: pa.Array) -> pa.Array:
        made = shared.value
        return pa.array([made.candidates(p or "", t or "", n or "") for p, t, n in zip(prev.to_pylist(), text.to_pylist(), following.to_pylist())], pa.list_(pa.string()))

    now = F.coalesce("text", F.lit(""))
    x = x.withColumn("__before", F.lag(now, 1, "").over(w)).withColumn("__behind", F.lead(now, 1, "").over(w))
    x = x.withColumn("candidates", left_over("__before", "text", "__behind"))
    return x.drop("__s", "__matches", "__next", "__prev", "__island", "__fixed", "__before", "__behind")


def candidates_of(segments: DataFrame, rules: list[Rule]) -> DataFrame:
    """``segments`` (with ``prev`` and ``next``) with ``candidates``: rules that match the text as it is and wouldn't be
    applied to it. Null texts have none."""
    shared = Shared(segments.sparkSession, rules, Rules)

    @F.arrow_udf("array<string>")
    def found(prev: pa.Array, text: pa.Array, following: pa.Array) -> pa.Array:
        made = shared.value
        return pa.array([made.candidates(p or "", t or "", n or "") for p, t, n in zip(prev.to_pylist(), text.to_pylist(), following.to_pylist())], pa.list_(pa.string()))

    return segments.withColumn("candidates", found("prev", "text", "next"))


class Near:
    """Whether runs are nearly one of the terms, and none of them.

    A run's letters and a term's, as bits, bound what they can share; all pairs of a batch are bounded at once, and what
    the bound leaves is compared. What was found of a run is remembered, for as many as MEMORY.
    """

    MEMORY = 1_000_000
    PAIRS = 4_000_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.known: dict[str, bool] = {}
        self.exact = dict.fromkeys(terms, False)
        self.letters = np.array([self._letters(t) for t in terms], np.uint64)
        self.sizes = np.array([len(t) for t in terms])

    @staticmethod
    def _letters(text: str) -> int:
        """Letters as 64 bits; two that share one only weaken the bound."""
        bits = 0
        for c in text:
            bits |= 1 << (ord(c) * 0x9E3779B1 >> 7 & 63)
        return bits

    def of(self, runs: list[str]) -> list[bool]:
        if len(self.known) > self.MEMORY:
            self.known.clear()
        known = self.known
        new = [r for r in dict.fromkeys(runs) if r not in known]
        if new:
            known.update(dict.fromkeys(new, False))
            step = max(1, self.PAIRS // max(1, len(self.terms)))
            for at in range(0, len(new), step):
                self._compare(new[at : at + step])
            known.update((r, False) for r in new if r in self.exact)
        return [known[r] for r in runs]

    def _compare(self, runs: list[str]) -> None:
        own, n = np.array([self._letters(r) for r in runs], np.uint64)[:, None], np.array([len(r) for r in runs])[:, None]
        m = self.sizes[None, :]
        least = -(-NEAR * (n + m) // 200)
        # letters that the other lacks can't be shared
        fits = (np.minimum(n, m) >= least) & (np.bitwise_count(own & ~self.letters) <= n - least) & (np.bitwise_count(self.letters & ~own) <= m - least)
        for i, k in zip(*(x.tolist() for x in np.nonzero(fits))):
            r = runs[i]
            if not self.known[r] and lcs(r, self.terms[k]) * 200 >= NEAR * (len(r) + len(self.terms[k])):
                self.known[r] = True


def near_misses(segments: DataFrame, terms: list[str], keys: tuple[str, ...] = ("video_id", "id")) -> DataFrame:
    """``keys`` of segments with a run of one to three words that is nearly, but not quite, a glossary term.

    Rows are marked where they are, without a shuffle of their runs; a run that many rows repeat is compared once a
    worker. The terms are settings, sent to all tasks in a size that was checked.
    """
    known = sorted({folded(t) for t in terms if t.strip()})
    if not known:
        return segments.select(*keys).limit(0)
    shared = Shared(segments.sparkSession, known, Near)

    @F.arrow_udf(BooleanType())
    def nearly(a: pa.Array) -> pa.Array:
        near, runs, rows = shared.value, [], []
        for i, x in enumerate(a.to_pylist()):
            words = folded(x).split() if x else []
            mine = {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}
            runs += mine
            rows += [i] * len(mine)
        out = np.zeros(len(a), bool)
        hits = np.array(near.of(runs), bool)
        out[np.array(rows, np.int64)[hits]] = True
        return pa.array(out)

    return segments.where("text is not null").select(*keys, nearly("text").alias("__near")).where("__near").select(*keys).distinct()
