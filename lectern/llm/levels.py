"""Reading level of each document by harmonic propagation over the document-word graph (10).

Documents and words are the two sides of a graph; an edge weighs as much as the word takes of the document. Graded
documents are clamped to the mean of their grades. A word's difficulty is the weighted mean of its documents', a
document's that of its words, each word counting as far as it tells levels apart. These means are taken in turn until no
word's difficulty moves by TOLERANCE of a grade any more. As means shrink toward the middle, each round brings documents
back to the grades' scale by a line for each script and language fitted on the graded ones.

Words are hashed into a fixed number of nodes, so a round sends and gathers at most that many numbers, whatever the number
of documents; the edges stay where they are, in a table in the shared folder.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.forms import words_of
from lectern.session import materialise

#: Word nodes, a power of two.
NODES = 1 << 17
#: Rounds end when no word moves farther than this, in grades; if MOST_ROUNDS don't get there, that is an error.
TOLERANCE = 0.02
MOST_ROUNDS = 60
#: Grades counted in for a word beside its own, at the mean of all.
WORD_PRIOR = 3.0
#: Bins of a document's mean, over the scale of grades, in which graded documents are counted.
BINS, LOW, HIGH = 800, 1.0, 5.0
DEMANDING = 4
#: Kinds of document that are held to the grades' scale apart: its script and, in LANGS hashed classes, its stated language.
LANGS = 16
#: Weight, in graded documents, of the line and cut over all kinds against a kind's own.
SCRIPT_PRIOR = 6.0
CUT_PRIOR = 10.0

#: Scripts by the letters that tell them, kana before Han.
SCRIPTS = tuple(re.compile(f"[{c}]") for c in ("A-Za-zÀ-ɏẠ-ỹ", "Ѐ-ӿ", "぀-ヿ", "㐀-䶿一-鿿", "฀-๿", "ऀ-ॿ"))
UNSPACED = re.compile("[฀-๿぀-ヿ㐀-䶿一-鿿]")
KINDS = len(SCRIPTS) * LANGS
EDGES = "script int, nodes array<int>, tokens array<int>"


def features(text: str) -> dict[str, int]:
    """Words of a text, or pairs of characters in scripts without spaces, with their counts."""
    words = Counter(words_of(text))
    if not UNSPACED.search(text):
        return words
    out: Counter[str] = Counter()
    for w, n in words.items():
        if UNSPACED.search(w):
            for i in range(max(1, len(w) - 1)):
                out[w[i : i + 2]] += n
        else:
            out[w] += n
    return out


def script_of(words: dict[str, int]) -> int:
    """The script that most of a text's letters are in; Japanese is told by kana, however few; others are Latin's."""
    some = "".join(words)
    n = [len(s.findall(some)) for s in SCRIPTS]
    if n[2] * 10 > n[3] > 0 and n[2] + n[3] >= max(n):
        return 2
    return int(np.argmax(n))


def kind_of(words: dict[str, int], lang: str | None) -> int:
    """Script and stated language of a document; languages that say nothing share a class."""
    lang = (lang or "").strip().lower()
    return script_of(words) * LANGS + (0 if lang in ("", "und") else 1 + zlib.crc32(lang.encode("utf-8", "surrogatepass")) % (LANGS - 1))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        scripts, nodes, counts = [], [], []
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            by: dict[int, int] = {}
            words = features(text or "")
            for w, n in words.items():
                node = known.get(w)
                if node is None:
                    node = zlib.crc32(w.encode("utf-8", "surrogatepass")) & (NODES - 1)
                    if len(known) < 500_000:
                        known[w] = node
                by[node] = by.get(node, 0) + n
            order = sorted(by)
            scripts.append(kind_of(words, lang))
            nodes.append(order)
            counts.append([by[k] for k in order])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scripts, pa.int32()), pa.array(nodes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "script", "nodes", "tokens"])


def graph(documents: DataFrame, grades: DataFrame) -> DataFrame:
    """``doc_id, script, nodes, tokens, grade``: a document's kind and edges, and its mean grade where it has one."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    x = documents.select("doc_id", "text", lang.alias("lang")).where(F.col("doc_id").isNotNull()).mapInArrow(_edges, f"doc_id bigint, {EDGES}")
    # exact copies of a grade count once, two raters' equal grades twice
    g = grades.where("doc_id is not null and level is not null").groupBy("doc_id", "level", "rater", "rated_at").count()
    g = g.groupBy("doc_id").agg(F.avg("level").alias("grade"))
    return x.join(g, "doc_id", "left")


@dataclass
class Edges:
    """The edges of a batch: for each its document and node, and its weight, the node's part of the document."""

    doc: np.ndarray
    node: np.ndarray
    weight: np.ndarray
    grade: np.ndarray
    script: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Edges:
        nodes, tokens = b.column("nodes"), b.column("tokens")
        size = np.diff(nodes.offsets.to_numpy())
        doc = np.repeat(np.arange(len(size)), size)
        node, n = nodes.flatten().to_numpy(), tokens.flatten().to_numpy().astype(np.float64)
        total = np.bincount(doc, n, len(size))
        grade = b.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
        return cls(doc, node, n / total[doc], grade, b.column("script").to_numpy())


@dataclass
class Words:
    """Difficulty and weight of each node, and the line from a document's mean to the grades' scale by script."""

    level: np.ndarray
    weight: np.ndarray
    lines: np.ndarray
    cuts: np.ndarray
    #: The farthest that any word moved in each round.
    residuals: tuple[float, ...] = ()

    def means(self, e: Edges) -> np.ndarray:
        w = e.weight * self.weight[e.node]
        num, den = np.bincount(e.doc, w * self.level[e.node], len(e.grade)), np.bincount(e.doc, w, len(e.grade))
        return np.where(den > 0, num / np.maximum(den, 1e-12), np.nan)

    def levels(self, e: Edges, means: np.ndarray) -> np.ndarray:
        return np.clip(self.lines[e.script, 0] * means + self.lines[e.script, 1], LOW, HIGH)


def _gather(df: DataFrame, words: Words | None) -> np.ndarray:
    """[3, NODES]: sums over edges of weight times level, weight and one; of graded documents alone if ``words`` is None."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, NODES))
        for b in batches:
            e = Edges.of(b)
            level = e.grade
            if shared.value is not None:
                level = np.where(np.isnan(e.grade), shared.value.levels(e, shared.value.means(e)), e.grade)
            ok = ~np.isnan(level[e.doc])
            node, w = e.node[ok], e.weight[ok]
            total[0] += np.bincount(node, w * level[e.doc[ok]], NODES)
            total[1] += np.bincount(node, w, NODES)
            total[2] += np.bincount(node, minlength=NODES)
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, total[:, at])], names=["node", "a", "b", "c"])

    x = df if words is not None else df.where(F.col("grade").isNotNull())
    x = x.select("script", "nodes", "tokens", "grade").mapInArrow(run, "node bigint, a double, b double, c double")
    x = x.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).toPandas()
    out = np.zeros((3, NODES))
    out[:, x["node"].to_numpy(np.int64)] = x[["a", "b", "c"]].to_numpy(np.float64).T
    return out


def _graded(df: DataFrame, words: Words) -> np.ndarray:
    """[kind, bin, half grade]: graded documents by the bin of their mean, in numbers that don't grow with the data."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((KINDS, BINS, 9))
        for b in batches:
            e = Edges.of(b)
            m = shared.value.means(e)
            ok = ~np.isnan(m)
            bins = np.clip((m[ok] - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            np.add.at(total, (e.script[ok], bins, np.clip(np.rint((e.grade[ok] - 1) * 2), 0, 8).astype(int)), 1)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    x = df.where(F.col("grade").isNotNull()).select("script", "nodes", "tokens", "grade").mapInArrow(run, "cell bigint, n double")
    x = x.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(KINDS * BINS * 9)
    out[x["cell"].to_numpy(np.int64)] = x["n"].to_numpy(np.float64)
    return out.reshape(KINDS, BINS, 9)


def _line(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    total = n.sum()
    mx, my = (n * x).sum() / total, (n * y).sum() / total
    var = (n * (x - mx) ** 2).sum()
    slope = (n * (x - mx) * (y - my)).sum() / var if var > 1e-9 else 0.0
    return slope, my - slope * mx


def calibrate(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each kind the line from means to grades, and the mean that best parts grades of DEMANDING from lower ones.

    Kinds with few graded documents lean on all of them.
    """
    x = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    y = 1 + np.arange(9) / 2
    xx, yy = np.repeat(x, 9), np.tile(y, BINS)
    whole = counts.sum(0)
    lines, cuts = np.zeros((KINDS, 2)), np.zeros(KINDS)
    if not whole.sum():
        lines[:, 0], cuts[:] = 1.0, DEMANDING - 0.5
        return lines, cuts
    every = _line(xx, yy, whole.ravel())
    high = y > DEMANDING - 0.5

    def errors(c: np.ndarray) -> np.ndarray:
        """Graded documents on the wrong side of a cut below each bin."""
        up, down = c[:, high].sum(1), c[:, y < DEMANDING - 0.5].sum(1)
        return np.concatenate([[0], np.cumsum(up)]) + down.sum() - np.concatenate([[0], np.cumsum(down)])

    of_all = errors(whole) / whole.sum()
    for k, c in enumerate(counts):
        n = c.ravel()
        if n.sum():
            m = (n * xx).sum() / n.sum()
            px = np.array([m - 0.5, m + 0.5])
            lines[k] = _line(np.append(xx, px), np.append(yy, every[0] * px + every[1]), np.append(n, np.full(2, SCRIPT_PRIOR / 2)))
        else:
            lines[k] = every
        e = errors(c) + CUT_PRIOR * of_all
        best = np.flatnonzero(e <= e.min() + 1e-9)
        # the middle of the longest run of equally good cuts
        runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
        r = max(runs, key=len)
        cuts[k] = LOW + (r[0] + r[-1]) / 2 * (HIGH - LOW) / BINS
    return lines, cuts


def propagate(edges: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> Words:
    """Word difficulties that no further harmonic round would move, from graded documents outward.

    A word weighs as far as its graded documents tell it from the middle; one that no graded document has, as far as the
    documents that the first round reached do.
    """
    num, den, n = _gather(edges, None)
    mean = num.sum() / den.sum() if den.sum() else (LOW + HIGH) / 2
    apart = lambda level, n: np.abs((level * n + mean * WORD_PRIOR) / (n + WORD_PRIOR) - mean) + 1e-3
    level, graded = np.where(den > 0, num / np.maximum(den, 1e-12), mean), n > 0
    weight = apart(level, n)
    residuals: list[float] = []
    while True:
        words = Words(level.astype(np.float32), weight.astype(np.float32), np.zeros((KINDS, 2)), np.zeros(KINDS), tuple(residuals))
        words.lines, words.cuts = calibrate(_graded(edges, words))
        if not graded.any() or residuals and residuals[-1] <= tolerance:
            return words
        if len(residuals) >= most:
            raise ValueError(f"words still move by {residuals[-1]:.3f} of a grade after {most} rounds")
        num, den, n = _gather(edges, words)
        new = np.where(den > 0, num / np.maximum(den, 1e-12), mean)
        if not residuals:
            weight = np.where(graded, weight, apart(new, n))
        residuals.append(float(np.abs(new - level).max()))
        level = new


def rounds(documents: DataFrame, grades: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``round, residual``: how far the farthest word moved in each round of :func:`propagate`."""
    words = propagate(materialise(graph(documents, grades), "edges"), tolerance)
    return documents.sparkSession.createDataFrame([(k + 1, x) for k, x in enumerate(words.residuals)], "round int, residual double")


def reading_levels(documents: DataFrame, grades: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, score, level, demanding``: the level on the grades' scale, its number, and whether it is DEMANDING or more.

    A document's own grade moves its words and nothing else, so one rater's error doesn't decide. Documents without words
    (null, blank) and all documents where there are no grades have null score and level and aren't demanding. Grades that
    are null or of unknown documents count for nothing, exact copies once. Repeated documents come out once. Texts are
    taken whole.
    """
    edges = materialise(graph(documents, grades), "edges")
    words = propagate(edges, tolerance)
    shared = documents.sparkSession.sparkContext.broadcast(words)
    any_grade = bool(words.weight.max() > 2e-3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = Edges.of(b)
            m = shared.value.means(e) if any_grade else np.full(len(e.grade), np.nan)
            score, hard = shared.value.levels(e, m), np.nan_to_num(m, nan=-1.0) >= shared.value.cuts[e.script]
            top = np.where(hard, np.maximum(np.rint(score), DEMANDING), np.minimum(np.rint(score), DEMANDING - 1))
            none = np.isnan(m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, mask=none), pa.array(np.nan_to_num(top).astype(np.int32), mask=none), pa.array(hard & ~none)], names=["doc_id", "score", "level", "demanding"])

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("level", T.IntegerType()), T.StructField("demanding", T.BooleanType())])
    x = edges.select("doc_id", "script", "nodes", "tokens", "grade").mapInArrow(run, out)
    return x.groupBy("doc_id").agg(F.max("score").alias("score"), F.max("level").alias("level"), F.max("demanding").alias("demanding"))
