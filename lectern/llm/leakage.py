"""Test passages inside training documents, by suffix arrays over shards of the training text (9).

Items and documents become streams of tokens: words, and single characters in scripts without spaces. The items' side is
taken in blocks of a bounded number of tokens and sent to all tasks. Each task joins its documents into shards and builds
the suffix array of each: all places that open with a token of any item, in the order of what follows them. The test
suffixes, sorted once, are searched in it: the two bounds of a test suffix's least run enclose all places that agree with
it, and the neighbours of its own place in the array give the longest verbatim match. What agrees is taken as far as it
goes, so that each maximal match comes out once, with its length and its places in item and document. As every passage
looked for holds a verbatim run of a known least length, whatever is exchanged, no passage is lost.

Around each match item and document are laid side by side; runs of equal tokens are chained over exchanged words, and the
chain must span half of the item.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import _class, _tables, canonical

#: The part of an item that a passage must give, and the part of the passage that may be exchanged.
PART = 0.5
EXCHANGED = 0.1
#: Tokens of items sent to all tasks at once; more items are taken in further passes.
BLOCK_TOKENS = 2_000_000
#: Tokens of training text in one suffix array.
SHARD_TOKENS = 2_000_000
#: Longest verbatim run that is asked for; longer would gain little.
LONGEST_SEED = 8
#: An exchanged word may be this many tokens more or less than the word it replaces.
SHIFT = 1
UNSPACED = "฀-๿぀-ヿ㐀-䶿一-鿿豈-﫿"
_SINGLE = re.compile(f"[{UNSPACED}]")


@cache
def _token() -> tuple[re.Pattern, re.Pattern]:
    marks = "".join(c for c in map(chr, _tables()["apart"]) if not c.isspace())
    return re.compile(f"[{_class(marks)}]+"), re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")


def tokens_of(text: str) -> list[str]:
    """Words without punctuation and, in scripts without spaces, characters, of the canonical form, case folded.

    Punctuation goes without parting a word, as recognisers write 33.64 as 3364.
    """
    marks, token = _token()
    return token.findall(marks.sub("", canonical(text).casefold()))


def unspaced(tokens: list[str]) -> bool:
    """Whether an item is counted in characters: most of its tokens are single characters of scripts without spaces."""
    return 2 * sum(bool(_SINGLE.match(t)) for t in tokens) > len(tokens)


def least_run(weights: np.ndarray) -> int:
    """The longest verbatim run that every passage has at least: what is exchanged can only part it so often.

    A longer passage may have more exchanged and so guarantee less than the shortest one.
    """
    reach = np.concatenate([[0.0], np.cumsum(weights)])
    span = reach[None, :] - reach[:, None]
    place = np.arange(len(reach))
    long = span >= np.ceil(reach[-1] * PART - 1e-9) - 1e-9
    tokens, exchanged = (place[None, :] - place[:, None])[long], np.floor(span[long] * EXCHANGED + 1e-9)
    return max(1, int(np.ceil((tokens - exchanged) / (exchanged + 1) - 1e-9).min()))


def least_covered(weights: np.ndarray, seed: int) -> int:
    """Tokens in verbatim runs of ``seed`` or more that every passage has at least, the other runs being one shorter."""
    reach = np.concatenate([[0.0], np.cumsum(weights)])
    span = reach[None, :] - reach[:, None]
    place = np.arange(len(reach))
    # each exchanged token parts two runs, all but one of which may fall short of a seed
    sure = place[None, :] - place[:, None] - np.floor(span * EXCHANGED + 1e-9) * seed
    long = span >= np.ceil(reach[-1] * PART - 1e-9) - 1e-9
    return max(seed, int(sure[long].min()))


@dataclass
class Items:
    """Items in numbers: token numbers from 1 on, items one behind the other with 0 between, each with its ``seed``, the
    run of tokens that every passage of an item counted alike (in words or in characters) has at least."""

    ids: list[int]
    vocabulary: dict[str, int]
    stream: np.ndarray
    at: np.ndarray
    weights: list[np.ndarray]
    seeds: np.ndarray
    covered: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]]) -> Items:
        vocabulary: dict[str, int] = {}
        stream, at, weights = [0], [], []
        for _, tokens in rows:
            at.append(len(stream))
            stream += [vocabulary.setdefault(t, len(vocabulary) + 1) for t in tokens]
            stream.append(0)
            weights.append(np.array([len(t) for t in tokens], np.float64) if unspaced(tokens) else np.ones(len(tokens)))
        # items of scripts without spaces are told by shorter runs, so words don't share their seed
        kinds = [unspaced(tokens) for _, tokens in rows]
        least = {k: min([LONGEST_SEED, *(least_run(w) for w, of in zip(weights, kinds) if of == k)]) for k in (False, True)}
        seeds = np.array([least[k] for k in kinds], np.int64)
        return cls([i for i, _ in rows], vocabulary, np.array(stream, np.int64), np.array([*at, len(stream)]), weights, seeds, np.array([least_covered(w, s) for w, s in zip(weights, seeds.tolist())]))


class Packed:
    """A stream of token numbers as 64-bit numbers, each holding the next ``per`` tokens of its place in order."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.per = bits, 64 // bits
        n = len(x)
        padded = np.concatenate([x, np.zeros(self.per, x.dtype)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(self.per):
            key = (key << np.uint64(bits)) | padded[j : j + n]
        self.key = key

    def of(self, place: np.ndarray, part: int) -> np.ndarray:
        """The ``part``-th number from each place on; behind the end there are zeros."""
        at = place + part * self.per
        return np.where(at < len(self.key), self.key[np.minimum(at, len(self.key) - 1)], np.uint64(0))


class SuffixArray:
    """The places of ``x`` that open with a known token (not 0), in the order of the tokens from there on.

    Sorted by the first numbers of :class:`Packed`, then by prefix doubling among those still alike, until they differ,
    reach an unknown token, behind which nothing can agree, or agree over ``most`` tokens.
    """

    def __init__(self, x: np.ndarray, bits: int, most: int):
        self.packed = Packed(x, bits)
        n = len(x)
        places = np.flatnonzero(x > 0)
        places = places[np.argsort(self.packed.key[places])]
        # known tokens from each place on
        zeros = np.append(np.flatnonzero(x == 0), n)
        known = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n)
        rank = np.zeros(n + 1, np.int64)  # place of a group of alike suffixes in the array, from 1 on
        key = self.packed.key[places]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        depth = self.packed.per
        rank[places] = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0)) + 1
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        while depth < most and len(tied):
            # of a group either all reach an unknown token before that or none
            tied = tied[known[places[tied]] >= depth]
            t = places[tied]
            pair = rank[t] * (n + 1) + rank[np.minimum(t + depth, n)]
            order = np.argsort(pair)
            places[tied] = t = t[order]
            pair = pair[order]
            first = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.zeros(0, bool)
            rank[t] = np.maximum.accumulate(np.where(first, tied, 0)) + 1
            tied = tied[~(first & np.append(first[1:], True))]
            depth *= 2
        self.places = places
        self.key = self.packed.key[places]

    def bound(self, test: Packed, q: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
        """Where in the array the suffixes begin (or, ``right``, end) that agree with ``depth`` tokens of ``test`` from ``q`` on."""
        bits, per = self.packed.bits, self.packed.per

        def unlike(part: int) -> np.ndarray:
            """Bits of the ``part``-th number that are beyond the depth."""
            return (per - np.clip(depth - part * per, 0, per)) * bits

        def held(number: np.ndarray, off: np.ndarray) -> np.ndarray:
            return np.where(off < per * bits, number >> np.minimum(off, 63).astype(np.uint64), np.uint64(0))

        # the first number narrows the range for all tests at once
        off = np.minimum(unlike(0), 63).astype(np.uint64)
        head = test.of(q, 0) >> off << off
        lo, hi = np.searchsorted(self.key, head, "left"), np.searchsorted(self.key, head | ((np.uint64(1) << off) - np.uint64(1)), "right")
        parts = -(-int(depth.max(initial=0)) // per)
        while parts > 1 and (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            sign = np.zeros(len(open_), np.int8)
            p, t = self.places[mid], q[open_]
            for part in range(1, parts):
                same = np.flatnonzero(sign == 0)
                if not len(same):
                    break
                off = unlike(part)[open_[same]]
                a, b = held(self.packed.of(p[same], part), off), held(test.of(t[same], part), off)
                sign[same] = (a > b).astype(np.int8) - (a < b)
            below = (sign < 0) | ((sign == 0) & right)
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return hi if right and parts <= 1 else lo


def _agree(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, start: int = 0) -> np.ndarray:
    """Known tokens for which the streams agree from places ``p`` of ``a`` and ``q`` of ``b`` on."""
    out = np.full(len(p), start, np.int64)
    on = np.arange(len(p))
    while len(on):
        i, j = p[on] + out[on], q[on] + out[on]
        ok = (i < len(a)) & (j < len(b))
        ok &= a[np.minimum(i, len(a) - 1)] == b[np.minimum(j, len(b) - 1)]
        ok &= b[np.minimum(j, len(b) - 1)] > 0
        on = on[ok]
        out[on] += 1
    return out


class Matcher:
    """Finds the places of ``items`` in shards of documents."""

    def __init__(self, items: Items):
        self.items = items
        stream = items.stream
        self.bits = max(1, int(stream.max(initial=0)).bit_length())
        self.test = Packed(stream, self.bits)
        self.owner = np.searchsorted(items.at, np.arange(len(stream)), "right") - 1
        self.depth = int(max(np.diff(items.at), default=1))
        zeros = np.flatnonzero(np.append(stream, 0) == 0)
        self.left = zeros[np.searchsorted(zeros, np.arange(len(stream)))] - np.arange(len(stream))
        # test suffixes in their own order, so that neighbouring searches touch neighbouring places
        order = np.argsort(self.test.key)
        self.suffixes = order[self.left[order] > 0]
        self.seed = np.append(items.seeds, 1)[np.minimum(self.owner, len(items.seeds))]

    def array(self, x: np.ndarray) -> SuffixArray:
        return SuffixArray(x, self.bits, self.depth)

    def matches(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the items' stream, place in ``x``, tokens) of all maximal verbatim matches of an item's seed or more."""
        array = self.array(x)
        q = self.suffixes[self.left[self.suffixes] >= self.seed[self.suffixes]]
        depth = self.seed[q]
        lo, hi = array.bound(self.test, q, depth, False), array.bound(self.test, q, depth, True)
        some = hi > lo
        q, lo, n = q[some], lo[some], (hi - lo)[some]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place, found = np.repeat(q, n), array.places[at]
        # those that could begin one token earlier are inside a longer match
        before = np.where(found > 0, x[np.maximum(found - 1, 0)], 0)
        longest = (self.items.stream[place - 1] == 0) | (before != self.items.stream[place - 1])
        place, found = place[longest], found[longest]
        return place, found, _agree(x, found, self.items.stream, place)

    def longest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix its place, the place in ``x`` of its longest verbatim match, and its tokens: the better one
        of its two neighbours in the array."""
        array = self.array(x)
        q = self.suffixes
        if not len(array.places):
            return q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        i = array.bound(self.test, q, self.left[q], False)
        best, length = np.zeros(len(q), np.int64), np.full(len(q), -1)
        for at in (i, i - 1):
            p = array.places[np.clip(at, 0, len(array.places) - 1)]
            n = _agree(x, p, self.items.stream, q)
            better = n > length
            best, length = np.where(better, p, best), np.where(better, n, length)
        return q, best, length


def _straight(item: np.ndarray, weight: np.ndarray, doc: np.ndarray, d: int) -> tuple[float, int, int]:
    """As :func:`_chain`, where exchanged words take the place of one each: on the one diagonal ``d``."""
    lo, hi = max(0, -d), min(len(item), len(doc) - d)
    if hi <= lo:
        return 0.0, 0, 0
    eq = item[lo:hi] == doc[lo + d : hi + d]
    w = weight[lo:hi]
    gain = np.concatenate([[0.0], np.cumsum(w * (eq - (1 - EXCHANGED)))])
    reach = np.concatenate([[0.0], np.cumsum(w)])
    # a passage opens and closes with words of the item
    least = np.minimum.accumulate(np.where(np.append(eq, False), gain, np.inf)).tolist()
    most = np.maximum.accumulate(np.where(np.append(False, eq), gain, -np.inf)[::-1])[::-1].tolist()
    best, i, j, n = (0.0, 0, 0), 0, 0, hi - lo
    total = weight.sum()
    while i <= n and j <= n:
        if least[i] <= most[j] + 1e-9:
            if j > i and (part := (reach[j] - reach[i]) / total) > best[0]:
                best = (float(part), lo + i + d, lo + j + d)
            j += 1
        else:
            i += 1
    return best


def _chain(item: np.ndarray, weight: np.ndarray, doc: np.ndarray, diagonals: set[int]) -> tuple[float, int, int]:
    """The largest part of ``item`` that a passage of ``doc`` spans in order, and where in ``doc`` it begins and ends.

    ``diagonals``: places in the document less places in the item where runs agree.
    """
    n = len(item)
    runs = []
    for d in {x + s for x in diagonals for s in range(-SHIFT, SHIFT + 1)}:
        lo, hi = max(0, -d), min(n, len(doc) - d)
        if hi <= lo:
            continue
        eq = np.zeros(hi - lo + 2, np.int8)
        eq[1:-1] = item[lo:hi] == doc[lo + d : hi + d]
        turn = np.diff(eq)
        least = 1 if d in diagonals else 3
        runs += [(lo + a, lo + b, d) for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()) if b - a >= least]
    if not runs:
        return 0.0, 0, 0
    runs.sort()
    reach = np.concatenate([[0.0], np.cumsum(weight)])
    total = reach[-1]
    best = (0.0, 0, 0)
    # for each run as the first: follow the chain, counting what is exchanged
    for i, (a, b, d) in enumerate(runs):
        if (reach[-1] - reach[a]) / total <= best[0]:
            break
        end, diagonal, lost = b, d, 0.0
        if (part := (reach[end] - reach[a]) / total) > best[0]:
            best = (part, a + d, end + d)
        for a2, b2, d2 in runs[i + 1 :]:
            if d2 != diagonal:
                if abs(d2 - diagonal) > SHIFT or b2 <= end:
                    continue
                start = max(a2, end, end + diagonal - d2)  # neither item nor document goes back
                if start >= b2:
                    continue
                # a run on the same diagonal may still follow; another one must carry on at least as far
                if any(x[2] == diagonal and x[0] >= end and x[0] <= start and x[1] >= b2 for x in runs[i + 1 :]):
                    continue
                gap = max(reach[start] - reach[end], float(start + d2 - end - diagonal))
            else:
                if a2 < end:
                    continue
                start, gap = a2, reach[a2] - reach[end]
            span = reach[b2] - reach[a]
            if lost + gap > EXCHANGED * span + 1e-9:
                if lost + gap > EXCHANGED * (reach[-1] - reach[a]) + 1e-9:
                    break
                lost += gap
                end, diagonal = b2, d2
                continue
            lost += gap
            end, diagonal = b2, d2
            if span / total > best[0]:
                best = (span / total, a + d, end + d2)
    return best


def _possible(item: np.ndarray, weight: np.ndarray, doc: np.ndarray, diagonals: set[int]) -> bool:
    """Whether some stretch of PART of the item or more has, up to EXCHANGED, tokens that the document has near the
    diagonals: every chain of :func:`_chain` that is long enough is such a stretch, so nothing is lost."""
    n = len(item)
    near = np.zeros(n, bool)
    for d in diagonals:
        lo, hi = d - SHIFT, d + n + SHIFT
        part = doc[max(0, lo) : max(0, hi)]
        part = np.pad(part, (max(0, -lo), max(0, n + 2 * SHIFT - len(part) - max(0, -lo))))
        near |= (np.lib.stride_tricks.sliding_window_view(part, 2 * SHIFT + 1)[:n] == item[:, None]).any(1)
    reach = np.concatenate([[0.0], np.cumsum(weight)])
    gain = np.concatenate([[0.0], np.cumsum(weight * (near - (1 - EXCHANGED)))])
    least = np.minimum.accumulate(gain)
    first = np.searchsorted(reach, reach - PART * reach[-1] + 1e-9, "right") - 1
    there = first >= 0
    return bool(there.any()) and bool((gain[there] - least[first[there]] >= -1e-9).any())


def _enough(items: Items, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, at_once: int = 20_000) -> np.ndarray:
    """Which (item, document, diagonals from ``low`` to ``high``) have as many tokens of the item near the diagonals as a
    passage needs; wide bands of diagonals are left to :func:`_possible`."""
    out = high - low > 4 * SHIFT
    n = np.diff(items.at) - 1
    totals = np.array([w.sum() for w in items.weights])
    weight_of = np.zeros(len(items.stream))
    for k, w in enumerate(items.weights):
        weight_of[items.at[k] : items.at[k] + len(w)] = w
    narrow = np.flatnonzero(~out)
    for lo in range(0, len(narrow), at_once):
        c = narrow[lo : lo + at_once]
        size = n[item[c]]
        each = np.repeat(np.arange(len(c)), size)
        step = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        token = items.at[item[c]][each] + step
        want = items.stream[token]
        base = (starts[doc[c]] + low[c])[each] + step
        first, last, width = starts[doc[c]][each], ends[doc[c]][each], (high[c] - low[c])[each]
        near = np.zeros(len(each), bool)
        for s in range(-SHIFT, int((high[c] - low[c]).max(initial=0)) + SHIFT + 1):
            p = base + s
            ok = (p >= first) & (p < last) & (s <= width + SHIFT)
            near[ok] |= x[p[ok]] == want[ok]
        got = np.bincount(each, weight_of[token] * near, len(c))
        out[c] = got >= (1 - EXCHANGED) * PART * totals[item[c]] - 1e-9
    return out


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents one behind the other with 0 before each, and where each begins and ends."""
    x = np.concatenate([np.concatenate([[0], d]) for d in docs])
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1] + 1
    return x, starts, starts + np.array([len(d) for d in docs])


def _shard(m: Matcher, ids: list[int], docs: list[np.ndarray]) -> pa.RecordBatch | None:
    x, starts, ends_of = _joined(docs)
    place, p, length = m.matches(x)
    rows = []
    if len(place):
        doc, item = np.searchsorted(starts, p, "right") - 1, m.owner[place]
        diagonal = (p - starts[doc]) - (place - m.items.at[item])
        order = np.lexsort((diagonal, item, doc))
        place, length, doc, item, diagonal = place[order], length[order], doc[order], item[order], diagonal[order]
        # a passage lies on neighbouring diagonals
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) > 2 * SHIFT))
        group = np.cumsum(new) - 1
        order = np.lexsort((place, group))
        place, length, doc, item, diagonal, group = place[order], length[order], doc[order], item[order], diagonal[order], group[order]
        # tokens of the item in matches: too few of them, and no passage is long enough
        wide = len(m.items.stream) + 1
        end = np.maximum.accumulate(group * wide + place + length)
        begin = np.maximum(group * wide + place, np.append(0, end[:-1]))
        cuts = np.append(np.flatnonzero(np.diff(group)), len(group) - 1)
        heads = np.append(0, cuts[:-1] + 1)
        enough = np.add.reduceat(np.maximum(end - begin, 0), heads) >= m.items.covered[item[heads]]
        low, high = np.minimum.reduceat(diagonal, heads)[enough], np.maximum.reduceat(diagonal, heads)[enough]
        verbatim = np.maximum.reduceat(length, heads)[enough]
        heads, ends = heads[enough], (cuts + 1)[enough]
        some = _enough(m.items, x, starts, ends_of, item[heads], doc[heads], low, high)
        for lo, hi, run in zip(heads[some].tolist(), ends[some].tolist(), verbatim[some].tolist()):
            k, n = int(item[lo]), int(doc[lo])
            tokens, weight = m.items.stream[m.items.at[k] : m.items.at[k + 1] - 1], m.items.weights[k]
            diagonals = set(diagonal[lo:hi].tolist())
            part, a, b = max(_straight(tokens, weight, docs[n], d) for d in diagonals)
            if part < PART - 1e-9 and _possible(tokens, weight, docs[n], diagonals):
                part, a, b = _chain(tokens, weight, docs[n], diagonals)
            if part >= PART - 1e-9:
                rows.append((m.items.ids[k], ids[n], part, a, b, run))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["item_id", "doc_id", "part", "from_token", "to_token", "verbatim"])


def _longest(m: Matcher, ids: list[int], docs: list[np.ndarray]) -> pa.RecordBatch | None:
    """For each item the longest match of any of its suffixes in the shard."""
    x, starts, _ = _joined(docs)
    place, p, length = m.longest(x)
    item = m.owner[place]
    doc = np.searchsorted(starts, p, "right") - 1
    order = np.lexsort((place, -length, item))
    order = order[np.append(True, np.diff(item[order]) != 0)] if len(order) else order
    order = order[length[order] > 0]
    if not len(order):
        return None
    item, place, doc, p = item[order], place[order], doc[order], p[order]
    cols = [np.array(m.items.ids)[item], np.array(ids)[doc], place - m.items.at[item], p - starts[doc], length[order]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "item_token", "doc_token", "n_tokens"])


#: The matcher of the block of items that this process searched last: the tasks of a worker share it.
_MATCHER: dict[str, Matcher] = {}


def _matcher(name: str, items: Items) -> Matcher:
    if name not in _MATCHER:
        _MATCHER.clear()
        _MATCHER[name] = Matcher(items)
    return _MATCHER[name]


def _search(batches: Iterator[pa.RecordBatch], m: Matcher, find: Callable[[Matcher, list[int], list[np.ndarray]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    docs: list[np.ndarray] = []
    size = 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            tokens = tokens_of(text)
            ids.append(doc_id)
            docs.append(np.fromiter(map(m.items.vocabulary.get, tokens, repeat(0)), np.int64, len(tokens)))
            size += len(tokens)
            if size >= SHARD_TOKENS:
                if (found := find(m, ids, docs)) is not None:
                    yield found
                ids, docs, size = [], [], 0
    if ids and (found := find(m, ids, docs)) is not None:
        yield found


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([tokens_of(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["item_id", "tokens"])


def _over_blocks(documents: DataFrame, items: DataFrame, find: Callable, schema: str) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct().mapInArrow(_tokenised, "item_id bigint, tokens array<string>")
    out: list[DataFrame] = []

    def search(block: list[tuple[int, list[str]]]) -> None:
        shared, name = spark.sparkContext.broadcast(Items.of(block)), uuid.uuid4().hex
        out.append(docs.mapInArrow(lambda batches: _search(batches, _matcher(name, shared.value), find), schema))

    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in rows.where(F.size("tokens") > 0).orderBy("item_id", "tokens").toLocalIterator():
        block.append((r.item_id, r.tokens))
        size += len(r.tokens)
        if size >= BLOCK_TOKENS:
            search(block)
            block, size = [], 0
    if block:
        search(block)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id, part, from_token, to_token, verbatim``: documents one passage of which gives PART or more of an
    item, and the tokens of the longest verbatim match in it.

    The passage follows the item's order; case, punctuation, spacing, line breaks and character forms don't matter, and up
    to EXCHANGED of it may be other words. Null and blank texts match nothing; repeated rows count once; texts are taken
    whole, of any length. Items are taken in blocks of BLOCK_TOKENS, the documents being read once for each.
    """
    x = _over_blocks(documents, items, _shard, "item_id bigint, doc_id bigint, part double, from_token bigint, to_token bigint, verbatim bigint")
    cols = ["part", "from_token", "to_token", "verbatim"]
    x = x.groupBy("item_id", "doc_id").agg(F.max(F.struct(*cols)).alias("x"))
    return x.select("item_id", "doc_id", *[f"x.{c}" for c in cols])


def longest_matches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, n_tokens, doc_id, item_token, doc_token``: the longest verbatim match of each item in any document, with
    its first place (by document, then item). Items no token of which is in any document have none."""
    x = _over_blocks(documents, items, _longest, "item_id bigint, doc_id bigint, item_token bigint, doc_token bigint, n_tokens bigint")
    x = x.groupBy("item_id").agg(F.min(F.struct((-F.col("n_tokens")).alias("n"), "doc_id", "item_token", "doc_token")).alias("x"))
    return x.select("item_id", (-F.col("x.n")).alias("n_tokens"), "x.doc_id", "x.item_token", "x.doc_token")


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents`` less those that hold a passage of an item; documents with null id stay."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
