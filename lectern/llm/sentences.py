"""Sentence units in many languages and scripts by a hidden-event language model (3).

Between any two tokens of a line stands a hidden event: a boundary or none. A bigram model over tokens and boundary tokens
gives the chance of each way to fill them: with a boundary the token before it must end a sentence and the token behind it
begin one, and what follows is then in the context of a beginning; without one the token behind follows the one before.
Forward-backward over all events of a line gives their posteriors. Starts and ends of lines are boundaries that the text
itself shows, so they are the training data, in all languages alike.

What a mark says is part of the model too: how often this word with this mark ends a line against how often it goes on,
and how rare a boundary without any mark is. In text that has marks, a unit ends at a boundary that has one (or, in Thai,
a polite particle); with ``unmarked`` any likely boundary ends it, as in recogniser output or scripts without end marks.

Counts of all texts go into tables of a fixed number of hashed buckets, so the model's size doesn't grow with the data.
All events of a batch of texts are computed at once.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import _class, _tables, canonical

#: Buckets of each count table, a power of two; the model is TABLES times as many 32-bit numbers.
BUCKETS = 1 << 20
#: Bucket numbers that a task holds before it adds them up.
HELD = 2_000_000
#: What is counted: a word and mark that end a line, or don't; a token that begins a line, is inside one, with the token
#: behind it, also by pairs; a token whose word ends a line whatever the mark, one that another token follows without any,
#: one that is a line by itself; and, in its first buckets, lines by the script of their first token.
END, MID, START, INNER, START2, INNER2, LAST, LEFT, ONE, BY_SCRIPT, TABLES = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10
#: Sums beside those of the tables: lines, and those that end with a mark.
LINES, MARKED = 0, 1
THRESHOLD = 0.5
#: The guess that a word and mark unseen so far end a sentence, and its weight in inner places for marks that don't abbreviate.
PRIOR = 0.7
UNCOMMON = 6
#: A word that ends lines this often, against other words, always ends its sentence with that mark.
ENOUGH = 0.4
#: Least chance of either event, and the most that the next words count, as a logarithm of odds.
FLOOR, BOUND = 0.003, 4.5
#: How often a token counts as seen that never was: as following another, and as ending a line.
UNSEEN, UNENDED = 5.0, 0.5

# Marks that may end a sentence, what may close behind them, quotation and bracket pairs, and the polite
# particles that end Thai sentences.
MARKS = ".!?…。！？｡।॥"
CLOSERS = "\"'”’»」』）)]"
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’"}
PARTICLES = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ๊ะ", "ฮะ")

OPENERS = "\"'“„«「『（([‘"
_MARKS_AND_CLOSERS = frozenset(MARKS + CLOSERS)

CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
THAI = "฀-๿"
_LINE = re.compile("[\r\n\v\f\x1c-\x1e\x85  ]+")
_CJK = re.compile(f"[{CJK}]")
_THAI = re.compile(f"[{THAI}]")
_TAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*$")
_ANY = re.compile(f"[{MARKS}{THAI}]")
_WIDE = "。！？｡"
# without any of these in a line, only marks with a space behind them can be events
_SPECIAL = re.compile(f"[{_WIDE}…{THAI}]")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_OPENED = re.compile(f"[{re.escape(''.join(PAIRS) + ''.join(PAIRS.values()))}\"]")


@cache
def _patterns() -> dict[str, re.Pattern]:
    gap = rf"[\s{_class(_tables()['invisible'])}]"
    word = rf"[^\W\d_{CJK}{THAI}]+(?:[’'.-][^\W\d_{CJK}{THAI}]+)*"
    # invisible characters may stand inside a particle
    unseen = f"[{_class(_tables()['invisible'])}]*"
    particle = "|".join(unseen.join(p) for p in PARTICLES)
    # “ closes where „ opens, and opens elsewhere
    close = {"": re.escape(CLOSERS), "„": re.escape(CLOSERS + "“")}
    event = r"(?P<p>{0})(?P<pc>[{1}]*)(?P<pw>{2}+)(?=\S)|(?P<m>[{3}]+)(?P<c>[{1}]*)(?P<w>{2}*)(?=\S)"
    # the same where there are no particles, and where a space must follow too; both open with a set of characters, which
    # the search skips to, and the latter takes whole runs of marks, as a space is behind those alone
    wide = r"(?P<m>[{3}][{3}]*)(?P<c>[{1}]*)(?P<w>{2}*)(?=\S)"
    spaced = r"(?P<m>[{3}](?<![{3}][{3}])[{3}]*+)(?P<c>[{1}]*+)(?P<w>{2}+)(?=\S)"
    end = r"(?:(?P<p>{0})|(?P<m>[{3}]+))(?P<c>[{1}]*){2}*$"
    return {
        **{kind + k: re.compile(x.format(particle, c, gap, MARKS)) for kind, x in (("event", event), ("wide", wide), ("spaced", spaced)) for k, c in close.items()},
        **{"end" + k: re.compile(end.format(particle, c, gap, MARKS)) for k, c in close.items()},
        "token": re.compile(rf"[{CJK}]|[{THAI}]{{1,3}}|[ऀ-ॣ०-ॿ]+|\d+(?:[.,:]\d+)*|{word}|[^\w\s]|\S"),
        "gap": re.compile(rf"{gap}*"),
    }


@cache
def _endings() -> frozenset[str]:
    """Characters other than marks and spaces that the end of a line with a mark or particle may have last."""
    return frozenset(CLOSERS + "“" + _tables()["invisible"]) | {p[-1] for p in PARTICLES}


def _hash(*key: str) -> int:
    return zlib.crc32("\x1f".join(key).encode("utf-8", "surrogatepass"))


def _bucket(*key: str) -> int:
    return _hash(*key) & (BUCKETS - 1)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buckets of pairs of tokens, out of their hashes."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int64)


class _Hashes(dict):
    """Hashes of tokens in their plain form, remembered for a bounded number of them. In the lowest two bits is the kind (a
    mark or closer, other punctuation, or a token that may begin a sentence), in the next three the script."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = _plain(token)
        kind = 0 if plain[:1] in _MARKS_AND_CLOSERS else 1 if not plain[:1].isalnum() and plain[:1] not in OPENERS and not plain.startswith("<") else 2
        c = plain[:1]
        script = 0 if c < "\u0370" else 1 if c < "\u0530" else 2 if c < "\u0e00" else 3 if c < "\u0e80" else 4 if c < "\u3040" else 5 if c < "\u3100" else 6
        h = self[token] = _hash(plain) << 5 | script << 2 | kind
        return h


_HASHES = _Hashes()


class _Chunks(dict):
    """Hashes of the tokens of what stands between spaces, remembered for a bounded number of short ones: no token spans a
    space, and in scripts with spaces few chunks are new."""

    def __missing__(self, chunk: str) -> list[int]:
        out = [_HASHES[t] for t in _patterns()["token"].findall(chunk)]
        if len(chunk) <= 24:
            if len(self) > 100_000:
                self.clear()
            self[chunk] = out
        return out


_CHUNKS = _Chunks()


def _plain(token: str) -> str:
    token = (token if token.isascii() else canonical(token)).lower()
    if token[:1].isdigit():
        if token.isdigit():
            return "<int>"
        if _NUMBER.fullmatch(token):
            return "<dec>"
    return token


def _mark(mark: str, closed: bool, spaced: bool) -> str:
    kind = "!" if any(c in "!?！？" for c in mark) else "…" if "…" in mark or len(mark) > 1 and mark[-1] == "." else "。" if mark[-1] in "。｡" else "।" if mark[-1] in "।॥" else "."
    return kind + "”" * closed + " " * spaced


@dataclass(slots=True)
class Event:
    """A marked place where a sentence may end: the next would begin at ``begin``; ``left`` and ``mark`` before it."""

    at: int
    begin: int
    left: str
    mark: str
    inside: bool
    #: the left token directly follows the event before this one, so what it is depends on that event
    joined: bool = False
    alone: bool = False


def _left(line: str, end: int) -> tuple[str, bool, int]:
    """The token before ``end``, whether a space parts them, and where the token begins."""
    # what is near shows most tokens whole; where it doesn't, all of the line before
    for near in (max(0, end - 64), 0):
        head = line[near:end].rstrip()
        token = head.rsplit(None, 1)[-1] if head else ""
        if not near or len(token) < len(head):
            break
    stop = near + len(head)
    if not token.isascii() and _CJK.search(token):
        tail = _TAIL.search(token) if token[-1].isascii() else None
        token = tail[0] if tail else token[-2:]
        return _plain(token), stop < end, stop - len(token)
    bare = token.lstrip("\"'“„«「『（([‘")
    return _plain(bare), stop < end, stop - len(bare)


def _quoted(line: str) -> list[tuple[int, int]]:
    """(open, close) of quotations and brackets that do close."""
    if not _OPENED.search(line):
        return []
    out, stack = [], []
    for m in _OPENED.finditer(line):
        c = m[0]
        if stack and c == stack[-1][1]:
            out.append((stack.pop()[0], m.start()))
        elif c == '"':
            stack.append((m.start(), '"'))
        elif c in PAIRS:
            # an apostrophe-like mark inside a word opens nothing
            if not (c == "‘" and m.start() and line[m.start() - 1].isalnum()):
                stack.append((m.start(), PAIRS[c]))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == c:
                    out.append((stack[k][0], m.start()))
                    del stack[k:]
                    break
    return out


def _first_of_line(line: str, begin: int) -> bool:
    return not line[:begin].strip()


def events(line: str) -> list[Event]:
    """The marked places of a line, in order."""
    out: list[Event] = []
    kind = "spaced" if line.isascii() or not _SPECIAL.search(line) else "event" if _THAI.search(line) else "wide"
    quoted: list[tuple[int, int]] | None = None
    for m in _patterns()[kind + "„" if "„" in line else kind].finditer(line):
        if kind == "event" and m["p"]:
            begin, left, mark, start = m.end(), canonical(m["p"]), "P" + "”" * bool(m["pc"]), m.start()
            closed_at, alone = m.end("pc"), False
        else:
            wide = m["m"][-1] in _WIDE or (m["m"][-1] == "…" and (_CJK.match(line, m.start() - 1) or _CJK.match(line, m.end())))
            if not m["w"] and not wide:
                continue
            left, spaced, start = _left(line, m.start())
            mark, begin, closed_at = _mark(m["m"], bool(m["c"]), spaced), m.end(), m.end("c")
            alone = left == "<int>" or len(left) == 1
            if alone and _first_of_line(line, start):
                left += "^"
        if _first_of_line(line, m.start()):
            continue  # marks that open a line end nothing
        if quoted is None:
            quoted = _quoted(line)
        inside = any(a < m.start() and b >= closed_at for a, b in quoted)
        joined = bool(out) and alone and start == out[-1].begin
        out.append(Event(m.start(), begin, left, mark, inside, joined, alone))
    return out


def lines(text: str) -> list[tuple[int, str]]:
    """(offset, line) of the lines that aren't blank."""
    out, at = [], 0
    whole = text.splitlines()  # at the same characters
    if whole and len(whole[0]) == len(text):
        return [(0, text)] if text.strip() else []
    for m in _LINE.finditer(text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    out.append((at, text[at:]))
    return [(a, x) for a, x in out if x.strip()]


def _typical(left: str) -> bool:
    """A token that is hardly an abbreviation: five letters or more, or of a script without cases."""
    return left.isalpha() and (len(left) >= 5 or left.upper() == left.lower())


def _ended(line: str) -> tuple[str, str] | None:
    """The word and mark that a line ends with, if it has one."""
    last, low = line[-1], max(0, len(line) - 40)
    if last in MARKS:
        start, closed = max(low, len(line.rstrip(MARKS))), False
        mark = line[start:]
        if not start:
            return None
    elif last not in _endings() and not last.isspace() or not _ANY.search(line, low):
        return None
    else:
        m = _patterns()["end„" if "„" in line else "end"].search(line, low)
        if not m or not m.start():
            return None
        if m["p"]:
            return canonical(m["p"]), "P" + "”" * bool(m["c"])
        start, mark, closed = m.start(), m["m"], bool(m["c"])
    left, spaced, begin = _left(line, start)
    if (left == "<int>" or len(left) == 1) and _first_of_line(line, begin):
        left += "^"
    return left, _mark(mark, closed, spaced)


def _tokens(line: str) -> tuple[list[int], list[int]]:
    """Where the tokens of a line begin, and their hashes."""
    found = [(m.start(), m[0]) for m in _patterns()["token"].finditer(_low(line))]
    return [a for a, _ in found], [_HASHES[t] for _, t in found]


def _low(line: str) -> str:
    low = line.lower()
    return low if len(low) == len(line) else line


def _hashes(low: str) -> list[int]:
    """Hashes of the tokens of a line in lower case."""
    return list(chain.from_iterable(map(_CHUNKS.__getitem__, low.split())))


def _stretches(line: str, es: list[Event]) -> tuple[list[int], list[int]]:
    """For each token of a line the place of the event before it, and the tokens' hashes: as :func:`_tokens`, so far as
    events need it."""
    if any(not line[e.begin - 1].isspace() and line[e.begin - 1] not in _MARKS_AND_CLOSERS for e in es):
        return _tokens(line)  # behind invisible characters a token may go on past the event
    low = _low(line)
    begins: list[int] = []
    hashes: list[int] = []
    cuts = [0, *(e.begin for e in es), len(low)]
    for a, b in pairwise(cuts):
        hashes += _hashes(low[a:b])
        begins += [a] * (len(hashes) - len(begins))
    return begins, hashes


class Counts:
    """Counts of a task: bucket numbers are held by table, and added up when there are many."""

    def __init__(self) -> None:
        self.total = np.zeros((TABLES, BUCKETS))
        self.lines = np.zeros(2)
        self.held: list[list[np.ndarray]] = [[] for _ in range(TABLES)]
        self.size = 0
        self.marked = [Counter(), Counter()]

    def add(self, texts: list[str]) -> None:
        """What the known starts, ends and inner places of texts show."""
        hashes: list[int] = []
        ends: list[int] = []
        ended, going_on = self.marked
        n_marked = 0
        for text in texts:
            for _, line in lines(text):
                m = _ended(line)
                if m:
                    n_marked += 1
                    ended[m] += 1
                for e in events(line):
                    if not e.inside:
                        going_on[e.left, e.mark] += 1
                hashes += _hashes(_low(canonical(line)))
                ends.append(len(hashes))
        self.lines += (len(ends), n_marked)
        self._tokens(np.array(hashes, np.int64), np.array(ends, np.int64))
        if self.size + len(ended) + len(going_on) > HELD:
            self.put(HELD // (TABLES + len(self.marked)))

    def _tokens(self, h: np.ndarray, ends: np.ndarray) -> None:
        if not len(h):
            return
        kind, script, h = h & 3, h >> 2 & 7, h >> 5
        starts = np.append(0, ends[:-1])
        some = ends > starts
        starts, ends = starts[some], ends[some]
        first = np.zeros(len(h), bool)
        first[starts] = True
        word = kind == 2
        second = starts[ends - starts > 1]
        # inner pairs: neither first in a line nor behind a mark
        b = np.flatnonzero(~first & np.append(False, kind[:-1] > 0))
        self._hold(START, h[starts] & (BUCKETS - 1))
        self._hold(BY_SCRIPT, script[starts])
        self._hold(START2, _pairs(h[second], h[second + 1]))
        self._hold(INNER, h[b] & (BUCKETS - 1))
        self._hold(INNER2, _pairs(h[b - 1], h[b]))
        words = b[word[b] & word[b - 1]]
        self._hold(LEFT, h[words - 1] & (BUCKETS - 1))
        # the last word of each line, whatever mark is behind it
        at = np.maximum.accumulate(np.where(word, np.arange(len(h)), -1))[ends - 1]
        has = at >= starts
        self._hold(LAST, h[at[has]] & (BUCKETS - 1))
        self._hold(ONE, h[at[has & (np.add.reduceat(word, starts) == 1)]] & (BUCKETS - 1))

    def _hold(self, table: int, buckets: np.ndarray) -> None:
        self.held[table].append(buckets)
        self.size += len(buckets)

    def put(self, least: int = 0) -> None:
        """Adds up what is held of tables of which more than ``least`` is."""
        for k, held in enumerate(self.held):
            n = sum(map(len, held))
            if n > least:
                self.total[k] += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held.clear()
                self.size -= n
        for k, table in enumerate(self.marked):
            if len(table) <= least // 4:  # words take more room than numbers
                continue
            for (left, mark), n in table.items():
                self.total[k, _bucket(left, mark)] += n
                if mark[0] != "." or _typical(left):
                    self.total[k, _bucket("", mark)] += n
            table.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = Counts()
    for b in batches:
        c.add([x for x in b.column(0).to_pylist() if x])
    c.put()
    for k in range(TABLES):
        at = np.flatnonzero(c.total[k])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c.total[k, at])], names=["table", "bucket", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(np.full(2, TABLES), pa.int32()), pa.array([LINES, MARKED], pa.int32()), pa.array(c.lines)], names=["table", "bucket", "n"])


@dataclass
class Gaps:
    """The events of some lines, one behind the other: for each the hashes around it, whether a boundary may be there, and
    for marked ones the odds of the word and mark, after no boundary and after one."""

    #: where each line's events begin
    at: list[int]
    left: np.ndarray
    right: np.ndarray
    script: np.ndarray
    open: np.ndarray
    marked: np.ndarray
    odds: np.ndarray
    joined: np.ndarray


def forward_backward(at: np.ndarray, there: np.ndarray, again: np.ndarray, on: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """Posteriors of boundaries, given for each event the weight of a boundary after none (``there``) and after a boundary
    (``again``), and of none after a boundary (``on``), none after none weighing 1. Lines begin at ``at`` and advance
    together, those of about one length at a time; before a line there is no boundary."""
    sizes = np.diff(np.append(at, len(there)))
    out = np.zeros(len(there))
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        longest = int(sizes[order[-1]])
        rows, order = order[-max(1, min(4096, cells // longest)) :], order[: -max(1, min(4096, cells // longest))]
        # from the longest down, so that the lines still going on are the first ones
        rows = rows[::-1]
        size = sizes[rows]
        going = np.searchsorted(-size, -np.arange(longest), "left")
        forward = np.zeros((longest, len(rows)))
        f = np.zeros(len(rows))  # chance of a boundary so far
        for t in range(longest):
            n = going[t]
            i = at[rows[:n]] + t
            none, some = 1 - f[:n] + f[:n] * on[i], (1 - f[:n]) * there[i] + f[:n] * again[i]
            f[:n] = forward[t, :n] = some / (none + some)
        back = np.ones(len(rows)) / 2  # weight of what follows after a boundary, against that after either
        for t in range(longest - 1, -1, -1):
            n = going[t]
            if t + 1 < longest:
                k = going[t + 1]
                i = at[rows[:k]] + t + 1
                b = back[:k]
                none, some = (1 - b) + b * there[i], (1 - b) * on[i] + b * again[i]
                back[:k] = some / (none + some)
            p = forward[t, :n] * back[:n]
            out[at[rows[:n]] + t] = p / (p + (1 - forward[t, :n]) * (1 - back[:n]))
    return out


@dataclass
class Model:
    """Counts by table and bucket, the sum of each table, and how many lines there were and ended with a mark."""

    n: np.ndarray
    total: np.ndarray
    lines: np.ndarray

    def __post_init__(self) -> None:
        self._known: dict[tuple[str, str], float] = {}

    def of(self, table: int, *key: str) -> float:
        return float(self.n[table, _bucket(*key)])

    def log_odds(self, left: str, mark: str) -> float:
        """Of a boundary against none, given the word and mark before it; the event itself is taken out of the counts."""
        # ends of lines for each inner place of words that are no abbreviations: there, all inner places are boundaries
        usual = (self.of(END, "", mark) + 0.5) / (self.of(MID, "", mark) + 0.5)
        ends, mids = self.of(END, left, mark), max(self.of(MID, left, mark) - 1, 0.0)
        weight = 1 if mark[0] == "." or len(mark) > 1 else UNCOMMON
        share = (ends + PRIOR * weight * usual) / (mids + weight) / usual
        b = min(max(share / ENOUGH, FLOOR), 1 - FLOOR)
        return math.log(b / (1 - b))

    def odds(self, left: str, mark: str) -> float:
        x = self._known.get((left, mark))
        if x is None:
            if len(self._known) > 200_000:
                self._known.clear()
            x = self._known[left, mark] = self.log_odds(left, mark)
        return x

    def gaps(self, parsed: list[tuple[list[int], list[int], list[Event]]], spaces: list[set[int]] | None = None) -> Gaps:
        """The events of lines, out of their tokens and marked places. ``spaces``: for each line, tokens that a script
        without spaces between words has behind a space; others of that script begin no sentence."""
        at, hashes, marks = [], [], []
        n = 0
        lost = []
        for begins, own, es in parsed:
            at.append(n)
            hashes += own
            for e in es:
                k = bisect_left(begins, e.begin) - 1
                if 0 <= k < len(own) - 1:
                    marks.append((n + k, -np.inf if e.inside else self.odds(e.left, e.mark), -np.inf if e.inside else self.odds(e.left + "^", e.mark) if e.joined else np.nan))
            n += len(own)
            if own:
                lost.append(n - 1)
        h = np.array(hashes, np.int64)
        kind, script, h = h & 3, h >> 2 & 7, h >> 5
        g = Gaps(at, h, np.append(h[1:], 0), np.append(script[1:], 0), np.append(kind[1:] == 2, False) & (kind == 2), np.zeros(n, bool), np.full(n, np.nan), np.full(n, np.nan))
        g.open[lost] = False
        if marks:
            i = np.array([m[0] for m in marks])
            g.marked[i], g.odds[i] = True, [m[1] for m in marks]
            again = np.array([m[2] for m in marks])
            g.joined[i] = np.where(np.isnan(again), g.odds[i], again)
        if spaces is not None:
            for k, own in zip(at, spaces):
                g.open[[k + j - 1 for j in own if j]] = False
        return g

    def weights(self, g: Gaps, unmarked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each event, for :func:`forward_backward`."""
        a, b = g.left & (BUCKETS - 1), g.right & (BUCKETS - 1)
        pair = _pairs(g.left, g.right)
        n, lines = self.n, max(self.lines[LINES], 1.0)
        s1, i1, i2 = n[START, b].astype(float), n[INNER, b].astype(float), n[INNER2, pair].astype(float)
        start, inner = (s1 + 0.1) / (self.total[START] + 1), (i1 + 0.1) / (self.total[INNER] + 1)
        # behind a mark the word before says little of the next; elsewhere the next follows from it, and a beginning is one
        # of its script, as the word before shows that
        follows = (i2 + UNSEEN * inner) / (n[LEFT, a] + UNSEEN)
        ratio = np.log(np.where(g.marked, start / inner, (s1 + 0.1) / (n[BY_SCRIPT, g.script] + 1) / follows))
        own = np.clip(ratio, -BOUND, BOUND)
        # the share of its uses in which a word ends a line, or is one by itself; without a mark, as rare as such ends are
        last, one, first = n[LAST, a].astype(float), n[ONE, a].astype(float), n[START, a].astype(float)
        base = lines / (self.total[LAST] + self.total[LEFT] + 1)
        ends = (last + UNENDED * base) / (last + n[LEFT, a] + UNENDED)
        alone = (one + UNENDED * 0.01) / (first + UNENDED)
        bare = 1.0 if unmarked else (lines - self.lines[MARKED] + 0.5) / (lines + 1)
        plain, plain_again = (np.log(np.clip(x * bare, 1e-9, 1 - FLOOR)) - np.log(1 - np.clip(x * bare, 1e-9, 1 - FLOOR)) for x in (ends, alone))
        can = g.open | g.marked
        there = np.where(g.marked, g.odds, plain) + own
        again = np.where(g.marked, g.joined, plain_again) + own
        there, again = (np.where(can, np.exp(np.minimum(x, 30.0)), 0.0) for x in (there, again))
        # none after a boundary: the pair in the context of a beginning, against that of an inner place, together with what
        # the boundary's own next word said no more than BOUND
        before_a = n[INNER, a].astype(float)
        more = np.log((n[START2, pair] + 0.01) / (first + 0.5)) - np.log((i2 + 0.01) / (before_a + 0.5))
        said = np.append(0.0, ratio[:-1])
        on = np.clip(said + more, -BOUND, BOUND) - np.clip(said, -BOUND, BOUND)
        return there, again, np.exp(on)

    def posteriors(self, parsed: list[tuple[list[int], list[int], list[Event]]], unmarked: bool = False, spaces: list[set[int]] | None = None) -> tuple[Gaps, np.ndarray]:
        """Of a boundary at each event of some lines."""
        g = self.gaps(parsed, spaces)
        if not len(g.left):
            return g, np.zeros(0)
        return g, forward_backward(np.array(g.at), *self.weights(g, unmarked))

    def begins(self, texts: list[str | None], unmarked: bool = False) -> list[list[int]]:
        """For each text the 0-based offsets of the first characters of all its sentences."""
        skip = _patterns()["gap"]
        parsed, where = [], []
        out: list[list[int]] = [[] for _ in texts]
        spaces: list[set[int]] | None = [] if unmarked else None
        for i, text in enumerate(texts):
            if not text or text.isspace():
                continue
            for at, line in lines(text):
                out[i].append(at + skip.match(line).end())
                es = events(line)
                if es or unmarked:
                    begins, hashes = _tokens(line) if unmarked else _stretches(line, es)
                    parsed.append((begins, hashes, es))
                    where.append((i, at))
                    if unmarked:
                        spaces.append({k for k, b in enumerate(begins) if b and _THAI.match(line, b) and not line[b - 1].isspace()})
        g, p = self.posteriors(parsed, unmarked, spaces)
        for (i, at), n, (begins, hashes, es) in zip(where, g.at, parsed):
            for e in es:
                k = bisect_left(begins, e.begin) - 1
                if 0 <= k < len(begins) - 1 and p[n + k] >= THRESHOLD:
                    out[i].append(at + e.begin)
            if unmarked:
                likely = np.flatnonzero((p[n : n + len(hashes)] >= THRESHOLD) & ~g.marked[n : n + len(hashes)])
                out[i] = sorted({*out[i], *(at + begins[k + 1] for k in likely.tolist())})
        return out


def train(df: DataFrame, text: str = "text") -> Model:
    """The model of all texts of ``df``. At most TABLES * BUCKETS counts reach the driver."""
    x = df.select(text).where(F.col(text).isNotNull()).mapInArrow(_count, "table int, bucket int, n double")
    x = x.groupBy("table", "bucket").agg(F.sum("n").cast("double").alias("n")).toPandas()
    n, seen = np.zeros((TABLES, BUCKETS), np.float32), np.zeros(2)
    tables = x["table"] < TABLES
    n[x["table"][tables], x["bucket"][tables]] = x["n"][tables]
    seen[x["bucket"][~tables]] = x["n"][~tables]
    return Model(n, n.sum(1, dtype=np.float64), seen)


def sentences(df: DataFrame, keys: list[str], text: str = "text", model: Model | None = None, unmarked: bool = False) -> DataFrame:
    """A row for each sentence: ``keys, sentence_no, begin_char, end_char, sentence``, offsets in code points of the text.

    ``end_char`` is exclusive and leaves out spaces. Null and blank texts have no sentences; a text with neither end mark
    nor line break is one, unless ``unmarked`` lets boundaries without a mark end a sentence. Marks that open a line end
    nothing; repeated rows give repeated sentences; texts are taken whole. The model is trained on ``df`` where not given,
    and its fixed-size tables are broadcast.
    """
    model = model or train(df, text)
    shared = df.sparkSession.sparkContext.broadcast((model.n, model.total, model.lines))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in df.schema if f.name == k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            at, no, lo, hi, out = [], [], [], [], []
            texts = b.column("__text").to_pylist()
            for i, (x, begins) in enumerate(zip(texts, m.begins(texts, unmarked))):
                if not begins:
                    continue
                for k, (s, e) in enumerate(zip(begins, [*begins[1:], len(x)])):
                    unit = x[s:e].rstrip()
                    at.append(i)
                    no.append(k)
                    lo.append(s)
                    hi.append(s + len(unit))
                    out.append(unit)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in keys), pa.array(no, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(out, pa.string())], names=[*keys, "sentence_no", "begin_char", "end_char", "sentence"])

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, sentence_no int, begin_char bigint, end_char bigint, sentence string")
