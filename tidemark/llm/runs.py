"""Periodic runs: stretches of consecutive words that repeat with some period.

A run is a maximal stretch of words with smallest period q (words q apart are identical) whose
length is ``least`` and ``times`` times q at least; no word beside it extends it with that period.

Each text's words are numbered and searched by themselves. For every period p, only the points of a
grid are looked at that is so wide that each run of p has one (about n/2p points, so n log n over
all periods). A point whose word differs from the word p later, or that few words around it already
rule out, is done. For the others the common extension (LCE) of the two places is asked: the suffixes
at the places of a difference cover of 31 (6 of 31) are sorted, neighbours' common prefixes go into
a sparse table, and a query compares up to 30 words until both places are in the cover, then takes
the least prefix between them. A run's start is bisected with the same queries. A period's multiples
give the same stretch, of which the least period stays.

Defined results: a null text has no words; words are compared as they are, byte by byte; texts
of any length are read whole, and memory is a few dozen bytes for each word of a task's longest text;
repeated rows and rows without an id each give a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import text_parts

SPAN = 31
#: Each number below 31 is the difference of two of these, modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
#: By difference: the member from which another is that far.
_FROM = np.array([next(a for a in COVER if (a + d) % SPAN in COVER) for d in range(SPAN)])

SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def matched(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many words from i and from j on (backwards: step -1) are equal, up to most; word by word."""
    n, left, t = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 0
    while len(left):
        left = left[x[i[left] + step * t] == x[j[left] + step * t]]
        t += 1
        n[left] = t
        left = left[most[left] > t]
    return n


class Extensions:
    """How far the words from two places on are equal, for all pairs of places (i < j)."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.x = x = np.concatenate([words, np.zeros(SPAN + 2, np.int64)])  # words are numbered from 1
        sampled = np.zeros(SPAN, bool)
        sampled[list(COVER)] = True
        self.pos = pos = np.flatnonzero(np.resize(sampled, n))
        self.at = np.full(n + 1, len(pos))  # the end and the places behind it: one more
        self.at[pos] = np.arange(len(pos))
        levels = self._sorted()
        self.rank = levels[-1]
        order = np.argsort(self.rank[:-1])
        common = np.concatenate([np.zeros(1, np.int64), self._prefixes(levels, order[:-1], order[1:])])[: len(pos)]
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(pos):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _sorted(self) -> list[np.ndarray]:
        """Ranks of the cover's suffixes by their first 32 words, then by twice as many each time, until all differ."""
        x, pos, n = self.x, self.pos, self.n
        rank, tied, base = np.zeros(len(pos) + 1, np.int64), np.arange(len(pos)), x.max() + 1
        rank[-1] = -1
        offset, levels = 0, []
        while len(tied) or not levels:
            if offset <= SPAN:
                key = x[pos[tied] + offset] * base + x[pos[tied] + offset + 1]
            else:
                key = rank[self.at[np.minimum(pos[tied] + (SPAN << (len(levels) - 1)), n)]]
            by = np.lexsort((key, rank[tied]))
            o, key = tied[by], key[by]
            nth, old = np.arange(len(o)), np.ones(len(o) + 1, bool)
            old[1:-1] = rank[o][1:] != rank[o][:-1]
            new = old.copy()
            new[1:-1] |= key[1:] != key[:-1]
            rank[o] += np.maximum.accumulate(np.where(new[:-1], nth, 0)) - np.maximum.accumulate(np.where(old[:-1], nth, 0))
            tied = o[~(new[:-1] & new[1:])]
            offset += 2
            if offset > SPAN or not len(tied):
                offset = SPAN + 1
                levels.append(rank.copy())
        return levels

    def _prefixes(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common words of suffixes a and b (numbers in the sample)."""
        i, j = self.pos[a], self.pos[b]
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][self.at[np.minimum(i, self.n)]] == levels[k][self.at[np.minimum(j, self.n)]]
            i, j = i + same * (SPAN << k), j + same * (SPAN << k)
        return i - self.pos[a] + matched(self.x, i, j, np.full(len(i), SPAN + 1))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        few = (_FROM[(j - i) % SPAN] - i) % SPAN
        n = matched(self.x, i, j, few)
        on = np.flatnonzero((n == few) & (j + few < self.n))
        ranks = self.rank[self.at[i[on] + few[on]]], self.rank[self.at[j[on] + few[on]]]
        lo, hi = np.minimum(*ranks) + 1, np.maximum(*ranks)
        k = np.frexp(hi - lo + 1.0)[1] - 1
        for level in np.unique(k):
            own = k == level
            n[on[own]] += np.minimum(self.least[level][lo[own]], self.least[level][hi[own] - (1 << int(level)) + 1])
        return n


def runs_of(words: np.ndarray, least: int = 24, times: int = 3, points: int = 1 << 18) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words (numbered from 1), by start and period; times is 2 or more."""
    n = len(words)
    if n < max(least, times):
        return []
    p = np.arange(1, n // times + 1)
    shortest = np.maximum(least, times * p)
    grid = shortest - p
    counts = (n - p - 1) // grid + 1
    part, extension = np.cumsum(counts) // points, None
    found: dict[tuple[int, int], int] = {}
    for first, last in zip(a := np.flatnonzero(np.diff(part, prepend=-1)), [*a[1:], len(p)], strict=True):
        own = np.repeat(np.arange(first, last), counts[first:last])
        i = (np.arange(len(own)) - np.repeat(np.cumsum(counts[first:last]) - counts[first:last], counts[first:last])) * grid[own]
        hit = words[i] == words[i + p[own]]
        i, own = i[hit], own[hit]
        j, few = i + p[own], grid.min()
        ahead = matched(words, i, j, np.minimum(few, n - j))
        back = matched(words, i - 1, j - 1, np.minimum(few, i), -1)
        hit = ahead + back >= few
        i, j, own, back = i[hit], j[hit], own[hit], back[hit]
        if not len(i):
            continue
        extension = extension or Extensions(words)
        end = j + extension(i, j)
        new = np.ones(len(i), bool)  # a stretch's first point
        new[1:] = (own[1:] != own[:-1]) | (end[1:] != end[:-1])
        i, own, end, back = i[new], own[new], end[new], back[new]
        lo, hi = np.where(back < few, i - back, np.maximum(i - grid[own] + 1, 0)), np.where(back < few, i - back, i)
        while len(k := np.flatnonzero(lo < hi)):
            mid = (lo[k] + hi[k]) // 2
            reaches = extension(mid, mid + p[own[k]]) >= i[k] - mid
            hi[k], lo[k] = np.where(reaches, mid, hi[k]), np.where(reaches, lo[k], mid + 1)
        long = end - hi >= shortest[own]
        for s, e, q in zip(hi[long].tolist(), end[long].tolist(), p[own[long]].tolist(), strict=True):
            found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _row(text: bytes, least: int, times: int) -> tuple[int, list[tuple[int, int, int]], bytes]:
    words, ids = text.split(), {}
    runs = runs_of(np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int64), least, times)
    kept = words
    if runs:
        start, length, period = np.array(runs).T
        depth = np.cumsum(np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1))
        kept = [w for w, d in zip(words, depth.tolist(), strict=False) if not d]
    return len(words), runs, b" ".join(kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of each row: all runs by start and period, and the words, joined by one space,
    without those that any run holds after its first period.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_parts(batches):
            n, runs, collapsed = zip(*(_row(t, least, times) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(searched, SCHEMA).withColumnRenamed("id", id_col)
