"""Runs of periodic words by the runs theorem (operator 11).

A run is a stretch of consecutive words with smallest period q that holds q at
least twice and that no neighbouring word extends. For one of the two orders of
words (ascending or descending), its Lyndon roots are the longest Lyndon words
that start where they do; so every run shows among the n longest Lyndon words
under either order.

1. Words get numbers in a slice of texts, different ones for each text, so that
   nothing repeats across texts, and suffixes are sorted under both orders.
2. The longest Lyndon word at a place ends before the next place with a smaller
   rank in the inverse suffix array: next smaller values, found for all places
   at once by descending a sparse table of minima.
3. The word at [i, i + q) is a root only if words i and i + q are equal. It is
   extended to both sides by longest common extensions: minima of the LCP array
   between two ranks, from a sparse table, to the right in the text and to the
   left in its mirror image.
4. Stretches that hold the period twice are runs; equal ones from several roots
   are one.

Null and empty texts have no words and no runs; rows that repeat get equal
results; all columns of the input stay, and the results come in one struct
column whose name never clashes. An empty table gives no rows. One text has to
fit in a worker (some 150 bytes a word). Words of one text are told apart by
64-bit hashes. A text of any length is taken whole; its work grows as n log n,
times log n where long stretches repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import Words, batches, fresh, mix, text_bytes
from listenlake.llm.repetition import _suffix_levels

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


@dataclass(frozen=True)
class RunRules:
    """A run has ``min_words`` words at least, and holds its period twice."""

    min_words: int = 12


class Minima:
    """A sparse table: minima of any ranges."""

    def __init__(self, x: np.ndarray):
        self.rows, step = [x], 1
        while 2 * step <= len(x):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of every x[low:high]; no range is empty."""
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k in np.unique(level):
            own = level == k
            row = self.rows[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << int(k))])
        return out

    def next_smaller(self) -> np.ndarray:
        """For every place the next one with a smaller value, or the length."""
        x = self.rows[0]
        at = np.arange(1, len(x) + 1)
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            inside = np.flatnonzero(at < len(row))
            skip = inside[row[at[inside]] > x[inside]]
            at[skip] += 1 << k
        return at


class Suffixes:
    """The ranks of all suffixes of ``key`` and the longest common prefixes of any two; a suffix that ends is smaller."""

    def __init__(self, key: np.ndarray):
        _, self.levels = _suffix_levels(key)
        self.rank = self.levels[-1]
        self.lcp: Minima | None = None

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j (never the same) share."""
        if self.lcp is None:
            n = len(self.rank)
            order = np.empty(n, np.int64)
            order[self.rank] = np.arange(n)
            a, b = order[:-1].copy(), order[1:].copy()
            lcp = np.zeros(max(0, n - 1), np.int32)
            open_ = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
            for k in range(len(self.levels) - 1, -1, -1):
                x, y = a[open_], b[open_]
                same = (x < n) & (y < n)
                same[same] = self.levels[k][x[same]] == self.levels[k][y[same]]
                step = same * (1 << k)
                lcp[open_] += step.astype(np.int32)
                a[open_] += step
                b[open_] += step
            self.lcp = Minima(lcp)
            self.levels = []
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        return self.lcp.of(low.astype(np.int64), high.astype(np.int64)).astype(np.int64)


def runs_of(key: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in ``key`` (numbers from 0, none in two texts), by start and period."""
    n = len(key)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none, none
    forward = Suffixes(key)
    roots, periods = [], []
    for rank in (forward.rank, Suffixes(key.max() - key).rank):
        i = np.arange(n)
        q = Minima(rank).next_smaller() - i
        good = np.flatnonzero((i + q < n) & (key[np.minimum(i + q, n - 1)] == key))
        roots.append(good)
        periods.append(q[good])
    i, q = np.concatenate(roots), np.concatenate(periods)
    if not len(i):
        return none, none, none
    right = forward.common(i, i + q)
    # What a root shares with its copy to the left ends before both: in the mirror image it starts there.
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    if len(inner):
        mirror = Suffixes(key[::-1])
        left[inner] = mirror.common(n - i[inner], n - i[inner] - q[inner])
    start, length = i - left, left + q + right
    good = length >= np.maximum(min_words, 2 * q)
    start, length, q = start[good], length[good], q[good]
    found = np.unique(np.stack([start, q, length], 1), axis=0) if len(start) else np.empty((0, 3), np.int64)
    return found[:, 0], found[:, 2], found[:, 1]


def measure(texts: list[bytes], rules: RunRules) -> pa.StructArray:
    """Words, runs and the collapsed text of each text."""
    words = Words(texts)
    salt = mix(np.arange(words.n_docs, dtype=np.uint64) + np.uint64(101))
    key = np.unique(words.hash ^ salt[words.doc], return_inverse=True)[1].astype(np.int64) if len(words.hash) else np.empty(0, np.int64)
    start, length, period = runs_of(key, rules.min_words)
    own = words.doc[start]
    edge = np.zeros(len(key) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    busy = set(np.unique(own).tolist())
    collapsed = []
    for d, t in enumerate(texts):
        split = t.split()
        left = compress(split, kept[words.first[d] : words.first[d + 1]].tolist()) if d in busy else split
        collapsed.append(b" ".join(left).decode("utf-8", "replace"))
    rows = pa.StructArray.from_arrays([pa.array(start - words.first[own]), pa.array(length), pa.array(period)], fields=list(_RUN))
    offsets = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32))
    return pa.StructArray.from_arrays([pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(offsets, rows), pa.array(collapsed, pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", rules: RunRules = RunRules(), out: str = "periods") -> tuple[DataFrame, str]:
    """``docs`` with a struct of n_words, runs (start, length, period in words, by start and period) and collapsed.

    ``collapsed`` is the text without the repeats of its runs: a word goes if a run holds
    it after its first period; the others are joined by one space. The name of the struct
    comes second. One pass, no shuffle.
    """
    out, raw = fresh(docs, out), fresh(docs, "raw_text")
    wide = docs.withColumn(raw, text_bytes(text))
    at = len(wide.columns) - 1

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(rows, at):
            yield pa.RecordBatch.from_arrays([*part.columns[:at], measure(texts, rules)], [*part.schema.names[:at], out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return wide.mapInArrow(judge, f"{kinds}, `{out}` {RUNS}"), out
