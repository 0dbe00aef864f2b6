"""Quality rules with a suffix-array repetition test (operator 10).

Each text is judged alone: counts of words, symbols, repeated lines and
repeated three-word windows, then a suffix array over its words. Where
neighbours in suffix order share ``min_repeat`` words or more, their LCP
interval is a maximal repeated substring; the spans of all of them are
united, and the share of covered words and the longest repeat are limited,
as is the share of symbols among the characters of words.

Null and empty texts have no words and fail the base rules; repeated rows are
judged alike; all columns of the input are kept, and the measures come in one
struct column whose name never clashes. An empty table gives no rows. Words and
windows of words are told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import SPACE, Words, batches, fresh, gram_hashes, mix, text_bytes

_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))
MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,covered_words:bigint,longest_repeat:bigint,repeats:array<struct<start:bigint,end:bigint>>,base_failed:boolean,kept:boolean>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.struct([*((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")), ("repeats", _SPANS), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


@dataclass(frozen=True)
class RepetitionRules:
    """Limits. A repeat has ``min_repeat`` words at least."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 8
    max_covered_percent: int = 30
    max_longest: int = 120
    max_symbol_percent: int = 5


def _suffix_levels(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of those positions whose suffix is not told apart by its first word, and the ranks by the first 1, 2, 4, ... symbols.

    Prefix doubling: a suffix whose rank is its own leaves the later rounds.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = first
    levels, step = [rank], 1
    alone = new & np.append(new[1:], True)
    open_ = order[~alone]
    while len(open_):
        after = open_ + step
        second = np.where(after < n, levels[-1][np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        own = levels[-1][open_].astype(np.int64)
        pair = own * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        open_, pair, own = open_[by], pair[by], own[by]
        at = np.arange(len(pair))
        group = np.ones(len(pair), bool)
        group[1:] = own[1:] != own[:-1]
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        offset = at - np.maximum.accumulate(np.where(group, at, 0))
        sub = np.maximum.accumulate(np.where(new, at, 0))
        rank = levels[-1].copy()
        rank[open_] = own + offset[sub]
        levels.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return order, levels


def _longest_at(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that begin a repeat of ``least`` symbols or more, and the length of the longest one there, from the LCP of neighbours in suffix order."""
    n = len(levels[0])
    top = min(len(levels) - 1, least.bit_length() - 1)
    ranks = levels[top]
    size = np.bincount(ranks, minlength=n)
    at = np.flatnonzero(size[ranks] > 1)
    if not len(at):
        return at, at
    sa = at[np.argsort(levels[-1][at], kind="stable")]
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (i < n) & (j < n)
        same[same] = levels[k][i[same]] == levels[k][j[same]]
        step = same * (1 << k)
        lcp += step
        i += step
        j += step
    longest = np.zeros(len(sa), np.int64)
    longest[1:] = lcp
    longest[:-1] = np.maximum(longest[:-1], lcp)
    good = longest >= least
    return sa[good], longest[good]


def measure(texts: list[bytes], rules: RepetitionRules) -> list[dict]:
    """The measures of each text, with the byte spans of its repeats."""
    words = Words(texts)
    n, doc, salt = len(words.hash), words.doc, mix(np.arange(words.n_docs, dtype=np.uint64) + np.uint64(77))
    key = words.hash ^ salt[doc] if n else words.hash
    grams = gram_hashes(key, 3)
    inside = doc[2:] == doc[:-2]
    at = np.flatnonzero(inside)
    found = grams[at]
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 3, -1)
    repeat_words = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=words.n_docs) if n else np.zeros(words.n_docs, int)
    covered, longest, spans = np.zeros(words.n_docs, np.int64), np.zeros(words.n_docs, np.int64), [[] for _ in texts]
    # A repeat of three words or more holds a window found twice; shorter ones are looked for in all texts.
    busy = np.flatnonzero(np.bincount(doc[at[twice]], minlength=words.n_docs)) if rules.min_repeat >= 3 else np.flatnonzero(words.count)
    if len(busy):
        pick = np.flatnonzero(np.isin(doc, busy))
        _, levels = _suffix_levels(key[pick])
        p, length = _longest_at(levels, rules.min_repeat)
        if len(p):
            edge = np.zeros(len(pick) + 1, np.int64)
            np.add.at(edge, p, 1)
            np.add.at(edge, p + length, -1)
            cover = np.cumsum(edge[:-1]) > 0
            own = doc[pick]
            covered += np.bincount(own[cover], minlength=words.n_docs)
            np.maximum.at(longest, own[p], length)
            cut = np.ones(len(cover), bool)
            cut[1:] = (cover[1:] != cover[:-1]) | (own[1:] != own[:-1])
            begin = np.flatnonzero(cut)
            for b, e in zip(begin, np.append(begin[1:], len(cover)), strict=True):
                if cover[b]:
                    d = own[b]
                    spans[d].append({"start": int(words.start[pick[b]] - words.base[d]), "end": int(words.end[pick[e - 1]] - words.base[d])})
    out = []
    for d, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        n_words, dup = int(words.count[d]), len(lines) - len(set(lines))
        chars = len(t.translate(None, _NOT_COUNTED))
        symbols = len(t) - len(t.translate(None, _SYMBOLS))
        failed = n_words < rules.min_words or 100 * int(repeat_words[d]) > rules.max_repeat_percent * n_words
        kept = not failed and 100 * int(covered[d]) <= rules.max_covered_percent * n_words and int(longest[d]) <= rules.max_longest and 100 * symbols <= rules.max_symbol_percent * chars
        out.append({"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": int(repeat_words[d]), "covered_words": int(covered[d]), "longest_repeat": int(longest[d]), "repeats": spans[d], "base_failed": failed, "kept": kept})
    return out


def quality_measures(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules(), out: str = "quality") -> tuple[DataFrame, str]:
    """``docs`` with a struct of measures; the name of that column comes second. One pass, no shuffle."""
    out, raw = fresh(docs, out), fresh(docs, "raw_text")
    wide = docs.withColumn(raw, text_bytes(text))
    at = len(wide.columns) - 1

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(rows, at):
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(measure(texts, rules), _ARROW)], [*part.schema.names[:at], out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return wide.mapInArrow(judge, f"{kinds}, `{out}` {MEASURES}"), out


def keep_good(docs: DataFrame, text: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs`` that all rules pass, with the same columns."""
    judged, out = quality_measures(docs, text, rules)
    return judged.where(F.col(f"{out}.kept")).select(*docs.columns)
