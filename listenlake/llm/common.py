"""What the training-data operators share: tables, joins on hot keys, text batches and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.shared import drop_since, made, shared_path, stored

__all__ = ["drop_since", "made", "shared_path", "stored"]

#: Texts are worked on in slices of about this many bytes; one text is never cut.
SLICE_BYTES = 1 << 18
#: As many where work is shared by equal words.
BATCH_BYTES = 1 << 22
#: The pattern of a word, and the bytes that part words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], rows: str, parts: int = 64) -> DataFrame:
    """``left`` with the columns of ``right`` (left join), which has each key once and in ``rows`` how many rows of ``left`` have it.

    A key with more than one in ``parts`` of all rows is dealt to several tasks by a salt. There
    are at most ``parts`` such keys, whatever the tables, so their list is broadcast.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    salt, share = fresh(left, "salt"), fresh(left, "salt_parts")
    need = F.greatest(F.lit(1), F.ceil(F.col(rows) * parts / F.lit(max(1, total)))).cast("int")
    hot = right.where(F.col(rows) * parts > total).select(*keys, need.alias(share))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(F.col(share) > 1, F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.col(share))).otherwise(0).cast("int"))
    copied = right.withColumn(salt, F.explode(F.sequence(F.lit(0), need - 1))).drop(rows)
    return dealt.join(copied, [*keys, salt], "left").drop(salt, share)


def text_bytes(col: str):
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def slices(lengths: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose summed lengths stay near ``most``; each has a row at least."""
    a = total = 0
    for b, n in enumerate(lengths):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, made = max(n, 2 * SLICE_BYTES), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            made.append(np.multiply.accumulate(full))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``raw``; starts and ends ascend. Only the content counts."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + SLICE_BYTES, side="right")))
        part = raw[low : int(ends[b - 1])]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


class Words:
    """The words of a few texts: ``start``/``end`` in ``raw`` (the texts, each closed by a newline), ``doc`` and ``hash``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n" if texts else b""
        self.raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        space = _IS_SPACE[self.raw]
        before = np.ones(len(space), bool)
        before[1:] = space[:-1]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.doc = np.searchsorted(self.base[1:], self.start, side="right")
        self.hash = span_hashes(self.raw, self.start, self.end)
        self.n_docs = len(texts)
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])


_GRAM = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every window of ``n`` words, whatever text they lie in; n is 64 at most."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : k + len(total)] * _GRAM[k]
    return mix(total + np.uint64(n))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in ``x``."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return start, np.append(start[1:], len(x))


def batches(rows: Iterator[pa.RecordBatch], text_at: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with the texts in column ``text_at`` (binary, none null)."""
    for batch in rows:
        lengths = np.diff(np.frombuffer(batch.column(text_at).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(text_at).offset)) if pa.types.is_binary(batch.column(text_at).type) else [len(x) for x in batch.column(text_at).to_pylist()]
        for a, b in slices([int(x) for x in lengths], most):
            part = batch.slice(a, b - a)
            yield part, part.column(text_at).to_pylist()
        del batch
        pa.default_memory_pool().release_unused()
