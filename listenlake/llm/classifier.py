"""Quality scores by logistic regression over hashed word n-grams (operator 12).

A text is read as two rows of words: the words themselves (A-Z lower-cased) and
their shapes, in which a run of capitals, of other letters, of digits or of one
sign is one symbol, and a word equal to the one before it is marked. N-grams of
each row are hashed into 2**``bits`` weights; a text's value for a weight is
1 + ln(count), and each row of n-grams is scaled to length one, so that long
texts weigh no more than short ones.

Weights are learned by follow-the-regularised-leader (per-coordinate steps, L1
and L2) in one task, over a bounded sample of the labelled rows: those with the
least hashed ids, ``max_rows`` at most, of which as many are read as have
``max_entries`` values together. All that is bounded, whatever the tables. The
weights (2**``bits`` floats) then go to every task, where a score is a sparse
dot product; texts are scored in one narrow pass.

Null and empty texts have no n-grams: their score is the intercept's. Rows that
repeat are scored alike; of labelled rows with one id, the one whose text has
the smallest SHA-256 is learned, and an id with both labels counts as either
once. Null labels and null ids teach nothing; without any label all scores are
0.5. An empty table gives no rows; columns of any name stay. One text has to fit
in a worker. Words and n-grams are told apart by 64-bit hashes, then folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import _IS_SPACE, Words, batches, fresh, gram_hashes, mix, span_hashes, text_bytes


@dataclass(frozen=True)
class ClassifierParams:
    """``words`` and ``shapes``: the n-grams of each row of words. ``alpha``, ``beta``, ``l1``, ``l2``: those of the leader's steps."""

    bits: int = 18
    words: tuple[int, ...] = (1, 2)
    shapes: tuple[int, ...] = (1, 2, 3)
    max_rows: int = 8_192
    max_entries: int = 1 << 23
    passes: int = 10
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3


#: Capitals, other letters and digits are one class each; any other sign is its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_AGAIN, _SHAPE = np.uint64(0x632BE59BD9B4E019), np.uint64(0x8CB92BA72F3D8DD7)


def shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the shapes of the words [start, end)."""
    kind = _CLASS[raw]
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | _IS_SPACE[raw[1:]] | _IS_SPACE[raw[:-1]]
    place = np.append(0, np.cumsum(first))
    return span_hashes(kind[first], place[start], place[end])


def features(texts: list[bytes], params: ClassifierParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, weight and value of all entries, by text and weight."""
    words = Words(texts, lower=True)
    cased = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    shape = shapes(cased, words.start, words.end)
    again = np.zeros(len(shape), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    shape = np.where(again, mix(shape ^ _AGAIN), shape)
    rows, mask = [], np.uint64((1 << params.bits) - 1)
    for salt, base, sizes in ((np.uint64(0), words.hash, params.words), (_SHAPE, shape, params.shapes)):
        parts = []
        for n in sizes:
            gram = mix(gram_hashes(base, n) ^ salt) & mask
            inside = words.doc[n - 1 :] == words.doc[: len(words.doc) - n + 1]
            parts.append((words.doc[: len(gram)][inside].astype(np.int64) << params.bits) | gram[inside].astype(np.int64))
        key, count = np.unique(np.concatenate(parts), return_counts=True)
        value = 1 + np.log(count)
        text = key >> params.bits
        norm = np.sqrt(np.bincount(text, value * value, len(texts)))
        rows.append((key, value / norm[text] if len(text) else value))
    key, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    key, at = np.unique(key, return_inverse=True)  # a weight that both rows hash to gets the sum
    return key >> params.bits, key & int(mask), np.bincount(at, value, len(key))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], params: ClassifierParams) -> np.ndarray:
    """Weights, the intercept last, by passes of the leader over the rows (weights, values) in their order."""
    size = (1 << params.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    def lead(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= params.l1, 0.0, -(z[at] - np.sign(z[at]) * params.l1) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2))

    for _ in range(params.passes):
        for (at, value), y in zip(rows, labels, strict=True):
            at, value = np.append(at, size - 1), np.append(value, 1.0)
            own = lead(at)
            g = (1 / (1 + np.exp(-np.clip(own @ value, -40, 40))) - y) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha * own
            n[at] += g * g
    return lead(np.arange(size)).astype(np.float32)


def score(texts: list[bytes], weights: np.ndarray, params: ClassifierParams) -> np.ndarray:
    """The probability of label 1 for each text."""
    text, at, value = features(texts, params)
    total = np.bincount(text, weights[at].astype(np.float64) * value, len(texts)) + float(weights[-1])
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label", params: ClassifierParams = ClassifierParams()) -> np.ndarray:
    """Weights learned from the rows of ``docs`` that ``labels`` (id, label 0 or 1) has."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    picked = known.orderBy(F.xxhash64("id"), "id", "label").limit(params.max_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("raw")).join(F.broadcast(picked), "id").select("id", "label", F.sha2("raw", 256).alias("sha"), "raw")
    kind = docs.schema[id_col].dataType.simpleString()

    def entries(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(arrow, 3):
            of, at, value = features(texts, params)
            cut = np.searchsorted(of, np.arange(len(texts) + 1))
            pairs = [(at[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, pa.binary()) for x in zip(*pairs, strict=True))], ["id", "label", "sha", "at", "value"])

    def fit(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels, total = [], [], 0
        for batch in arrow:
            for at, value, y in zip(batch.column("at"), batch.column("value"), batch.column("label").to_pylist(), strict=True):
                own = np.frombuffer(at.as_py(), np.int32), np.frombuffer(value.as_py(), np.float32)
                total += len(own[0])
                if total > params.max_entries:
                    break
                found.append(own)
                labels.append(y)
            if total > params.max_entries:
                break
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([learn(found, labels, params).tobytes()], pa.binary())], ["weights"])

    each = rows.mapInArrow(entries, f"id {kind}, label int, sha string, at binary, value binary").groupBy("id", "label").agg(F.min(F.struct("sha", "at", "value")).alias("row"))
    in_order = each.select("id", "label", "row.at", "row.value").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label")
    found = in_order.mapInArrow(fit, "weights binary").first()
    return np.zeros((1 << params.bits) + 1, np.float32) if found is None else np.frombuffer(found[0], np.float32)


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", params: ClassifierParams = ClassifierParams(), out: str = "score") -> tuple[DataFrame, str]:
    """``docs`` with the probability of label 1; the name of that column comes second. One pass, no shuffle."""
    out, raw = fresh(docs, out), fresh(docs, "raw_text")
    wide = docs.withColumn(raw, text_bytes(text))
    at = len(wide.columns) - 1

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(rows, at):
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(score(texts, weights, params))], [*part.schema.names[:at], out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return wide.mapInArrow(judge, f"{kinds}, `{out}` double"), out


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text is divisible by ``folds``. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
