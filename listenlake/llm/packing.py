"""Sum-of-squares packing of token pieces into sequences of a fixed length (operator 8).

Every document is tokenised and closed by an end id; those longer than a
sequence are cut into full pieces behind a first one that may be shorter.
Pieces are dealt into groups of about ``group_size`` by a hash of their place in
the stored table of pieces, so that one task packs a bounded number of them,
whatever ids repeat, and only lengths travel.
In a group, longest first, each piece goes where the sum over residual gaps
of the squared number of open bins becomes smallest.

A null or empty text is a document of the end id alone. Rows that repeat give
pieces that repeat, and a null id is an id like another. An empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import BATCH_BYTES, batches, stored, text_bytes
from listenlake.llm.tokens import UnitIds, spec_of, worker_units

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given. Ties go to the tightest bin."""
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        best, gap = 0, capacity
        if s < capacity:
            best = 2 * int(open_[capacity - s]) + 1
            here = open_[s:capacity]
            change = 2 * (open_[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = 1 << 40
            at = int(change.argmin())
            if change[at] <= best:
                gap = s + at
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = stacks[gap].pop()
            open_[gap] -= 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            open_[gap - s] += 1
    return bins, offsets


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be short."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    return [(0, head)] * (head > 0) + [(a, capacity) for a in range(head, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids."""
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer))

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units(UnitIds, spec)
        for part, texts in batches(rows, 1, BATCH_BYTES):
            flat, sizes = units.ids(texts)
            out, low = [], 0
            for d, size in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                ids = np.append(flat[low : low + size], end_id).astype("<u4")
                low += size
                out += [(d, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text).alias("raw")).mapInArrow(make, PIECE)


def pack(cut_pieces: DataFrame, capacity: int = 2048, group_size: int = 131_072) -> DataFrame:
    """``cut_pieces`` (a table that is cheap to read twice) with sequence_id and the gapless offset in that sequence."""
    groups = max(1, -(-cut_pieces.count() // group_size))
    spread = cut_pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["pack_group"] * (1 << 40) + bins, offset=offsets).drop(columns="pack_group")

    return spread.groupBy("pack_group").applyInPandas(place, f"{PIECE}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(stored(pieces(docs, tokenizer, capacity, end_id, id_col, text), "pieces"), capacity)
