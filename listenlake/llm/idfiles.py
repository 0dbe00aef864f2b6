"""Token ids written as Simple-8b words with per-block offsets, and read back (operator 9).

A file is a Parquet table of rows that hold whole documents: their ids, their
numbers of tokens, the ids before them in their shard, the words, and for every block of ``BLOCK`` ids the place of
its first word. A word has a selector in its top four bits and so many ids of
so many bits below; an id of more than 60 bits is escaped: selector 0, then the
plain id in the next word. Rows lie in ascending doc_id order over shards and
rows; shards are written by tasks that any executor can run again.

A null or empty text is a document of the end id alone. Rows that repeat are
documents that repeat; null ids come first. An empty table gives an empty file;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenlake.llm.common import BATCH_BYTES, batches, shared_path, text_bytes
from listenlake.llm.tokens import UnitIds, spec_of, worker_units

BLOCK = 1024
#: Fixed values of the format: ids in a word and bits of each, by selector; 0 is the escape, 1 is 120 zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ROW = "shard int, part int, row_start bigint, doc_ids array<bigint>, sizes array<bigint>, words binary, offsets array<int>"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids`` (unsigned, up to 64 bits) and the first word of each block; all blocks advance together."""
    ids = np.asarray(ids, np.uint64)
    n = -(-len(ids) // BLOCK)
    wide = np.zeros((n, BLOCK + 120), np.uint64)
    for k in range(n):
        part = ids[k * BLOCK : (k + 1) * BLOCK]
        wide[k, : len(part)] = part
    left = np.full(n, BLOCK, np.int64)
    if n:
        left[-1] = len(ids) - BLOCK * (n - 1)
    bits = np.zeros(wide.shape, np.uint8)
    for b in sorted({int(x) for x in BITS[1:]}):
        bits += wide >= np.uint64(1 << b) if b else wide > 0
    # bits is now a rank among the widths; rank r fits selectors whose width is the r-th or wider
    widths = np.array(sorted({int(x) for x in BITS[1:]}))
    rank_of = np.searchsorted(widths, BITS)
    at, rows, chosen = np.zeros(n, np.int64), np.arange(n), []
    view = np.lib.stride_tricks.sliding_window_view(bits, 120, axis=1)
    alive = rows
    while len(alive):
        top = np.maximum.accumulate(view[alive, at[alive]], axis=1)
        pick = np.zeros(len(alive), np.int64)
        for s in range(15, 0, -1):
            pick[top[:, COUNTS[s] - 1] <= rank_of[s]] = s
        chosen.append((alive, at[alive].copy(), pick))
        at[alive] += COUNTS[pick]
        alive = alive[at[alive] < left[alive]]
    if not chosen:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    row, pos, pick = (np.concatenate(x) for x in zip(*chosen, strict=True))
    by = np.lexsort((pos, row))
    row, pos, pick = row[by], pos[by], pick[by]
    place = np.cumsum(1 + (pick == 0)) - 1 - (pick == 0)
    words = np.zeros(len(pick) + int((pick == 0).sum()), np.uint64)
    for s in range(16):
        own = np.flatnonzero(pick == s)
        if not len(own):
            continue
        value = np.zeros(len(own), np.uint64)
        if s == 0:
            words[place[own] + 1] = wide[row[own], pos[own]]
        elif s > 1:
            for k in range(COUNTS[s]):
                value |= wide[row[own], pos[own] + k] << np.uint64(k * int(BITS[s]))
        words[place[own]] = value | np.uint64(s << 60)
    return words, place[np.searchsorted(row, rows)].astype(np.int32)


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids of all blocks."""
    out = np.zeros(total, np.uint64)
    if not total:
        return out
    pick = (words >> np.uint64(60)).astype(np.int64)
    ends = np.append(offsets[1:], len(words)).astype(np.int64)
    plain = np.zeros(len(words), bool)
    for b in np.unique(np.searchsorted(ends, np.flatnonzero(pick == 0), side="right")).tolist():
        i = int(offsets[b])
        while i < ends[b]:
            if pick[i] == 0:
                plain[i + 1] = True
                i += 1
            i += 1
    size = np.where(plain, 1, np.where(pick == 0, 0, COUNTS[pick]))
    block = np.repeat(np.arange(len(offsets)), ends - offsets)
    before = np.cumsum(size) - size
    inside = before - before[offsets][block]
    limit = np.minimum(BLOCK, total - block * BLOCK)
    for s in range(16):
        own = np.flatnonzero(plain if s == 0 else (pick == s) & ~plain)
        for k in range(1 if s == 0 else COUNTS[s] if s > 1 and len(own) else 0):
            at = inside[own] + k
            good = at < limit[own]
            value = words[own] if s == 0 else (words[own] >> np.uint64(k * int(BITS[s]))) & np.uint64((1 << int(BITS[s])) - 1)
            out[block[own][good] * BLOCK + at[good]] = value[good]
    return out


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents to ``path`` in ascending order of ``id_col``."""
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(tokenizer))

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, shard, k, before = worker_units(UnitIds, spec), TaskContext.get().partitionId(), 0, 0
        for part, texts in batches(rows, 1, BATCH_BYTES):
            ids, size = units.ids(texts)
            ids = np.insert(ids, np.cumsum(size), end_id)
            words, offsets = encode(ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([before], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([size + 1], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([offsets], pa.list_(pa.int32()))], ["shard", "part", "row_start", "doc_ids", "sizes", "words", "offsets"])
            k, before = k + 1, before + len(ids)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text).alias("raw"))
    slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(make, ROW).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the file at ``path``: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32 bits)."""
    file = spark.read.schema(ROW).parquet(path)
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    # One row per shard, and there are spark.sql.shuffle.partitions shards at most: so much is broadcast.
    sizes = file.groupBy("shard").agg(F.sum(size).alias("size"))
    start = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("shard_start"))

    def take(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                doc, size, words, offsets, shard, row_start = (batch.column(i)[k].as_py() for i in range(6))
                size = np.array(size, np.int64)
                ids = decode(np.frombuffer(words, "<u8"), np.array(offsets, np.int64), int(size.sum())).astype("<u4")
                end = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(doc), pa.int32()), pa.array(doc, pa.int64()), pa.array(row_start + end - size), pa.array(size), pa.array([ids[e - n : e].tobytes() for e, n in zip(end.tolist(), size.tolist(), strict=True)], pa.binary())], ["shard", "doc_id", "at", "n_tokens", "ids"])

    found = file.select("doc_ids", "sizes", "words", "offsets", "shard", "row_start").mapInArrow(take, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    return found.join(F.broadcast(start), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def ids_by_file(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write and read back, by a new folder in the shared place."""
    path = shared_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, path, end_id, id_col, text)
    return read_ids(docs.sparkSession, path)
