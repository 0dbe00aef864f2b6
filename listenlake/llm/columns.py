"""Which columns (hashes) of a sparse document-by-column matrix more than one document has, found in blocks of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from listenlake.llm.common import BATCH_BYTES, batches, mix, runs

#: Entries gathered by one block of columns.
BLOCK_ENTRIES = 1 << 21
#: Entries that a task holds before it hands them to blocks.
TASK_ENTRIES = 1 << 20
#: Parts in which a block is sorted; a power of two.
SLIVERS = 16


def blocks_for(entries: int, each: int = BLOCK_ENTRIES) -> int:
    """A power of two by which ``entries`` make blocks of about ``each``."""
    return 1 << max(4, int(entries // each).bit_length())


def shift_for(blocks: int) -> np.uint64:
    return np.uint64(64 - (blocks.bit_length() - 1))


def short(columns: np.ndarray, blocks: int) -> np.ndarray:
    """What is kept of a column: its block and the last 32 bits. Two columns that look alike here only look shared."""
    return (columns >> shift_for(blocks) << np.uint64(32)) | (columns & np.uint64(0xFFFFFFFF))


def shared_columns(rows: DataFrame, columns_of: Callable[[pa.RecordBatch, list[bytes]], dict[int, np.ndarray]], blocks: int) -> DataFrame:
    """key, shared (how many of its columns another key has too, at most) and those columns in ``short`` form (binary).

    ``rows`` ends with a binary text column; ``columns_of`` gives the sorted distinct
    columns of each key of a batch; rows of one key have equal texts. Slices are held
    together to TASK_ENTRIES entries in a task; columns that two keys of these share are
    settled there, so a column of every document is one entry for each of them.
    """
    shift, at, names = shift_for(blocks), len(rows.columns) - 1, ["block", "keys", "counts", "columns", "common"]

    def row(block: int, keys: np.ndarray, counts: np.ndarray, columns: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, counts.astype(np.uint32), columns, common))], names)

    def gather(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for part, texts in batches(arrow, at, BATCH_BYTES):
            new = {k: x for k, x in columns_of(part, texts).items() if len(x) and k not in held}
            held |= new
            size += sum(map(len, new.values()))
            if size >= TASK_ENTRIES:
                yield from settle(held)
                held, size = {}, 0
        if held:
            yield from settle(held)

    def settle(by_key: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.array(list(by_key), np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(x) for x in by_key.values()])
        column = np.concatenate(list(by_key.values()))
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        new = np.ones(len(column), bool)
        new[1:] = column[1:] != column[:-1]
        alone = new & np.append(new[1:], True)
        known = packed(keys[owner[~alone]], short(column[~alone], blocks))
        for b, k, c in known.itertuples(index=False):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - b], pa.int64()), *(pa.array([x], pa.binary()) for x in (k, b"", c, b""))], names)
        common, column, owner = column[new & ~alone], column[alone], owner[alone]
        by = np.lexsort((owner, column >> shift))
        column, owner = column[by], owner[by]
        # Only blocks that have entries here: their number does not follow that of all blocks.
        edges = np.union1d(column >> shift, common >> shift)
        cut, cut_common = ((np.searchsorted(x >> shift, edges), np.searchsorted(x >> shift, edges, side="right")) for x in (column, common))
        for b, low, high, first, last in zip(edges.tolist(), *cut, *cut_common, strict=True):
            who, n = np.unique(owner[low:high], return_counts=True)
            yield row(b, keys[who], n, column[low:high].astype(np.uint32), common[first:last].astype(np.uint32))

    def count(block: pd.DataFrame) -> pd.DataFrame:
        number = int(block["block"].iloc[0])
        if number < 0:  # settled in its slice
            return pd.DataFrame({"bucket": [-1 - number], "keys": [b"".join(block["keys"])], "columns": [b"".join(block["columns"])]})
        key = np.concatenate([np.repeat(np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32)) for k, c in zip(block["keys"], block["counts"], strict=True)])
        column = np.concatenate([np.frombuffer(x, np.uint32) for x in block["columns"]])
        common = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in block["common"]]))
        parts = []
        for own in range(SLIVERS):  # few columns at a time, to bound what sorting holds
            mine = column >> np.uint32(32 - SLIVERS.bit_length() + 1) == own
            k, c = key[mine], column[mine]
            by = np.lexsort((k, c))
            k, c = k[by], c[by]
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            k, c = k[fresh], c[fresh]
            start, end = runs(c)
            hit = np.repeat(end - start > 1, end - start) | np.isin(c, common)
            parts.append((k[hit], c[hit].astype(np.uint64) | np.uint64(number << 32)))
        return packed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def packed(key: np.ndarray, column: np.ndarray) -> pd.DataFrame:
        bucket = (mix(key) % np.uint64(blocks)).astype(np.int64)
        by = np.lexsort((key, bucket))
        key, column, bucket = key[by], column[by], bucket[by]
        edges, ends = runs(bucket)
        return pd.DataFrame({"bucket": bucket[edges], "keys": [key[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], "columns": [column[a:b].tobytes() for a, b in zip(edges, ends, strict=True)]})

    def total(bucket: pd.DataFrame) -> pd.DataFrame:
        key, column = (np.concatenate([np.frombuffer(x, np.uint64) for x in bucket[c]]) for c in ("keys", "columns"))
        by = np.lexsort((column, key))
        key, column = key[by], column[by]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (column[1:] != column[:-1])
        key, column = key[fresh], column[fresh]
        first, ends = runs(key)
        return pd.DataFrame({"key": key[first].view(np.int64), "shared": ends - first, "columns": [column[a:b].tobytes() for a, b in zip(first, ends, strict=True)]})

    form = "bucket bigint, keys binary, columns binary"
    gathered = rows.mapInArrow(gather, "block bigint, keys binary, counts binary, columns binary, common binary")
    return gathered.groupBy("block").applyInPandas(count, form).groupBy("bucket").applyInPandas(total, "key bigint, shared bigint, columns binary")
