"""Nearest neighbours by multi-index hashing of learned rotated binary codes (operator 1).

Fit, on a bounded sample: an extra component evens out the norms (so that the
largest inner product becomes the smallest angle), principal axes and an
iteratively learned rotation give one bit per axis. The Hamming radius starts at
the quantile ``reach`` of the distances at which true neighbours lie and grows
until it holds the share ``recall`` of the sample's own true neighbours. In a
larger table true neighbours lie nearer than in its sample, so more are found.

Search: base vectors and queries are dealt into blocks by a hash of their ids.
In a pair of blocks the codes are cut into substrings, each indexed by its
value; by the pigeonhole principle a code within the radius agrees with the
query's in one substring up to radius/substrings bits, so probing those values
retrieves every such code. Where a substring has more values to probe than the
index has keys, the keys are compared instead, which finds the same codes. The
found ones are reranked by their exact inner products; for a query with fewer
than k of them the radius grows until there are k. The best of every block are
merged per query. Every query meets every block once: this is a stated query
set against all rows, and a vector that is shuffled serves ``query_block`` queries.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part: an inner product needs equal lengths. Equal
vectors tie, and ties go to the smaller id. Rows that repeat, id and vector, are
one point; other vectors of the same id are points and queries of their own, but
never each other's neighbours. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBSTRING = 16


@dataclass(frozen=True)
class CodeParams:
    """``sample`` vectors at most are fitted to; blocks hold about ``base_block`` and ``query_block`` rows."""

    bits: int = 64
    sample: int = 8192
    rounds: int = 30
    reach: float = 0.86
    recall: float = 0.97
    base_block: int = 16_384
    query_block: int = 32_768
    seed: int = 7


@dataclass(frozen=True)
class Codes:
    """What is learned: the mean and axes of the widened vectors, their largest norm, and the radius to search."""

    mean: np.ndarray
    axes: np.ndarray
    norm: float
    radius: int

    def base(self, x: np.ndarray) -> np.ndarray:
        wide = np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1, keepdims=True), 0))])
        return packed((wide - self.mean) @ self.axes)

    def query(self, q: np.ndarray) -> np.ndarray:
        return packed(np.hstack([q, np.zeros((len(q), 1))]) @ self.axes)


def packed(side: np.ndarray) -> np.ndarray:
    """The signs of each row as one unsigned number of 64 bits."""
    bits = np.zeros((len(side), 64), np.uint64)
    bits[:, : side.shape[1]] = side > 0
    return (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def learn(x: np.ndarray, norm: float, k: int, params: CodeParams) -> Codes:
    """Codes for vectors like the rows of ``x``."""
    wide = np.hstack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1, keepdims=True), 0))])
    mean = wide.mean(0)
    centred = wide - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, np.argsort(values)[::-1][: min(params.bits, 64, wide.shape[1])]]
    low = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(params.seed).normal(size=(low.shape[1],) * 2))[0]
    for _ in range(params.rounds):
        left, _, right = np.linalg.svd(np.sign(low @ turn).T @ low)
        turn = (left @ right).T
    codes = Codes(mean, axes @ turn, norm, 0)
    asked = x[: min(len(x), 512)]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argpartition(-scores, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.zeros((1, 1), int)
    away = np.bitwise_count(codes.query(asked)[:, None] ^ codes.base(x)[near])
    radius = int(np.quantile(away, params.reach, method="higher"))
    while (away <= radius).mean() < params.recall:
        radius += 1
    return Codes(mean, axes @ turn, norm, radius)


def substring(codes: np.ndarray, part: int) -> np.ndarray:
    return ((codes >> np.uint64(SUBSTRING * part)) & np.uint64((1 << SUBSTRING) - 1)).astype(np.uint16)


#: All values of a substring, by the bits they have.
_BY_BITS = np.argsort(np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16)), kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16))))


class SubstringIndex:
    """Codes by the value of each of their substrings: for every part its keys, the codes in the order of the keys, and where a key's codes begin."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.parts = codes, []
        for p in range(max(1, -(-bits // SUBSTRING))):
            value = substring(codes, p)
            order = np.argsort(value, kind="stable")
            keys, first = np.unique(value[order], return_index=True)
            self.parts.append((keys, order, np.append(first, len(order))))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all codes within ``radius`` of ``code``."""
        hit, n = np.zeros(len(self.codes), bool), len(self.parts)
        for p, (keys, order, first) in enumerate(self.parts):
            # radius = n * a + b: a code that differs by a or more bits in all parts, and by more than a in the first b + 1, is too far.
            near = min(radius // n - (p > radius % n), SUBSTRING)
            if near < 0:
                continue
            own = substring(np.array([code], np.uint64), p)[0]
            if _UP_TO[near] < len(keys):
                probe = np.sort(_BY_BITS[: _UP_TO[near]] ^ own)
                at = np.searchsorted(keys, probe)
                at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == probe)]
            else:
                at = np.flatnonzero(np.bitwise_count(keys ^ own) <= near)
            low, size = first[at], first[at + 1] - first[at]
            end = np.cumsum(size)
            if len(end):
                hit[order[np.repeat(low - end + size, size) + np.arange(end[-1])]] = True
        at = np.flatnonzero(hit)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def best(x: np.ndarray, small: np.ndarray, norm: float, ids: np.ndarray, q: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k largest inner products among rows ``at``, ties to smaller ids. ``small`` is ``x`` in single precision and ``norm`` its largest norm, which only leave out what can't be among them."""
    if len(at) > k:
        rough = np.take(small, at, axis=0) @ q.astype(np.float32)
        least = np.partition(rough, len(at) - k)[len(at) - k]
        # Twice the error bound of a product in single precision.
        slack = 2 * (x.shape[1] + 4) * 2.0**-23 * float(np.sqrt(q @ q)) * norm
        at = at[rough >= least - slack]
    score = (x[at] * q).sum(1)
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Ids and vectors (doubles) of the rows that take part."""
    x = F.col("vec")
    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(x, lambda v: v != 0))
    return kept.withColumn("norm", F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", params: CodeParams = CodeParams()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found for every row where ``is_query`` (a condition on ``id``) holds, among all other rows."""
    spark = vectors.sparkSession
    result = "query_id bigint, vec bigint, vec_id bigint, score double"
    base = clean_vectors(vectors, id_col, vec_col)
    facts = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.count_if(is_query).alias("asked")).orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    base = base.where(F.size("vec") == facts["dim"])
    sample = np.array([r[0] for r in base.orderBy(F.xxhash64("id"), "id").limit(params.sample).select("vec").collect()], np.float64)
    codes = learn(sample, facts["norm"], k, params)
    bits = codes.axes.shape[1]
    n_base, n_query = -(-facts["n"] // params.base_block), max(1, -(-facts["asked"] // params.query_block))

    def points(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids and vectors; all rows of an id are in one block."""
        x, ids = np.stack(rows["vec"].to_list()), rows["id"].to_numpy()
        several = np.flatnonzero(np.isin(ids, ids[rows["id"].duplicated().to_numpy()]))
        seen, again = set(), []
        for i in several.tolist():
            key = (int(ids[i]), x[i].tobytes())
            if key in seen:
                again.append(i)
            seen.add(key)
        return np.delete(ids, again), np.delete(x, again, axis=0)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, x = points(left)
            asked_ids, asked = points(right)
            small, index = x.astype(np.float32), SubstringIndex(codes.base(x), bits)
            others = len(ids) - pd.Series(ids).value_counts().reindex(asked_ids, fill_value=0).to_numpy()
            for i, (query_id, q, code) in enumerate(zip(asked_ids.tolist(), asked, codes.query(asked), strict=True)):
                radius, wanted = codes.radius, min(k, int(others[i]))
                while True:
                    at = index.within(code, radius)
                    at = at[ids[at] != query_id]
                    if len(at) >= wanted:
                        break
                    radius += len(index.parts)
                got, score = best(x, small, facts["norm"], ids, q, at, k)
                found.append((np.full(len(got), query_id), np.full(len(got), zlib.crc32(q.tobytes())), got, score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec", "vec_id", "score"), columns, strict=True)))

    def numbers(n: int):
        return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))

    rows = base.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_base)).alias("b"), F.explode(numbers(n_query)).alias("q"))
    asked = base.where(is_query).select("id", "vec", F.explode(numbers(n_base)).alias("b"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_query)).alias("q"))
    per_block = rows.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInPandas(search, result)
    order = Window.partitionBy("query_id", "vec").orderBy(F.desc("score"), "vec_id")
    return per_block.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
