"""Centroid clustering of integer vectors by partial-distance search (operator 13).

Components become integers, floor(``scale`` * x), and all that follows is exact.
A vector is held against one centroid after another: squared differences add up
over blocks of dimensions, those of the highest variance first, and a centroid
is given up once its sum is strictly above the best distance so far; those that
are left finish all dimensions, and the smaller number wins a tie.

Vectors are written once as integers; a round is one narrow pass over them in
which every task sums its own vectors by cluster, and ``k`` sums (one row per
cluster and dimension) come to the driver, where centroids are made by exact
integer division. The first centroids are the vectors of the least hashed ids.

A vector takes part if it has exactly ``dims`` components, none of them null, NaN
or infinite; the others are left out. Components beyond 2**27 after scaling are
clamped there, so that distances fit into 64 bits. A null id is clustered, but is
a first centroid only where ids run out; rows that repeat all count, and equal
ids start in the order of their vectors. With fewer vectors than ``k`` there are
as many centroids as vectors; an empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import stored

LARGEST = 1 << 27
#: Vectors worked on at once.
ROWS = 1 << 13


@dataclass(frozen=True)
class CentroidParams:
    """``block``: dimensions summed before a centroid is held against the best again. ``seed``: what comes before an id in the hash that picks first centroids."""

    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    block: int = 8
    seed: str = "3:"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, params: CentroidParams) -> DataFrame:
    """id and q (integers) of the vectors that take part."""
    x = F.col("vec")
    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.size("vec") == params.dims)
    whole = kept.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return whole.select("id", F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * params.scale)))).cast("array<int>").alias("q"))


def nearest_centroid(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row of ``x`` and its squared distance; ``order`` has the dimensions by falling variance."""
    parts = [order[a : a + block] for a in range(0, len(order), block)]
    columns = [np.ascontiguousarray(x[:, p]) for p in parts]
    label, best = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        alive, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        for p, column in zip(parts, columns, strict=True):
            off = (column if len(alive) == len(x) else column[alive]) - centroid[p]
            total += (off * off).sum(1)
            still = total <= best[alive]
            if not still.all():
                alive, total = alive[still], total[still]
        closer = total < best[alive]
        label[alive[closer]], best[alive[closer]] = c, total[closer]
    return label, best


def _blocks(arrow: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in arrow:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, part.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def sums(points: DataFrame, centroids: np.ndarray | None, order: np.ndarray, params: CentroidParams) -> dict[int, tuple[int, list[int], list[float]]]:
    """By cluster (all in one without centroids): vectors, and the sums of their components and of the squares of these."""

    def add(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 1 if centroids is None else len(centroids)
        n, total, squares = np.zeros(k, np.int64), np.zeros((k, params.dims), np.int64), np.zeros((k, params.dims))
        for _, x in _blocks(arrow, params.dims):
            label = np.zeros(len(x), np.int32) if centroids is None else nearest_centroid(x, centroids, order, params.block)[0]
            for c in np.unique(label):
                own = x[label == c]
                n[c] += len(own)
                total[c] += own.sum(0)
                squares[c] += (own.astype(float) ** 2).sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64())), pa.array(list(squares[some]), pa.list_(pa.float64()))], ["c", "n", "total", "squares"])

    each = points.select("q").mapInArrow(add, "c int, n bigint, total array<bigint>, squares array<double>")
    wide = each.select("c", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "s"))
    found: dict[int, tuple[int, list[int], list[float]]] = {}
    for r in wide.groupBy("c", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s.total").cast("decimal(38,0)")).alias("total"), F.sum("s.squares").alias("squares")).collect():
        own = found.setdefault(r["c"], (r["n"], [0] * params.dims, [0.0] * params.dims))
        own[1][r["dim"]], own[2][r["dim"]] = int(r["total"]), r["squares"]
    return found


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", params: CentroidParams = CentroidParams()) -> tuple[DataFrame, np.ndarray]:
    """id, cluster and squared distance of every vector that takes part, and the final centroids (one row each)."""
    points = stored(quantised(vectors, id_col, vec_col, params), "points")
    rank = F.when(F.col("id").isNotNull(), F.sha2(F.concat(F.lit(params.seed), F.col("id").cast("string")), 256))
    first = points.orderBy(rank.asc_nulls_last(), "q").limit(params.k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), params.dims)
    result = "id bigint, cluster int, distance bigint"
    if not first:
        return vectors.sparkSession.createDataFrame([], result), centroids
    n, total, squares = sums(points, None, np.arange(params.dims), params)[0]
    order = np.argsort([s / n - (t / n) ** 2 for t, s in zip(total, squares, strict=True)], kind="stable")[::-1]
    for _ in range(params.rounds):
        moved = centroids.copy()
        for c, (n, total, _) in sums(points, centroids, order, params).items():
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(arrow, params.dims):
            label, distance = nearest_centroid(x, centroids, order, params.block)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(label), pa.array(distance)], ["id", "cluster", "distance"])

    return stored(points.mapInArrow(assign, result), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the summed distances of its cluster and of all, and the SHA-256 of its centroid; one row per centroid is broadcast. A sum beyond 64 bits is null."""
    spark = assigned.sparkSession
    names = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    every = per.agg(F.sum("own").alias("whole"))
    facts = per.crossJoin(F.broadcast(every)).select("cluster", F.col("own").try_cast("bigint").alias("cluster_inertia"), F.col("whole").try_cast("bigint").alias("inertia"))
    return assigned.join(F.broadcast(facts), "cluster").join(F.broadcast(names), "cluster")
