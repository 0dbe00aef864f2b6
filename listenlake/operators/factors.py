"""Non-negative factors of document-by-tag tables of any size.

Documents with equal tags and weights (told apart by SHA-256) are one pattern with its multiplicity: their rows
stay equal through all updates. Both factors start from a doubly non-negative singular
value decomposition and are updated in turns by coordinate descent, until what the
gradients still ask for has fallen to ``tol`` of the first round; all is deterministic.

A table of at most ``cells`` patterns by tags is solved in one task per K. A larger one
with at most ``narrow`` tags is dealt to blocks of whole patterns (``Tall``): a block's
entries and its rows of all factors stand in one row of a table, the tags' factors go to
all tasks, and a round is one narrow pass for all K that hands back sums of k by k and k
by tags. The singular vectors come from the tags' Gram matrix. One with more tags is dealt
to blocks of patterns by tags, and the factors are tables of blocks: products
with the entries are joins on a block's number, summed in two steps; k by k Gram
matrices are sums that go to all tasks; a coordinate pass needs nothing else than its own
row. The singular vectors come from subspace iteration by the same products. Tables of a
round are written and those before it deleted. All ways give the same factors to the
accuracy of their sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listenlake.shared import drop_since, made, stored


@dataclass(frozen=True)
class FactorParams:
    """``rows``, ``columns``: the sides of a block. ``extra``: vectors of the subspace beyond k; ``turns``: its iterations at most. ``narrow``: tags of a table that is not cut between them."""

    cells: int = 1 << 23
    narrow: int = 1 << 10
    rows: int = 1 << 15
    columns: int = 1 << 13
    extra: int = 8
    turns: int = 60
    tol: float = 1e-4


def coordinates(a: np.ndarray, gram: np.ndarray, cross: np.ndarray, weight: np.ndarray | None = None) -> float:
    """One pass over the rows of ``a`` (k by n), in place; what the gradients asked for, by ``weight``."""
    moved = 0.0
    for j in range(len(a)):
        gradient = gram[j] @ a
        gradient -= cross[j]
        step = gradient / -gram[j, j] if gram[j, j] > 0 else None
        gradient[(a[j] == 0) & (gradient > 0)] = 0
        np.abs(gradient, out=gradient)
        moved += float(gradient.sum() if weight is None else gradient @ weight)
        if step is not None:
            step += a[j]
            np.maximum(step, 0, out=a[j])
    return moved


def side(j: int, u: np.ndarray, v: np.ndarray, s: float, plus: tuple[float, float], minus: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The j-th start of both factors from a pair of singular vectors; ``plus`` and ``minus``: squared norms of their positive and negative parts."""
    if j == 0:
        return np.sqrt(s) * np.abs(u), np.sqrt(s) * np.abs(v)
    sign, (p, q) = (-1, minus) if minus[0] * minus[1] > plus[0] * plus[1] else (1, plus)
    if p * q == 0:
        return np.zeros_like(u), np.zeros_like(v)
    scale = np.sqrt(s * np.sqrt(p * q))
    return scale * np.maximum(sign * u, 0) / np.sqrt(p), scale * np.maximum(sign * v, 0) / np.sqrt(q)


def nmf(x: np.ndarray, k: int, max_iter: int, tol: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Factors (n by k and k by columns) of a matrix held whole; a row counts ``weight`` times."""
    m = np.ones(len(x)) if weight is None else weight.astype(float)
    u, s, v = np.linalg.svd(x * np.sqrt(m)[:, None], full_matrices=False)
    u = u / np.sqrt(m)[:, None]
    w, h = np.zeros((k, len(x))), np.zeros((k, x.shape[1]))
    for j in range(min(k, len(s))):
        a, b = u[:, j], v[j]
        parts = [(float((np.maximum(g * a, 0) ** 2) @ m), float((np.maximum(g * b, 0) ** 2).sum())) for g in (1, -1)]
        w[j], h[j] = side(j, a, b, s[j], *parts)
    first = None
    for _ in range(max_iter):
        moved = coordinates(w, h @ h.T, h @ x.T, m)
        heavy = w * m
        moved += coordinates(h, heavy @ w.T, heavy @ x)
        first = moved if first is None else first
        if first == 0 or moved / first <= tol:
            break
    return w.T, h


def _bytes(x: np.ndarray, kind=np.float64) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _floats(x: bytes, k: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(k, -1)


class Blocks:
    """The entries of a large table in blocks (rb, cb, r, c, v, n_r, n_c), and what is done with them. A factor has rows (b, f, m): ``f`` is k by the block's rows."""

    def __init__(self, entries: DataFrame, rows: DataFrame, columns: DataFrame, params: FactorParams):
        """``entries`` (rb, r, cb, c, v); ``rows`` (b, n, m packed) and ``columns`` (b, n)."""

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"rb": [f["rb"].iloc[0]], "cb": [f["cb"].iloc[0]], "r": [_bytes(f["r"], np.int32)], "c": [_bytes(f["c"], np.int32)], "v": [_bytes(f["v"])]})

        packed = entries.groupBy("rb", "cb").applyInPandas(pack, "rb bigint, cb bigint, r binary, c binary, v binary")
        sizes = rows.select(F.col("b").alias("rb"), F.col("n").alias("n_r")), columns.select(F.col("b").alias("cb"), F.col("n").alias("n_c"))
        self.x = stored(packed.join(sizes[0], "rb").join(sizes[1], "cb"), "entries")
        self.rows, self.columns, self.params = rows, columns, params

    def product(self, factor: DataFrame, k: int, by_rows: bool) -> DataFrame:
        """b, cross: the sums over columns for each block of rows, or the other way about with rows counted by their multiplicity."""
        here, there = ("rb", "cb") if by_rows else ("cb", "rb")

        def times(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for b, salt, r, c, v, n, g, m in zip(f["b"], f["salt"], f["r"], f["c"], f["v"], f["n"], f["f"], f["m"], strict=True):
                    to, of = (np.frombuffer(x, np.int32) for x in ((r, c) if by_rows else (c, r)))
                    g, v = _floats(g, k), np.frombuffer(v, np.float64)
                    if m is not None:
                        g = g * np.frombuffer(m, np.float64)
                    yield pd.DataFrame({"b": [b], "salt": [salt], "cross": [_bytes(np.stack([np.bincount(to, v * g[j][of], n) for j in range(k)]))]})

        def add(f: pd.DataFrame) -> pd.DataFrame:
            total = _floats(f["cross"].iloc[0], k).copy()
            for x in f["cross"].iloc[1:]:
                total += _floats(x, k)
            return pd.DataFrame({"b": [f["b"].iloc[0]], "salt": [f["salt"].iloc[0]], "cross": [_bytes(total)]})

        wide = self.x.join(factor.withColumnRenamed("b", there), there).select(F.col(here).alias("b"), F.pmod(F.xxhash64(there), F.lit(64)).cast("bigint").alias("salt"), "r", "c", "v", F.col("n_r" if by_rows else "n_c").alias("n"), "f", "m")
        form = "b bigint, salt bigint, cross binary"
        parts = wide.mapInPandas(times, form).groupBy("b", "salt").applyInPandas(add, form)
        return parts.groupBy("b").applyInPandas(add, form).drop("salt")

    def sums(self, factor: DataFrame, k: int, of) -> np.ndarray:
        """The sum over all blocks of the small array that ``of`` makes of (f, m)."""

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for g, m in zip(f["f"], f["m"], strict=True):
                    x = np.asarray(of(_floats(g, k), 1.0 if m is None else np.frombuffer(m, np.float64)), float).ravel()
                    yield pd.DataFrame({"i": np.arange(len(x)), "x": x})

        found = factor.select("f", "m").mapInPandas(each, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
        return found["x"].to_numpy()

    def gram(self, factor: DataFrame, k: int) -> np.ndarray:
        return self.sums(factor, k, lambda f, m: (f * m) @ f.T).reshape(k, k)

    def turned(self, factor: DataFrame, k: int, turn: np.ndarray) -> DataFrame:
        """``turn`` (any number by k) times the factor."""

        def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(f=[_bytes(turn @ _floats(g, k)) for g in f["f"]])

        return factor.mapInPandas(apply, "b bigint, f binary, m binary")

    def singular(self, k: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
        """Left and right singular vectors of the k largest values, and these, by subspace iteration."""
        q = k + self.params.extra
        empty = F.lit(None).cast("binary").alias("m")

        def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"b": f["b"], "f": [_bytes(np.random.default_rng((7, int(b))).random((q, int(n)))) for b, n in zip(f["b"], f["n"], strict=True)], "m": None})

        right, last = self.columns.mapInPandas(seed, "b bigint, f binary, m binary"), None
        right = stored(right, "right")
        for turns_left in reversed(range(max(1, self.params.turns))):
            values, vectors = np.linalg.eigh(self.gram(right, q))
            good = values > 1e-14 * max(values[-1], 1e-300)
            right = stored(self.turned(right, q, (vectors[:, good] / np.sqrt(values[good])).T), "right")
            q = int(good.sum())
            left = stored(self.product(right, q, True).withColumnRenamed("cross", "f").join(self.rows.select("b", "m"), "b").select("b", "f", "m"), "left")
            squares, turn = np.linalg.eigh(self.gram(left, q))
            found = np.sqrt(np.maximum(squares[::-1], 0))
            if not turns_left or (last is not None and len(last) == len(found) and np.abs(found[:k] - last[:k]).max() <= 1e-12 * found[0]):
                break
            last = found
            right = stored(self.product(left, q, False).select("b", F.col("cross").alias("f"), empty), "right")
        turn = turn[:, ::-1].T[:k]
        s = found[:k]
        back = np.where(s > 1e-7 * s[0], 1 / np.maximum(s, 1e-300), 0.0)
        return stored(self.turned(left, q, turn * back[:, None]), "left"), stored(self.turned(right, q, turn), "right"), np.where(back > 0, s, 0.0)

    def start(self, k: int) -> tuple[DataFrame, DataFrame]:
        left, right, s = self.singular(k)
        n = len(s)
        norms = [self.sums(x, n, lambda f, m: np.stack([(np.maximum(f, 0) ** 2 * m).sum(1), (np.maximum(-f, 0) ** 2 * m).sum(1)])).reshape(2, n) for x in (left, right)]

        def begin(at: int):
            def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    rows = []
                    for g in f["f"]:
                        g = _floats(g, n)
                        out = np.zeros((k, g.shape[1]))
                        for j in range(n):
                            plus, minus = ((norms[0][i][j], norms[1][i][j]) for i in (0, 1))
                            out[j] = side(j, g[j], g[j], s[j], plus, minus)[at]
                        rows.append(_bytes(out))
                    yield f.assign(f=rows)

            return make

        return tuple(stored(x.mapInPandas(begin(i), "b bigint, f binary, m binary"), "start") for i, x in enumerate((left, right)))

    def updated(self, factor: DataFrame, other: DataFrame, k: int, by_rows: bool) -> tuple[DataFrame, float]:
        gram = self.gram(other, k)

        def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows, moved = [], []
                for g, m, cross in zip(f["f"], f["m"], f["cross"], strict=True):
                    a = _floats(g, k).copy()
                    moved.append(coordinates(a, gram, _floats(cross, k), None if m is None else np.frombuffer(m, np.float64)))
                    rows.append(_bytes(a))
                yield pd.DataFrame({"b": f["b"], "f": rows, "m": f["m"], "moved": moved})

        new = stored(factor.join(self.product(other, k, by_rows), "b").mapInPandas(move, "b bigint, f binary, m binary, moved double"), "factor")
        return new, new.agg(F.sum("moved")).first()[0]

    def fit(self, k: int, max_iter: int) -> tuple[DataFrame, DataFrame]:
        """Both factors: of rows (b, f, m) and of columns."""
        spark, mark, first = self.x.sparkSession, made(), None
        w, h = self.start(k)
        drop_since(spark, mark, (w, h))
        for _ in range(max_iter):
            w, a = self.updated(w, h, k, True)
            h, b = self.updated(h, w, k, False)
            drop_since(spark, mark, (w, h))
            first = a + b if first is None else first
            if first == 0 or (a + b) / first <= self.params.tol:
                break
        return w, h


def _sparse(a: np.ndarray) -> bytes:
    """A factor's rows as a bit for each weight and the positive ones."""
    some = a > 0
    return np.packbits(some).tobytes() + a[some].tobytes()


def _dense(x: pa.Buffer, k: int, n: int) -> np.ndarray:
    some = np.unpackbits(np.frombuffer(x, np.uint8, -(-k * n // 8)), count=k * n).view(bool)
    a = np.zeros(k * n)
    a[some] = np.frombuffer(x, np.float64, offset=-(-k * n // 8))
    return a.reshape(k, n)


def _small(x: np.ndarray) -> bytes:
    """Numbers in the first of four kinds that holds all of them exactly, behind the kind's name."""
    with np.errstate(all="ignore"):
        kind = next((t for t in "BHf" if np.array_equal(x.astype(t), x)), "d")
    return kind.encode().ljust(8) + x.astype(kind).tobytes()


def _wide(x: pa.Buffer) -> np.ndarray:
    return np.frombuffer(x, chr(x[0]), offset=8)


class Tall:
    """A table with few tags in blocks of whole rows (b, n, ids, m, t, c, v, w): ``t`` is how many entries each row has, ``w`` has the block's rows of one factor for each K. ``ids`` are not taken along from round to round."""

    FORM = "b bigint, n bigint, m binary, t binary, c binary, v binary, w array<binary>, sums binary"
    #: Cells of a slice of a block, few enough for a processor's cache.
    CELLS = 1 << 17
    #: A row holds megabytes: pages and row groups are looked at after each one, not after a hundred.
    OPTIONS = {"compression": "none", "parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}

    def __init__(self, patterns: DataFrame, n_blocks: int, tag_names: list[str]):
        """``patterns`` (pattern, tags, m, first), each with at least one tag."""

        def block(b: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, m, tags = (table[x].combine_chunks() for x in ("pattern", "m", "tags"))
            tags, ids = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (tags, ids))
            name, v = tags.flatten().flatten()
            c = pc.index_in(name, value_set=pa.array(tag_names).cast(name.type)).to_numpy()
            parts = (b"".join(ids.to_pylist()), _small(m.to_numpy()), _small(pc.list_value_length(tags).to_numpy()), _small(c), _small(v.to_numpy()))
            return pa.record_batch([pa.array([b]), pa.array([len(table)]), *(pa.array([x], pa.binary()) for x in parts)], names=["b", "n", "ids", "m", "t", "c", "v"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                rb = batch.column("rb").to_numpy()
                for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(rb)) + 1), len(rb)]):
                    if i < j:
                        if held and rb[i] != now:
                            yield block(now, held)
                            held = []
                        now = int(rb[i])
                        held.append(batch.slice(i, j - i))
            if held:
                yield block(now, held)

        self.tags, self.spark = len(tag_names), patterns.sparkSession
        dealt = patterns.select(F.pmod(F.xxhash64("first"), F.lit(n_blocks)).cast("bigint").alias("rb"), "first", "pattern", "m", "tags").repartition(n_blocks, "rb").sortWithinPartitions("rb", "first")
        self.x = stored(dealt.mapInArrow(pack, "b bigint, n bigint, ids binary, m binary, t binary, c binary, v binary"), "entries", **self.OPTIONS)

    @classmethod
    def slices(cls, batch: pa.RecordBatch, i: int, n_tags: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Places, whole rows and multiplicities of one slice of a block (row ``i`` of a batch) after the other."""
        m, t, c, v = (_wide(batch.column(x)[i].as_buffer()) for x in "mtcv")
        at = np.append(0, np.cumsum(t, dtype=np.int64))
        step = max(16, cls.CELLS // n_tags)
        for a in range(0, len(m), step):
            own = slice(a, min(a + step, len(m)))
            few = slice(at[own.start], at[own.stop])
            x = np.zeros((own.stop - own.start, n_tags))
            x[np.repeat(np.arange(len(x)), t[own]), c[few]] = v[few]
            yield own, x, m[own].astype(float)

    def added(self, size: int, of) -> np.ndarray:
        """The sum of the array of ``size`` numbers that ``of`` makes of (x, m) over all slices; one row from each task."""
        n_tags = self.tags

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, first = np.zeros(size), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    first = first or batch.column("b")[i].as_py() + 1
                    for _, x, m in Tall.slices(batch, i, n_tags):
                        total += np.asarray(of(x, m)).ravel()
            yield pa.record_batch([pa.array([-first]), pa.array([total.tobytes()], pa.binary())], names=["b", "sums"])

        return self.total(self.x.select("b", "m", "t", "c", "v").mapInArrow(add, "b bigint, sums binary"), size)

    @staticmethod
    def total(df: DataFrame, size: int) -> np.ndarray:
        """The tasks' sums (b, sums) added up in one order; one row comes to the driver."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                for x in batch.column(0):
                    out += np.frombuffer(x.as_buffer(), np.float64)
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        return np.frombuffer(df.select("b", "sums").repartition(1).sortWithinPartitions("b").select("sums").mapInArrow(add, "sums binary").first()[0], np.float64).copy()

    def fit(self, ks: list[int], max_iter: int, tol: float) -> dict[int, tuple[DataFrame, np.ndarray]]:
        """For each K the factor of rows (b, n, w) and that of tags (k by tags)."""
        n_tags, q = self.tags, max(ks)
        squares, vectors = np.linalg.eigh(self.added(n_tags * n_tags, lambda x, m: (x.T * m) @ x).reshape(n_tags, n_tags))
        s, v = np.sqrt(np.maximum(squares[::-1][:q], 0)), vectors[:, ::-1].T[:q]
        s = np.where(s > 1e-7 * s[0], s, 0.0)
        good = np.flatnonzero(s)
        turn = v[good] / s[good, None]

        def parts(x: np.ndarray, m: np.ndarray | float) -> np.ndarray:
            return np.stack([(np.maximum(x, 0) ** 2 * m).sum(1), (np.maximum(-x, 0) ** 2 * m).sum(1)])

        of_rows = self.added(2 * len(good), lambda x, m: parts(turn @ x.T, m)).reshape(2, -1)
        of_tags = parts(v[good], 1.0)
        norms = [tuple((of_rows[i][g], of_tags[i][g]) for i in (0, 1)) for g in range(len(good))]

        def begin(k: int, x: np.ndarray) -> np.ndarray:
            u, a = turn @ x.T, np.zeros((k, len(x)))
            for g, j in enumerate(good):
                if j < k:
                    a[j] = side(j, u[g], v[j], s[j], *norms[g])[0]
            return a

        hs = {k: np.zeros((k, n_tags)) for k in ks}
        for k, h in hs.items():
            for g, j in enumerate(good):
                if j < k:
                    h[j] = side(j, v[j], v[j], s[j], *norms[g])[1]
        state, first, found, mark = self.x.drop("ids"), {}, {}, made()
        for turn_no in range(max_iter):
            now = list(hs)

            def move(batches: Iterator[pa.RecordBatch], now=now, hs=dict(hs), fresh=not turn_no) -> Iterator[pa.RecordBatch]:
                grams = {k: hs[k] @ hs[k].T for k in now}
                sums = {k: (np.zeros((k, k)), np.zeros((k, n_tags))) for k in now}
                moved, first_b = dict.fromkeys(now, 0.0), 0
                names, lists = ["b", "n", "m", "t", "c", "v", "w", "sums"], pa.list_(pa.binary())
                for batch in batches:
                    for i in range(batch.num_rows):
                        n = batch.column("n")[i].as_py()
                        first_b = first_b or batch.column("b")[i].as_py() + 1
                        before = None if fresh else batch.column("w")[i].values
                        factors = {k: np.zeros((k, n)) if fresh else _dense(before[j].as_buffer(), k, n) for j, k in enumerate(now)}
                        for own, x, m in Tall.slices(batch, i, n_tags):
                            for k in now:
                                a = begin(k, x) if fresh else np.ascontiguousarray(factors[k][:, own])
                                moved[k] += coordinates(a, grams[k], hs[k] @ x.T, m)
                                factors[k][:, own] = a
                                heavy = a * m
                                sums[k][0][:] += heavy @ a.T
                                sums[k][1][:] += heavy @ x
                        kept = [batch.column(x).slice(i, 1) for x in names[:6]]
                        yield pa.record_batch([*kept, pa.array([[_sparse(factors[k]) for k in now]], lists), pa.nulls(1, pa.binary())], names=names)
                flat = np.concatenate([np.concatenate([[moved[k]], sums[k][0].ravel(), sums[k][1].ravel()]) for k in now])
                yield pa.record_batch([pa.array([-1 - first_b]), pa.array([0]), *(pa.nulls(1, pa.binary()) for _ in "mtcv"), pa.nulls(1, lists), pa.array([flat.tobytes()], pa.binary())], names=names)

            new = stored(state.mapInArrow(move, self.FORM), "factor", **self.OPTIONS)
            sizes = [1 + k * k + k * n_tags for k in now]
            sums = np.split(self.total(new.where("b < 0"), sum(sizes)), np.cumsum(sizes)[:-1])
            state = new.where("b >= 0")
            for i, (k, flat) in enumerate(zip(now, sums, strict=True)):
                moved = flat[0] + coordinates(hs[k], flat[1 : 1 + k * k].reshape(k, k), flat[1 + k * k :].reshape(k, n_tags))
                first.setdefault(k, moved)
                if first[k] == 0 or moved / first[k] <= tol or turn_no + 1 == max_iter:
                    found[k] = stored(state.select("b", "n", F.get("w", F.lit(i)).alias("w")), "factor", **self.OPTIONS), hs.pop(k)
            if not hs:
                break
            if len(hs) < len(now):
                state = state.withColumn("w", F.array(*(F.get("w", F.lit(i)) for i, k in enumerate(now) if k in hs)))
            drop_since(self.spark, mark, (new, *(w for w, _ in found.values())))
        drop_since(self.spark, mark, tuple(w for w, _ in found.values()))
        return found

    def rows(self, factors: dict[int, DataFrame]) -> DataFrame:
        """pattern, places, weights of every row: its positive weights, and where they are among the topics of all K in turn."""
        ks = list(factors)

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = 1 << 13
            for batch in batches:
                for i in range(batch.num_rows):
                    n = batch.column("n")[i].as_py()
                    ids, a = batch.column("ids")[i].as_py(), np.concatenate([_dense(batch.column(f"w{k}")[i].as_buffer(), k, n) for k in ks])
                    wide = len(ids) // n
                    for at in range(0, n, step):
                        own = np.ascontiguousarray(a[:, at : at + step].T)
                        row, j = np.nonzero(own)
                        ends = pa.array(np.searchsorted(row, np.arange(len(own) + 1)), pa.int32())
                        lists = (pa.ListArray.from_arrays(ends, pa.array(y)) for y in (j.astype(np.int32), own[row, j]))
                        names = pa.array([ids[x * wide : (x + 1) * wide] for x in range(at, at + len(own))], pa.binary())
                        yield pa.record_batch([names, *lists], names=["pattern", "places", "weights"])

        wide = self.x.select("b", "n", "ids")
        for k, w in factors.items():
            wide = wide.join(w.select("b", F.col("w").alias(f"w{k}")), "b")
        return wide.mapInArrow(flat, "pattern binary, places array<int>, weights array<double>")


def factor_table(tags: DataFrame, k_grid: tuple[int, ...], max_iter: int, params: FactorParams = FactorParams()) -> DataFrame:
    """k, part ('doc' or 'tag'), topic, name, weight of all positive weights of the factors of ``tags`` (doc, tag, weight) for every K between 1 and the shorter side.

    Rows of one document and tag add up; a null document, tag or weight takes no part.
    """
    spark = tags.sparkSession
    if tags.schema["doc"].dataType.typeName() not in ("long", "integer"):  # others could be alike as text only
        tags = tags.withColumn("doc", F.col("doc").cast("string"))
    clean = tags.where("doc is not null and tag is not null and weight is not null").groupBy("doc", F.col("tag").cast("string").alias("tag")).agg(F.sum("weight").cast("double").alias("v"))
    listed = clean.repartition("doc").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("tag", "v"))).alias("tags"))
    per_doc = stored(listed.select(F.col("doc").cast("string").alias("doc"), "tags", F.unhex(F.sha2(F.to_json("tags"), 256)).alias("pattern")), "docs")
    patterns = per_doc.groupBy("pattern").agg(F.first("tags").alias("tags"), F.count("*").cast("double").alias("m"), F.min("doc").alias("first"))
    patterns = stored(patterns, "patterns")
    names = stored(patterns.select(F.explode("tags.tag").alias("tag")).distinct(), "names")
    n_docs, (n_patterns, n_tags) = per_doc.count(), (patterns.count(), names.count())
    ks = [k for k in k_grid if 1 <= k <= min(n_docs, n_tags)]
    form = "k bigint, part string, topic bigint, name string, weight double"
    if not ks:
        return spark.createDataFrame([], form)
    whole = n_patterns * n_tags <= params.cells
    n_rb, n_cb = (1, 1) if whole else (-(-n_patterns // params.rows), -(-n_tags // params.columns))

    def placed(df: DataFrame, key: str, n: int, b: str, at: str) -> DataFrame:
        """Rows with a block and a place in it, in the order of ``key``."""
        dealt = df.withColumn(b, F.pmod(F.xxhash64(key), F.lit(n)).cast("bigint"))
        return stored(dealt.withColumn(at, (F.row_number().over(Window.partitionBy(b).orderBy(key)) - 1).cast("int")), "placed")

    if not whole and n_cb == 1 and n_tags <= params.narrow:
        tag_names = [r["tag"] for r in names.orderBy("tag").collect()]
        tall = Tall(patterns, n_rb, tag_names)
        fitted = tall.fit(ks, max_iter, params.tol)
        of_tags = spark.createDataFrame([(k, "tag", int(j), tag_names[c], float(h[j, c])) for k, (_, h) in fitted.items() for j, c in zip(*np.nonzero(h), strict=True)], form)
        # A row per document until here; the weights are opened after the join.
        joined = tall.rows({k: w for k, (w, _) in fitted.items()}).join(per_doc.select("pattern", "doc"), "pattern").select("doc", F.explode(F.arrays_zip("places", "weights")).alias("e"))
        k_of, topic_of = (F.get(F.array(*(F.lit(x).cast("bigint") for x in xs)), F.col("e.places")) for xs in zip(*((k, j) for k in fitted for j in range(k)), strict=True))
        return joined.select(k_of.alias("k"), F.lit("doc").alias("part"), topic_of.alias("topic"), F.col("doc").alias("name"), F.col("e.weights").alias("weight")).unionByName(of_tags)
    rows, columns = placed(patterns, "first", n_rb, "rb", "r"), placed(names, "tag", n_cb, "cb", "c")
    entries = rows.select("rb", "r", "m", F.explode("tags").alias("e")).select("rb", "r", "m", F.col("e.tag").alias("tag"), F.col("e.v").alias("v")).join(columns, "tag")
    if whole:

        def fit(f: pd.DataFrame) -> pd.DataFrame:
            x, m = np.zeros((n_patterns, n_tags)), np.zeros(n_patterns)
            x[f["r"], f["c"]], m[f["r"]] = f["v"], f["m"]
            k = int(f["k"].iloc[0])
            w, h = nmf(x, k, max_iter, params.tol, m)
            out = []
            for part, a in (("doc", w.T), ("tag", h)):
                topic, at = np.nonzero(a)
                out.append(pd.DataFrame({"k": k, "part": part, "b": 0, "at": at, "topic": topic, "weight": a[topic, at]}))
            return pd.concat(out)

        grid = entries.select("r", "c", "v", "m", F.explode(F.array(*map(F.lit, ks))).alias("k"))
        found = stored(grid.groupBy("k").applyInPandas(fit, "k bigint, part string, b bigint, at int, topic bigint, weight double"), "factors")
    else:
        packed = rows.groupBy("rb").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("r", "m"))), lambda s: s["m"]).alias("ms"))

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"b": f["rb"], "n": f["n"], "m": [_bytes(np.array(x)) for x in f["ms"]]})

        blocks = Blocks(entries.select("rb", "r", "cb", "c", "v"), stored(packed.mapInPandas(pack, "b bigint, n bigint, m binary"), "rows"), stored(columns.groupBy(F.col("cb").alias("b")).agg(F.count("*").alias("n")), "columns"), params)
        found = None
        for k in ks:
            for part, factor in zip(("doc", "tag"), blocks.fit(k, max_iter), strict=True):

                def flat(frames: Iterator[pd.DataFrame], k=k) -> Iterator[pd.DataFrame]:
                    for f in frames:
                        for b, g in zip(f["b"], f["f"], strict=True):
                            a = _floats(g, k)
                            topic, at = np.nonzero(a)
                            yield pd.DataFrame({"b": b, "at": at, "topic": topic, "weight": a[topic, at]})

                own = factor.select("b", "f").mapInPandas(flat, "b bigint, at int, topic bigint, weight double").select(F.lit(k).cast("bigint").alias("k"), F.lit(part).alias("part"), "b", "at", "topic", "weight")
                found = own if found is None else found.unionByName(own)
    of_tags = found.where("part = 'tag'").join(columns.select(F.col("cb").alias("b"), F.col("c").alias("at"), F.col("tag").alias("name")), ["b", "at"])
    of_docs = found.where("part = 'doc'").join(rows.select(F.col("rb").alias("b"), F.col("r").alias("at"), "pattern"), ["b", "at"]).join(per_doc.select("pattern", F.col("doc").alias("name")), "pattern")
    return of_docs.select("k", "part", "topic", "name", "weight").unionByName(of_tags.select("k", "part", "topic", "name", "weight"))
