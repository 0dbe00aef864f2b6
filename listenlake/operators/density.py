"""Density clusters of tables of any size: blocked neighbour search, a spanning forest by rounds, and a condensed tree by bands of edges.

1. Equal vectors become one site with its multiplicity. Sites are dealt to blocks by a
   k-d tree that is fitted on a bounded sample; a block has about ``block`` sites, so
   work on one block or on two never holds more than that.
2. The core distance of a site is the distance within which ``min_samples`` vectors lie,
   itself included. A block's own sites bound it; a site is sent to those other blocks
   only whose box is nearer than its bound.
3. Least spanning edges under mutual reachability (the larger of both core distances and
   the distance; site numbers break ties, so the tree is unique). A block first makes the
   tree of its own sites, which holds the least edge of any of their components to the
   others, and joins what it can prove alone: the least edge of a component counts if it
   is shorter than the way out of the block. Then every component picks its least edge in
   each round: from the trees of its own blocks, and by sending those of its sites to
   another block that its best edge so far lets reach the box there, where they are
   compared cell by cell with the sites near them; at least half of the components go
   each time.
4. Edges are taken shortest first in bands of ``band`` edges. A component that reaches
   ``min_cluster_size`` becomes a node of the condensed tree, smaller ones fall from the
   node they join, and where two nodes meet both end and their masses are compared. What
   goes from band to band is one row for each component that a band touches.
5. Chosen nodes without a chosen ancestor are the clusters; the whole set is none.

A vector that is null, or has a null, NaN or infinite part, takes no part and is in no
row of the result; in a table with fewer than ``min_cluster_size`` others all are noise.
Ids (any type that sorts; they may repeat or be null) only name and order sites. An
empty table gives no rows.

The driver holds boxes and summaries of blocks, of which there are at most twice
``leaves``, and the sample; a task holds one block and what some 64 others send to it, whose
distances are made in slices of ``CELLS``, or one band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listenlake.shared import drop_since, made, stored


@dataclass(frozen=True)
class DensityParams:
    """``sample``: sites that the tree of blocks is fitted on. ``leaves``: blocks it makes at most; larger tables get larger blocks. ``small``: components that are joined in one task."""

    block: int = 1024
    sample: int = 1 << 15
    leaves: int = 1 << 14
    small: int = 1 << 18
    band: int = 1 << 19


#: Distances made at once.
CELLS = 1 << 22
#: Sites that are compared with those around them at once.
CELL = 64


def row_slices(n: int, columns: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, columns))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances; the same number for a pair whichever side it is on."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - y[None, :, j]) ** 2
    return np.sqrt(total)


def box_distance(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distances from the box [low, high] to each of the others; a hair less than that, for rounding."""
    gap = np.maximum(0.0, np.maximum(lows - high, low - highs))
    return np.sqrt((gap * gap).sum(-1)) * (1 - 1e-12)


def split_tree(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, cut, left, right) of a k-d tree; a child below 0 is leaf -1 - child."""
    nodes, n_leaves = [], 0

    def grow(part: np.ndarray, wanted: int) -> int:
        nonlocal n_leaves
        wide = part.max(0) - part.min(0) if len(part) else np.zeros(x.shape[1])
        d = int(wide.argmax())
        cut = float(np.median(part[:, d])) if len(part) else 0.0
        left = part[:, d] <= cut if len(part) else np.zeros(0, bool)
        if wanted < 2 or wide[d] == 0 or left.all():
            n_leaves += 1
            return -n_leaves
        me = len(nodes)
        nodes.append((0, 0.0, 0, 0))
        nodes[me] = (d, cut, grow(part[left], wanted // 2), grow(part[~left], wanted - wanted // 2))
        return me

    root = grow(x, leaves)
    return nodes if root >= 0 else []


def leaf_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    dim, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(1),) * 4
    while (at >= 0).any():
        own = np.flatnonzero(at >= 0)
        n = at[own]
        at[own] = np.where(x[own, dim[n].astype(int)] <= cut[n], left[n], right[n])
    return -1 - at


def _pack(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _open(x: bytes, kind, dims: int | None = None) -> np.ndarray:
    out = np.frombuffer(x, kind)
    return out if dims is None else out.reshape(-1, dims)


def blocks_of(sites: DataFrame, dims: int, n: int, params: DensityParams) -> DataFrame:
    """One row per block: block, nums, ms, xs (packed, by ascending number)."""
    leaves = min(params.leaves, max(1, n // params.block))
    sample = np.array([r[0] for r in sites.orderBy(F.xxhash64("num"), "num").limit(params.sample).select("x").collect()]).reshape(-1, dims)
    nodes = split_tree(sample, leaves)
    most = max(params.block, n // leaves)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=leaf_of(np.array(f["x"].to_list()).reshape(-1, dims), nodes))

    dealt = sites.mapInPandas(deal, "num bigint, m bigint, x array<double>, leaf bigint")
    # What the sample did not foresee: a leaf with too many sites is parted by their numbers.
    parts = F.broadcast(dealt.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")))
    block = F.struct("leaf", F.pmod(F.xxhash64("num"), "parts").alias("part"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("num")
        x = np.array(rows["x"].to_list()).reshape(-1, dims)
        return pd.DataFrame({"block": [int(rows["leaf"].iloc[0]) << 24 | int(rows["part"].iloc[0])], "nums": [_pack(rows["num"], np.int64)], "ms": [_pack(rows["m"], np.int64)], "xs": [_pack(x, np.float64)]})

    wide = dealt.join(parts, "leaf").select("num", "m", "x", block.alias("b")).select("num", "m", "x", "b.leaf", "b.part")
    return stored(wide.repartition(min(leaves, 512), "leaf", "part").groupBy("leaf", "part").applyInPandas(pack, "block bigint, nums binary, ms binary, xs binary"), "blocks")


def spread(df: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of blocks in a fixed number of partitions: they are few and small and would be coalesced to a task or two, the work on each is not."""
    return df.repartition(min(n_blocks, 512, max(64, n_blocks // 4)), "block")


def _boxes(packed: DataFrame, dims: int) -> pd.DataFrame:
    """block, low, high of all blocks; their number is bounded by DensityParams."""

    def box(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = [_open(v, np.float64, dims) for v in f["xs"]]
            yield pd.DataFrame({"block": f["block"], "low": [list(v.min(0)) for v in x], "high": [list(v.max(0)) for v in x]})

    return packed.select("block", "xs").mapInPandas(box, "block bigint, low array<double>, high array<double>").toPandas().sort_values("block", ignore_index=True)


class Near:
    """The boxes of all blocks, and which of them the sites of one block reach."""

    def __init__(self, boxes: pd.DataFrame, dims: int, pure: np.ndarray | None = None, least: np.ndarray | None = None):
        """By the rows of ``boxes``: ``pure`` is the component of a block that has no other (or -1), ``least`` its least core distance."""
        self.blocks, self.lows, self.highs = boxes["block"].to_numpy(), np.array(boxes["low"].to_list()).reshape(-1, dims), np.array(boxes["high"].to_list()).reshape(-1, dims)
        self.pure, self.least = pure, least

    def reached(self, block: int, x: np.ndarray, upto: np.ndarray, comps: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Other blocks and the places of those sites for which they may hold one no farther than ``upto``."""
        sites, others = [], []
        # Sites of like bounds look at boxes together, so that few far ones don't lead all of the block to every other.
        levels = np.where(np.isinf(upto), 1 << 20, np.frexp(upto)[1])
        for level in np.unique(levels):
            own = np.flatnonzero(levels == level)
            good = box_distance(x[own].min(0), x[own].max(0), self.lows, self.highs) <= upto[own].max()
            if self.least is not None:
                good &= self.least <= upto[own].max()
            good[int(np.searchsorted(self.blocks, block))] = False
            near = np.flatnonzero(good)
            for part in row_slices(len(own), len(near) * x.shape[1]):
                i = own[part]
                gap = np.maximum(0.0, np.maximum(self.lows[near] - x[i, None], x[i, None] - self.highs[near]))
                use = np.sqrt((gap * gap).sum(2)) * (1 - 1e-12) <= upto[i, None]
                if comps is not None:
                    use &= (comps[i, None] != self.pure[near]) & (upto[i, None] >= self.least[near])
                at, to = np.nonzero(use)
                sites.append(i[at])
                others.append(near[to])
        if sites:
            sites, others = np.concatenate(sites), np.concatenate(others)
            by = np.lexsort((sites, others))
            names, first = np.unique(others[by], return_index=True)
            for other, some in zip(names, np.split(sites[by], first)[1:], strict=True):
                yield int(self.blocks[other]), some


def around(y: np.ndarray, x: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Places of the sites ``y`` that may lie within ``upto`` of one of ``x``."""
    return np.flatnonzero(box_distance(x.min(0), x.max(0), y, y) <= upto.max())


def cells_of(x: np.ndarray) -> Iterator[np.ndarray]:
    """Places of sites that lie together, at most ``CELL`` at a time."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= CELL:
            if len(own):
                yield own
            continue
        part, half = x[own], len(own) // 2
        by = own[np.argpartition(part[:, int((part.max(0) - part.min(0)).argmax())], half)]
        todo += [by[half:], by[:half]]


def received(sent: DataFrame, packed: DataFrame, n_blocks: int, find, form: str) -> DataFrame:
    """``find`` (what was sent, one row of ``packed``) for every block and about 64 of the blocks that sent to it."""
    parts = 1 + n_blocks // 64
    n, keys = min(n_blocks * parts, 512), ("other", "part")
    left = stored(sent.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")), "sent")
    # A block is copied only to those parts that have sites for it.
    right = packed.withColumnRenamed("block", "other").join(left.select(*(F.col(c).alias(c) for c in keys)).distinct(), "other")
    # A fixed number of partitions: rows are few and small, the work between them is not.
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInPandas(find, form)


def _joined(parts: pd.Series, kind, dims: int | None = None) -> np.ndarray:
    return _open(b"".join(parts), kind, dims)


def core_distances(packed: DataFrame, boxes: pd.DataFrame, dims: int, k: int) -> DataFrame:
    """``packed`` with cores: the distance of every site within which ``k`` vectors lie."""

    def nearest(x: np.ndarray, y: np.ndarray, ms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, counts = [], []
        for part in row_slices(len(x), len(y)):
            far = distances(x[part], y)
            at = np.argpartition(far, k - 1, axis=1)[:, :k] if len(y) > k else np.tile(np.arange(len(y)), (len(far), 1))
            near.append(np.take_along_axis(far, at, 1))
            counts.append(ms[at])
        return np.concatenate(near), np.concatenate(counts)

    def within(near: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The distance within which k vectors lie, or infinity."""
        by = near.argsort(1)
        near, total = np.take_along_axis(near, by, 1), np.take_along_axis(count, by, 1).cumsum(1)
        first = (total >= k).argmax(1)
        return np.where(total[:, -1] >= k, np.take_along_axis(near, first[:, None], 1)[:, 0], np.inf)

    form = "block bigint, num bigint, near array<double>, counts array<bigint>"

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b, nums, ms, xs in zip(f["block"], f["nums"], f["ms"], f["xs"], strict=True):
                x = _open(xs, np.float64, dims)
                near, count = nearest(x, x, _open(ms, np.int64))
                yield pd.DataFrame({"block": b, "num": _open(nums, np.int64), "near": list(near), "counts": list(count), "upto": within(near, count)})

    first = stored(spread(packed, len(boxes)).mapInPandas(own, f"{form}, upto double"), "near")
    found = first.drop("upto")
    if len(boxes) > 1:
        upto = first.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "upto"))), lambda r: r["upto"]).alias("uptos"))

        def away(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near = Near(boxes, dims)
            for f in frames:
                for b, nums, xs, bounds in zip(f["block"], f["nums"], f["xs"], f["uptos"], strict=True):
                    nums, x, bounds = _open(nums, np.int64), _open(xs, np.float64, dims), np.array(bounds)
                    rows = [(b, other, _pack(nums[some], np.int64), _pack(x[some], np.float64), _pack(bounds[some], np.float64)) for other, some in near.reached(b, x, bounds)]
                    yield pd.DataFrame(rows, columns=["block", "other", "sent", "sent_xs", "sent_upto"])

        def more(sent: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"block": [], "num": [], "near": [], "counts": []}, dtype=object)
            if not len(sent) or not len(block):
                return none
            x, bounds = _joined(sent["sent_xs"], np.float64, dims), _joined(sent["sent_upto"], np.float64)
            own = np.repeat(sent["block"].to_numpy(), [len(v) // 8 for v in sent["sent"]])
            y, ms = _open(block["xs"].iloc[0], np.float64, dims), _open(block["ms"].iloc[0], np.int64)
            nums, found = _joined(sent["sent"], np.int64), []
            for cell in cells_of(x):
                there = around(y, x[cell], bounds[cell])
                if len(there):
                    near, count = nearest(x[cell], y[there], ms[there])
                    use = near <= bounds[cell, None]
                    found.extend((own[cell[i]], nums[cell[i]], near[i][use[i]], count[i][use[i]]) for i in np.flatnonzero(use.any(1)))
            return pd.DataFrame(found, columns=["block", "num", "near", "counts"]) if found else none

        sent = spread(packed.select("block", "nums", "xs").join(upto, "block"), len(boxes)).mapInPandas(away, "block bigint, other bigint, sent binary, sent_xs binary, sent_upto binary")
        found = found.unionByName(received(sent, packed.select("block", "ms", "xs"), len(boxes), more, form))
    each = found.groupBy("block", "num").agg(F.flatten(F.collect_list(F.arrays_zip("near", "counts"))).alias("near"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).cast("double").alias("d"))
    core = F.aggregate(F.array_sort("near"), zero, lambda a, v: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + v["counts"]).alias("n"), v["near"].alias("d"))))
    cores = each.select("block", "num", core["d"].alias("core")).groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "core"))), lambda r: r["core"]).alias("cores"))
    return stored(packed.join(cores, "block"), "cores")


def least_edges(comp: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray, other: np.ndarray) -> pd.DataFrame:
    """The first edge by weight, lower and higher number of every component."""
    by = np.lexsort((high, low, w, comp))
    by = by[np.append(True, comp[by][1:] != comp[by][:-1])] if len(by) else by
    return pd.DataFrame({"comp": comp[by], "w": w[by], "lo": low[by], "hi": high[by], "other": other[by]})


def outgoing(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], upto: np.ndarray | None = None) -> pd.DataFrame:
    """The least edge of every component of ``left`` to another one in ``right``; both are (x, cores, nums, comps), ``right`` by ascending number. Edges longer than ``upto`` of their site need not be found."""
    upto = np.full(len(left[0]), np.inf) if upto is None else upto
    (x, core, nums, comps), (y, core_, nums_, comps_) = left, right
    found = []
    for cell in cells_of(x):
        there = around(y, x[cell], upto[cell])
        there = there[core_[there] <= upto[cell].max()]
        for part in row_slices(len(cell), len(there)) if len(there) else ():
            i = cell[part]
            reach = np.maximum(distances(x[i], y[there]), np.maximum(core[i, None], core_[there]))
            reach[comps[i, None] == comps_[there]] = np.inf
            to = reach.argmin(1)  # the first of equal ones has the least number, which makes the least edge
            w = reach[np.arange(len(to)), to]
            some = np.flatnonzero(np.isfinite(w))
            a, b = nums[i[some]], nums_[there[to[some]]]
            found.append((comps[i[some]], np.minimum(a, b), np.maximum(a, b), w[some], comps_[there[to[some]]]))
    return least_edges(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else least_edges(*(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, float, np.int64)))


def own_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w, a, b (places) of the least spanning tree of the sites of a block; these are by ascending number."""
    n = len(x)
    ws, a, b = np.zeros(n - 1), np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    # Of the sites that are not in the tree: their place, the least way to it, and the place there.
    left, way, to, new = np.arange(1, n), np.full(n - 1, np.inf), np.full(n - 1, n), 0
    y, core_ = x[1:].copy(), core[1:].copy()
    for k in range(n - 1):
        reach = np.maximum(distances(x[new : new + 1], y)[0], np.maximum(core[new], core_))
        less = (reach < way) | ((reach == way) & (new < to))
        way, to = np.where(less, reach, way), np.where(less, new, to)
        at = np.flatnonzero(way == way.min())
        at = at[np.lexsort((np.maximum(left[at], to[at]), np.minimum(left[at], to[at])))[0]] if len(at) > 1 else at[0]
        new = left[at]
        ws[k], a[k], b[k] = way[at], min(new, to[at]), max(new, to[at])
        for z in (left, way, to, y, core_):
            z[at] = z[-1]
        left, way, to, y, core_ = (z[:-1] for z in (left, way, to, y, core_))
    return ws, a, b


def out_of_tree(comps: np.ndarray, nums: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    """The least edge of every component of a block to another one there, from the block's tree."""
    w, a, b = tree
    some = np.flatnonzero((comps[a] != comps[b]) & np.isfinite(w))
    w, a, b = w[some], a[some], b[some]
    return least_edges(np.append(comps[a], comps[b]), np.append(nums[a], nums[a]), np.append(nums[b], nums[b]), np.append(w, w), np.append(comps[b], comps[a]))


def contracted(comp: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The root of every component, where each has picked ``other``: the smaller of the two that picked each other."""
    names, flat = np.unique(np.concatenate([comp, other]), return_inverse=True)
    a, b = flat[: len(comp)], flat[len(comp) :]
    up = np.arange(len(names))
    up[a] = b
    both = up[up] == np.arange(len(names))
    up = np.where(both & (np.arange(len(names)) < up), np.arange(len(names)), up)
    while True:
        new = up[up]
        if (new == up).all():
            return names[up[a]]
        up = new


def local_forest(packed: DataFrame, boxes: pd.DataFrame, dims: int) -> DataFrame:
    """Packed comps of every block after the joins it can prove alone, packed edges (ws, los, his) of these, and its own tree (tree_w, tree_a, tree_b)."""
    lows, highs, blocks = np.array(boxes["low"].to_list()).reshape(-1, dims), np.array(boxes["high"].to_list()).reshape(-1, dims), boxes["block"].to_numpy()

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b, nums, xs, cores in zip(f["block"], f["nums"], f["xs"], f["cores"], strict=True):
                nums, x, core = _open(nums, np.int64), _open(xs, np.float64, dims), np.array(cores)
                others = np.flatnonzero(blocks != b)
                out = np.full(len(x), np.inf)
                for a in range(0, len(others), 256):
                    own = others[a : a + 256]
                    gap = np.maximum(0.0, np.maximum(lows[own] - x[:, None], x[:, None] - highs[own]))
                    out = np.minimum(out, np.sqrt((gap * gap).sum(2)).min(1) * (1 - 1e-12))
                out = np.maximum(out, core)
                comp, edges, tree = nums.copy(), [], own_tree(x, core)
                while True:
                    best = out_of_tree(comp, nums, tree)
                    at, n = np.unique(comp, return_inverse=True)
                    way = np.full(len(at), np.inf)
                    np.minimum.at(way, n, out)
                    best = best[best["w"].to_numpy() < way[np.searchsorted(at, best["comp"].to_numpy())]] if len(others) else best
                    if not len(best):
                        break
                    edges.append(best.drop_duplicates(["lo", "hi"]))
                    root = dict(zip(best["comp"].tolist(), contracted(best["comp"].to_numpy(), best["other"].to_numpy()).tolist(), strict=True))
                    comp = np.array([root.get(c, c) for c in at.tolist()])[n]
                found = pd.concat(edges) if edges else pd.DataFrame({"w": [], "lo": [], "hi": []})
                yield pd.DataFrame({"block": [b], "comps": [_pack(comp, np.int64)], "ws": [_pack(found["w"], np.float64)], "los": [_pack(found["lo"], np.int64)], "his": [_pack(found["hi"], np.int64)], "tree_w": [_pack(tree[0], np.float64)], "tree_a": [_pack(tree[1], np.int64)], "tree_b": [_pack(tree[2], np.int64)]})

    return stored(spread(packed, len(boxes)).mapInPandas(grow, "block bigint, comps binary, ws binary, los binary, his binary, tree_w binary, tree_a binary, tree_b binary"), "forest")


EDGES = "comp bigint, w double, lo bigint, hi bigint, other bigint"


def roots(picked: DataFrame, small: int) -> DataFrame:
    """comp, root of edges (comp, other) in which every component picks one; two that pick each other are one root."""
    if picked.count() <= small:

        def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = pd.concat([*frames, pd.DataFrame({"comp": [], "other": []}, dtype=np.int64)])
            yield pd.DataFrame({"comp": f["comp"], "root": contracted(f["comp"].to_numpy(), f["other"].to_numpy()) if len(f) else []})

        return stored(picked.select("comp", "other").repartition(1).mapInPandas(join, "comp bigint, root bigint"), "roots")
    back = picked.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    # A component that picks none (it has been reached by others only) is its own root.
    up = stored(picked.select("comp", "other").join(back, "other", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root")), "roots")
    while True:
        step = up.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        new = stored(up.join(step, "root", "left").select("comp", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "roots")
        moved = new.agg(F.count_if("moved")).first()[0]
        up = new.drop("moved")
        if not moved:
            return up


def spanning_edges(packed: DataFrame, boxes: pd.DataFrame, dims: int, params: DensityParams) -> DataFrame:
    """w, lo, hi of the least spanning tree of all sites."""
    spark = packed.sparkSession
    grown = local_forest(packed, boxes, dims)

    def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ws, los, his in zip(f["ws"], f["los"], f["his"], strict=True):
                yield pd.DataFrame({"w": _open(ws, np.float64), "lo": _open(los, np.int64), "hi": _open(his, np.int64)})

    edges = grown.select("ws", "los", "his").mapInPandas(flat, "w double, lo bigint, hi bigint")
    state, trees = grown.select("block", "comps"), grown.select("block", "tree_w", "tree_a", "tree_b")
    while len(boxes) > 1:
        whole = packed.select("block", "nums", "xs", "cores").join(state, "block")

        def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for b, nums, xs, cores, comps, w, low, high in zip(*(f[c] for c in ("block", "nums", "xs", "cores", "comps", "tree_w", "tree_a", "tree_b")), strict=True):
                    nums, x, core, comps = _open(nums, np.int64), _open(xs, np.float64, dims), np.array(cores), _open(comps, np.int64)
                    names = np.unique(comps)
                    best = out_of_tree(comps, nums, (_open(w, np.float64), _open(low, np.int64), _open(high, np.int64)))
                    left = pd.DataFrame({"comp": names}).merge(best, "left", on="comp").fillna({"w": np.inf, "lo": -1, "hi": -1, "other": -1})
                    yield left.assign(block=b, pure=names[0] if len(names) == 1 else -1, least=core.min(), rep=[list(x[0])] * len(left), rep_core=core[0], rep_comp=comps[0]).astype({"lo": np.int64, "hi": np.int64, "other": np.int64})

        first = stored(spread(whole.join(trees, "block"), len(boxes)).mapInPandas(own, f"block bigint, {EDGES}, pure bigint, least double, rep array<double>, rep_core double, rep_comp bigint"), "own")
        upto = first.groupBy("comp").agg(F.min("w").alias("upto"))
        facts = first.join(upto, "comp").groupBy("block").agg(F.max("upto").alias("need"), F.first("pure").alias("pure"), F.first("least").alias("least"), F.first("rep").alias("rep"), F.first("rep_core").alias("rep_core"), F.first("rep_comp").alias("rep_comp")).toPandas().sort_values("block", ignore_index=True)
        if facts["pure"].nunique() == 1 and facts["pure"].iloc[0] >= 0:
            return edges
        rep, rep_core, rep_comp = np.array(facts["rep"].to_list()).reshape(-1, dims), facts["rep_core"].to_numpy(), facts["rep_comp"].to_numpy()

        def bounded(frames: Iterator[pd.DataFrame], rep=rep, rep_core=rep_core, rep_comp=rep_comp, blocks=facts["block"].to_numpy()) -> Iterator[pd.DataFrame]:
            """A block of one component without any edge is bound by the nearest site that stands for a block of another."""
            for f in frames:
                need = f["need"].to_numpy().copy()
                for k in np.flatnonzero(np.isinf(need)):
                    i = int(np.searchsorted(blocks, f["block"].iloc[k]))
                    far = np.maximum(distances(rep[i : i + 1], rep)[0], np.maximum(rep_core, rep_core[i]))
                    need[k] = np.where(rep_comp != rep_comp[i], far, np.inf).min()
                yield pd.DataFrame({"block": f["block"], "need": need})

        table = spark.createDataFrame(facts[["block", "need"]]).mapInPandas(bounded, "block bigint, need double").withColumnRenamed("need", "bound")
        # The bound of every component of a block; a block's own where the component has no edge yet.
        bounds = first.select("block", "comp").join(upto, "comp").join(F.broadcast(table), "block").select("block", "comp", F.when(F.col("upto") < float("inf"), F.col("upto")).otherwise(F.col("bound")).alias("upto"))
        bounds = bounds.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("comp", "upto"))).alias("b")).select("block", F.col("b.comp").alias("names"), F.col("b.upto").alias("uptos"))

        def away(frames: Iterator[pd.DataFrame], pure=facts["pure"].to_numpy(), least=facts["least"].to_numpy()) -> Iterator[pd.DataFrame]:
            near = Near(boxes, dims, pure, least)
            for f in frames:
                for b, nums, xs, cores, comps, names, uptos in zip(*(f[c] for c in ("block", "nums", "xs", "cores", "comps", "names", "uptos")), strict=True):
                    nums, x, core, comps = _open(nums, np.int64), _open(xs, np.float64, dims), np.array(cores), _open(comps, np.int64)
                    most = np.array(uptos)[np.searchsorted(np.array(names), comps)]
                    own = np.flatnonzero(core <= most)
                    if not len(own):
                        continue
                    nums, x, core, comps, most = nums[own], x[own], core[own], comps[own], most[own]
                    rows = [(b, other, _pack(x[some], np.float64), _pack(core[some], np.float64), _pack(nums[some], np.int64), _pack(comps[some], np.int64), _pack(most[some], np.float64)) for other, some in near.reached(b, x, most, comps)]
                    yield pd.DataFrame(rows, columns=["block", "other", "sent_xs", "sent_cores", "sent_nums", "sent_comps", "sent_upto"])

        def across(sent: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"comp": [], "w": [], "lo": [], "hi": [], "other": []}, dtype=object)
            if not len(sent) or not len(block):
                return none
            left = _joined(sent["sent_xs"], np.float64, dims), _joined(sent["sent_cores"], np.float64), _joined(sent["sent_nums"], np.int64), _joined(sent["sent_comps"], np.int64)
            most = _joined(sent["sent_upto"], np.float64)
            y, core, nums, comps = _open(block["xs"].iloc[0], np.float64, dims), np.array(block["cores"].iloc[0]), _open(block["nums"].iloc[0], np.int64), _open(block["comps"].iloc[0], np.int64)
            return outgoing(left, (y, core, nums, comps), most)

        sent = spread(whole.join(bounds, "block"), len(boxes)).mapInPandas(away, "block bigint, other bigint, sent_xs binary, sent_cores binary, sent_nums binary, sent_comps binary, sent_upto binary")
        found = first.where("lo >= 0").select("comp", "w", "lo", "hi", "other").unionByName(received(sent, whole, len(boxes), across, EDGES))
        picked = stored(found.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*"), "picked")
        edges = edges.unionByName(picked.select("w", "lo", "hi").distinct())
        top = roots(picked, params.small)

        def open_comps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for b, comps in zip(f["block"], f["comps"], strict=True):
                    comps = _open(comps, np.int64)
                    yield pd.DataFrame({"block": b, "at": np.arange(len(comps)), "comp": comps})

        moved = state.mapInPandas(open_comps, "block bigint, at bigint, comp bigint").join(top, "comp", "left").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("root", "comp").alias("comp")))), lambda r: r["comp"]).alias("comps"))

        def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"block": f["block"], "comps": [_pack(np.array(c), np.int64) for c in f["comps"]]})

        state = stored(moved.mapInPandas(close, "block bigint, comps binary"), "comps")
    return edges


class Bands:
    """What the condensed tree keeps of a component: size, node (-1 while it is small) and the node's sums: how many fell at once (infinite lambda), lambda and number of the others, mass of the nodes below."""

    KEPT = "size bigint, node bigint, n_inf bigint, total double, n bigint, below double"
    FORM = f"kind string, comp bigint, root bigint, lam double, chosen boolean, {KEPT}"

    @staticmethod
    def mass(kept: list, birth: float) -> float:
        """The mass of a node that begins at ``birth``."""
        _, _, n_inf, total, n, _ = kept
        if np.isinf(birth):
            return 0.0
        return np.inf if n_inf else max(0.0, total - n * birth)

    @classmethod
    def join(cls, rows: pd.DataFrame, number: int, least: int) -> list[tuple]:
        """Take the edges of a band in their order. Rows: 'comp' (a component and what it is now), 'fell' (a small component, its lambda and node), 'node' (a node, the one above it, and whether its mass is no less than those below)."""
        up, kept, small, out, made = {}, {}, {}, [], 0

        def top(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        def fall(k: list, members: list[int], lam: float, size: int) -> None:
            if np.isinf(lam):
                k[2] += size
            else:
                k[3] += lam * size
                k[4] += size
            out.extend(("fell", c, -1, lam, None, 0, k[1], 0, 0.0, 0, 0.0) for c in members)

        for side in ("a", "b"):
            for row in rows[[side, *(f"{side}_{c.split()[0]}" for c in cls.KEPT.split(", "))]].drop_duplicates(side).itertuples(index=False):
                if row[0] not in kept:
                    up[row[0]], kept[row[0]] = row[0], [*row[1:]]
                    small[row[0]] = [row[0]] if row[2] == -1 else []
        for w, a, b in zip(rows["w"].tolist(), rows["a"].tolist(), rows["b"].tolist(), strict=True):
            a, b, lam = top(a), top(b), 1 / w if w > 0 else np.inf
            if kept[a][0] < kept[b][0]:
                a, b = b, a
            x, y = kept[a], kept[b]
            up[b] = a
            size = x[0] + y[0]
            if x[1] != -1 and y[1] != -1:
                made += 1
                node, fresh = (number << 40) + made, [size, 0, 0, 0.0, 0, 0.0]
                for k in (x, y):
                    own = cls.mass(k, lam)
                    out.append(("node", k[1], node, lam, bool(k[5] <= own), 0, 0, 0, 0.0, 0, 0.0))
                    fresh[5] += max(own, k[5])
                    if np.isinf(lam):
                        fresh[2] += k[0]
                    else:
                        fresh[3] += lam * k[0]
                        fresh[4] += k[0]
                fresh[1] = node
                kept[a] = fresh
                continue
            if x[1] == -1 and y[1] == -1:
                if size < least:
                    x[0] = size
                    small[a] = small[a] + small[b] if len(small[a]) < len(small[b]) else small[a] + small[b]
                    continue
                made += 1
                x[1] = (number << 40) + made
                fall(x, small[a], lam, x[0])
                small[a] = []
            fall(x, small[b], lam, y[0])
            kept[a], small[a] = [size, *x[1:]], []
        for c in list(up):
            root = top(c)
            out.append(("comp", c, root, None, None, *kept[root]))
        return out


def condensed(edges: DataFrame, sites: DataFrame, least: int, params: DensityParams) -> tuple[DataFrame, DataFrame]:
    """num, node, lam of every site (node -1 if it fell from none) and node, above, chosen of every node that has one above."""
    spark = edges.sparkSession
    lam = F.when(F.col("core") > 0, 1 / F.col("core")).otherwise(float("inf"))
    born = F.col("m") >= least
    zero, none = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    # A site of many equal vectors is whole at its core distance, before any edge leaves it.
    node = F.when(born, -2 - F.col("num")).otherwise(none)
    inf = F.col("core") == 0
    state = stored(sites.select(F.col("num").alias("comp"), F.col("m").alias("size"), node.alias("node"), F.when(born & inf, F.col("m")).otherwise(zero).alias("n_inf"), F.when(born & ~inf, lam * F.col("m")).otherwise(0.0).alias("total"), F.when(born & ~inf, F.col("m")).otherwise(zero).alias("n"), F.lit(0.0).cast("double").alias("below")), "state")
    held = stored(sites.select("num", F.col("num").alias("comp"), node.alias("node"), F.when(born, lam).alias("lam")), "held")
    n_edges = edges.count()
    n_bands = max(1, -(-n_edges // params.band))
    if n_bands > 1:
        # The place of every edge in the order: its place in a sorted partition and the edges before that.
        ordered = stored(edges.repartitionByRange(min(n_bands, 1000), "w", "lo", "hi").sortWithinPartitions("w", "lo", "hi").select("w", "lo", "hi", F.monotonically_increasing_id().alias("at")), "ordered")
        part = F.shiftright("at", 33).cast("bigint")
        ahead = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
        start, before = 0, {}
        for p in sorted(ahead):
            before[p] = start
            start += ahead[p]
        offset = F.create_map(*(F.lit(v).cast("bigint") for pair in before.items() for v in pair))[part]
        place = offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        edges = stored(ordered.withColumn("band", F.floor(place / params.band)).select("w", "lo", "hi", "band"), "bands")
    else:
        edges = edges.withColumn("band", zero)
    nodes = spark.createDataFrame([], "node bigint, above bigint, chosen boolean")
    kept = [c.split()[0] for c in Bands.KEPT.split(", ")]
    for number in range(n_bands):
        comp = held.select("num", "comp")
        band = edges.where(F.col("band") == number).join(comp.select(F.col("num").alias("lo"), F.col("comp").alias("a")), "lo").join(comp.select(F.col("num").alias("hi"), F.col("comp").alias("b")), "hi")
        for side in ("a", "b"):
            band = band.join(state.select(F.col("comp").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in kept)), side)

        def join(frames: Iterator[pd.DataFrame], number=number + 1) -> Iterator[pd.DataFrame]:
            whole = [f for f in frames if len(f)]
            rows = Bands.join(pd.concat(whole), number, least) if whole else []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in Bands.FORM.split(", ")])

        said = stored(band.repartition(1).sortWithinPartitions("w", "lo", "hi").mapInPandas(join, Bands.FORM), "band")
        nodes = nodes.unionByName(said.where("kind = 'node'").select(F.col("comp").alias("node"), F.col("root").alias("above"), "chosen"))
        moved = said.where("kind = 'comp'").select("comp", "root", *kept)
        fell = said.where("kind = 'fell'").select("comp", F.col("node").alias("new_node"), F.col("lam").alias("new_lam"))
        held = stored(held.join(moved.select("comp", "root"), "comp", "left").join(fell, "comp", "left").select("num", F.coalesce("root", "comp").alias("comp"), F.when(F.col("node") == -1, F.coalesce("new_node", "node")).otherwise(F.col("node")).alias("node"), F.coalesce("lam", "new_lam").alias("lam")), "held")
        if number + 1 < n_bands:
            state = stored(state.join(moved.select("comp"), "comp", "left_anti").unionByName(moved.where("comp = root").drop("root")), "state")
    return held.drop("comp"), nodes


def chosen_above(nodes: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """node, best: the highest chosen node at or above it, by doubling the way up; none for the top."""
    own = all_nodes.join(nodes, "node", "left").select("node", "above", F.when(F.coalesce("chosen", F.lit(False)), F.col("node")).alias("best"))
    state = stored(own, "up")
    while state.where("above is not null").limit(1).count():
        step = state.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("best").alias("higher"))
        state = stored(state.join(step, "above", "left").select("node", F.col("next").alias("above"), F.coalesce("higher", "best").alias("best")), "up")
    return state.select("node", "best")


def finite(x: str) -> Column:
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def density_clusters(points: DataFrame, min_cluster_size: int, min_samples: int, params: DensityParams = DensityParams()) -> DataFrame:
    """x, cluster (-1 for noise; numbered by least id) and strength of the distinct vectors of ``points`` (id, x of one length)."""
    least, mark = max(2, min_cluster_size), made()
    clean = points.where(finite("x")).select("id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x"))
    by_site = clean.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    # Numbers in the order of ids: partitions of a sort by range are numbered in turn.
    sites = stored(by_site.repartitionByRange("id", "x").sortWithinPartitions("id", "x").select(F.monotonically_increasing_id().alias("num"), "id", "m", "x"), "sites")
    total, n, dims = sites.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count("*"), F.max(F.size("x"))).first()
    none = F.lit(-1).cast("bigint")
    if total < least:
        return sites.select("x", none.alias("cluster"), F.lit(0.0).cast("double").alias("strength"))
    packed = blocks_of(sites.select("num", "m", "x"), dims, n, params)
    boxes = _boxes(packed, dims)
    packed = core_distances(packed, boxes, dims, min(min_samples, total))

    def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for nums, ms, cores in zip(f["nums"], f["ms"], f["cores"], strict=True):
                yield pd.DataFrame({"num": _open(nums, np.int64), "m": _open(ms, np.int64), "core": np.array(cores)})

    facts = packed.select("nums", "ms", "cores").mapInPandas(flat, "num bigint, m bigint, core double")
    held, nodes = condensed(stored(spanning_edges(packed, boxes, dims, params), "edges"), facts, least, params)
    every = held.where("node <> -1").select("node").unionByName(nodes.select("node")).unionByName(nodes.select(F.col("above").alias("node"))).distinct()
    labelled = stored(sites.join(held, "num").join(chosen_above(nodes, every), "node", "left").select("id", "x", "best", "lam"), "labelled")
    # A row per cluster, of which there is at most one in min_cluster_size vectors.
    names = labelled.where("best is not null").groupBy("best").agg(F.max("lam").alias("peak"), F.min("id").alias("first"))
    names = names.withColumn("cluster", (F.row_number().over(Window.orderBy("first", "best")) - 1).cast("bigint"))
    top = F.col("lam") == F.col("peak")
    strength = F.when(F.col("best").isNull(), 0.0).when(F.col("peak") == float("inf"), F.when(top, 1.0).otherwise(0.0)).otherwise(F.least("lam", "peak") / F.col("peak"))
    out = stored(labelled.join(names, "best", "left").select("x", F.coalesce("cluster", none).alias("cluster"), strength.alias("strength")), "density")
    drop_since(points.sparkSession, mark, (out,))
    return out
