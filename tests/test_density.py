"""Density clusters over blocks, rounds and bands against one plain tree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listenlake.operators import density
from listenlake.operators.density import DensityParams, density_clusters


def plain(x, least, samples):
    """Labels and strengths: all edges by (weight, not equal, lower, higher place), one union-find, a condensed tree."""
    n = len(x)
    label, strength = np.full(n, -1), np.zeros(n)
    if n < least:
        return label, strength
    far = np.sqrt(sum((x[:, j, None] - x[None, :, j]) ** 2 for j in range(x.shape[1])))
    core = np.sort(far, 1)[:, min(samples, n) - 1]
    reach = np.maximum(far, np.maximum(core[:, None], core[None]))
    edges = sorted((reach[i, j], far[i, j] > 0, i, j) for i in range(n) for j in range(i + 1, n))
    top, members = list(range(n)), {i: [i] for i in range(n)}
    node, above, lam_of, mass, below, fallen = {}, {}, {}, {}, {}, {}
    for w, _, i, j in edges:
        a, b = top[i], top[j]
        if a == b:
            continue
        lam = 1 / w if w else np.inf
        big = [c for c in (a, b) if c in node]
        both = members[a] + members[b]
        if len(big) == 2:
            new = len(mass)
            mass[new], below[new], fallen[new] = 0.0, 0.0, [lam] * len(both)
            for c in big:
                v = node.pop(c)
                mass[v] = 0.0 if np.isinf(lam) else sum(x - lam for x in fallen[v])
                above[v] = new
                below[new] += max(mass[v], below[v])
        else:
            if big:
                new = node.pop(big[0])
                small = members[b if big[0] == a else a]
            elif len(both) >= least:
                new, small = len(mass), both
                mass[new], below[new], fallen[new] = 0.0, 0.0, []
            else:
                new, small = None, []
            for p in small:
                lam_of[p], label[p] = lam, new
                fallen[new].append(lam)
        for p in members.pop(b):
            top[p] = a
        members[a] = both
        if new is not None:
            node[a] = new
    chosen = {v for v in above if below[v] <= mass[v] + 1e-12 * abs(mass[v])}
    best = {}
    for v in mass:
        way, u = [v], v
        while u in above:
            u = above[u]
            way.append(u)
        best[v] = next((u for u in reversed(way) if u in chosen), None)
    found = [best[v] if v >= 0 else None for v in label.tolist()]
    peak = {}
    for p, v in enumerate(found):
        if v is not None:
            peak[v] = max(peak.get(v, 0), lam_of[p])
    names = {}
    for p, v in enumerate(found):
        label[p] = -1 if v is None else names.setdefault(v, len(names))
        strength[p] = 0.0 if v is None else (1.0 if lam_of[p] == peak[v] else 0.0) if np.isinf(peak[v]) else lam_of[p] / peak[v]
    return label, strength


def data(seed, n=160):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.normal(0, 2, 3), rng.uniform(0.1, 0.6), (n // 5, 3)) for _ in range(4)]
    x = np.vstack([*parts, rng.uniform(-4, 4, (n // 10, 3))])
    if seed % 2:  # ties and equal vectors
        x = np.round(x * 2) / 2
    return np.vstack([x, x[: n // 8], np.tile(x[:1], (n // 6, 1))]) if seed % 3 else x


@pytest.mark.parametrize(("seed", "params"), [(0, DensityParams()), (1, DensityParams()), (0, DensityParams(block=16)), (1, DensityParams(block=12, sample=60)), (2, DensityParams(block=20, small=0)), (3, DensityParams(block=30, band=17)), (4, DensityParams(block=8, sample=20, leaves=8, band=40))])
def test_clusters_are_the_plain_ones(spark, seed, params):
    x = data(seed)
    least, samples = 8, 4
    want, strength = plain(x, least, samples)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    got = {tuple(r["x"]): (r["cluster"], r["strength"]) for r in density_clusters(df.repartition(3), least, samples, params).collect()}
    assert [got[tuple(v + 0.0)][0] for v in x] == want.tolist()
    assert np.allclose([got[tuple(v + 0.0)][1] for v in x], strength)
    assert len(set(want)) > 2


def test_slices_make_no_difference(spark, monkeypatch):
    x = data(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    want = sorted(map(tuple, density_clusters(df, 8, 4, DensityParams(block=40)).collect()))
    monkeypatch.setattr(density, "CELLS", 50)
    left = (x[:20], np.zeros(20), np.arange(20), np.arange(20) // 7)
    right = (x[20:60], np.zeros(40), np.arange(20, 60), np.arange(20, 60) // 7)
    few = density.outgoing(left, right)
    monkeypatch.undo()
    assert few.equals(density.outgoing(left, right)) and len(want) == len({tuple(v) for v in x})


def test_odd_points(spark):
    schema = "id string, x array<double>"
    assert density_clusters(spark.createDataFrame([], schema), 5, 2).count() == 0
    few = spark.createDataFrame([("a", [1.0]), (None, [2.0]), ("c", None), ("d", [None]), ("e", [float("nan")]), ("f", [float("inf")])], schema)
    assert sorted(map(tuple, density_clusters(few, 5, 2).collect())) == [([1.0], -1, 0.0), ([2.0], -1, 0.0)]
    same = spark.range(50).select(F.lit("a").alias("id"), F.array(F.lit(-0.0) * F.col("id")).alias("x"))
    assert sorted(map(tuple, density_clusters(same, 5, 2).collect())) == [([0.0], -1, 0.0)]
    two = spark.range(50).select(F.col("id").cast("string"), F.array((F.col("id") % 2).cast("double")).alias("x"))
    assert sorted(map(tuple, density_clusters(two, 5, 2).collect())) == [([0.0], 0, 1.0), ([1.0], 1, 1.0)]


def test_sites_go_only_to_blocks_that_they_reach():
    """A far site's wide bound no longer makes its whole block meet all others."""
    rng = np.random.default_rng(2)
    grid = np.array([(i, j) for i in range(12) for j in range(12)], float) * 10
    cells = [g + rng.random((50, 2)) for g in grid]
    cells[0] = np.vstack([cells[0], [[-500.0, -500.0]]])
    boxes = pd.DataFrame({"block": range(len(cells)), "low": [c.min(0).tolist() for c in cells], "high": [c.max(0).tolist() for c in cells]})
    near = density.Near(boxes, 2)
    for i in (0, 70):
        upto = np.full(len(cells[i]), 0.5)
        upto[-1] = 5000.0 if i == 0 else 0.5
        sent = dict(near.reached(i, cells[i], upto))
        for other, y in enumerate(cells):
            if other != i:
                must = np.flatnonzero((density.distances(cells[i], y) <= upto[:, None]).any(1))
                assert set(must) <= set(sent.get(other, []))
        assert sum(map(len, sent.values())) == (143 if i == 0 else 0)
    x, y = cells[0][:5], np.vstack(cells)
    kept = density.around(y, x, np.full(5, 9.5))
    assert set(np.flatnonzero((density.distances(y, x) <= 9.5).any(1))) <= set(kept) and len(kept) < len(y) / 4


def test_blocks_of_small_tables_meet_in_many_tasks(spark):
    """The tables between blocks are small and were coalesced to a task or two, which did all the work of profile_summary and audio_clusters."""
    sent = spark.range(130).selectExpr("id AS block", "(id * 7) % 130 AS other", "id AS sent")
    packed = spark.range(130).selectExpr("id AS block", "id + 1 AS held")

    def find(sent, block):
        return pd.DataFrame({"sent": sent["sent"], "held": block["held"].iloc[0]} if len(sent) else {"sent": [], "held": []}, dtype=object)

    met = density.received(sent, packed, 130, find, "sent bigint, held bigint")
    assert met.rdd.getNumPartitions() == 390
    assert sorted((r["sent"], r["held"]) for r in met.collect()) == [(i, i * 7 % 130 + 1) for i in range(130)]


def test_a_blocks_own_tree_holds_the_least_edges_of_all_components():
    for seed in range(4):
        x = np.unique(data(seed), axis=0)
        rng = np.random.default_rng(seed)
        core, nums = np.round(rng.random(len(x)) / 2, 1), np.sort(rng.choice(10_000, len(x), replace=False))
        tree = density.own_tree(x, core)
        assert len(tree[0]) == len(x) - 1
        for n in (1, 2, 7, 60, len(x)):
            comps = nums[rng.integers(0, n, len(x))]
            side = (x, core, nums, comps)
            assert density.out_of_tree(comps, nums, tree).equals(density.outgoing(side, side))


def test_sites_sent_are_compared_only_with_those_around_them(monkeypatch):
    """All that was sent to a block met all sites there within the box of it all, which is most of the block."""
    rng = np.random.default_rng(5)
    y, made = rng.random((2000, 3)), []
    x = np.vstack([rng.random((500, 3)) - [1, 0, 0], rng.random((500, 3)) + [1, 0, 0]])
    left = (x, np.zeros(1000), np.arange(2000, 3000), np.arange(2000, 3000))
    right = (y, np.zeros(2000), np.arange(2000), np.zeros(2000, np.int64))
    want = density.outgoing(left, right)
    whole = density.distances
    monkeypatch.setattr(density, "distances", lambda a, b: made.append(len(a) * len(b)) or whole(a, b))
    few = density.outgoing(left, right, np.full(1000, 0.1))
    near = want[want["w"] <= 0.1]
    assert len(near) and few.merge(near).equals(near.reset_index(drop=True))
    assert sum(made) < 1000 * 2000 / 10


def test_a_block_is_copied_only_where_sites_are_sent_to_it(spark):
    sent = spark.range(130).selectExpr("id AS block", "id % 10 AS other", "id AS sent")
    packed = spark.range(130).selectExpr("id AS block", "id AS held")

    def find(sent, block):
        return pd.DataFrame({"n_sent": [len(sent)], "n_blocks": [len(block)]})

    met = density.received(sent, packed, 130, find, "n_sent bigint, n_blocks bigint").collect()
    assert sum(r["n_sent"] for r in met) == 130
    assert len(met) <= 30 and {r["n_blocks"] for r in met} == {1}
