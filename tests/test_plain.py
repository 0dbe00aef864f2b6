"""The queries that SQL does not express, over their whole tables, against plain versions."""

import collections
import glob
import os

import duckdb
import numpy as np
import pytest

from listenlake import catalog
from listenlake.operators import density, epochs, scene
from listenlake.params import AudioParams
from listenlake.views import MEMBERS, PLAYS, RECORDS, doc_tags

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain_epochs(times, codes, window, step, limit):
    """low, high, p, events and the two most frequent codes of every epoch; events ascend."""
    start, end, points = times[0], times[-1], []
    last = start
    for at in range(start + step, end, step):
        left, right = codes[(times >= at - window) & (times < at)], codes[(times >= at) & (times < at + window)]
        if min(len(left), len(right)) < 5:
            continue
        d = max(abs((left <= c).mean() - (right <= c).mean()) for c in set(left) | set(right))
        p = epochs.kolmogorov_sf(d, max(1, round(len(left) * len(right) / (len(left) + len(right)))))
        if p < limit and at - last >= window:
            points.append((at, p))
            last = at
    bounds = [start, *(a for a, _ in points), end]
    out = []
    for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        inside = codes[(times >= low) & ((times < high) if i < len(points) else (times <= high))]
        seen = collections.Counter(inside[inside > 0].tolist())
        top = sorted(seen, key=lambda c: (-seen[c], c))[:2]
        out.append((f"e-{i + 1}", low, high, round(points[i][1], 6) if i < len(points) else None, len(inside), ",".join(map(str, top))))
    return out


def test_epoch_detection(spark, con):
    rows = con.execute(f"WITH {PLAYS}, {MEMBERS}, {catalog.CODES.format(plays='plays')} SELECT t, code FROM coded ORDER BY t").fetchall()
    times, codes = (np.array(c) for c in zip(*rows, strict=True))
    day = 86_400_000_000
    want = plain_epochs(times, codes, 5 * day, day, 0.2)
    got = sorted(catalog.queries()["epoch_detection"](spark, SF).collect(), key=lambda r: r["low"])
    assert [(r["epoch_id"], r["low"], r["high"], r["p_value"] and round(r["p_value"], 6), r["n_events"], r["dominant"]) for r in got] == want


def test_scene_topics_stand_still(spark, con):
    """No K leaves anything that plain multiplicative updates of the dense matrix would still gain."""
    said = doc_tags(spark, SF).collect()
    docs, names = sorted({str(r["doc"]) for r in said}), sorted({r["tag"] for r in said})
    x = np.zeros((len(docs), len(names)))
    for r in said:
        x[docs.index(str(r["doc"])), names.index(r["tag"])] = r["weight"]
    parts = collections.defaultdict(dict)
    found = scene.factor(doc_tags(spark, SF).selectExpr("cast(doc AS string) AS doc", "tag", "weight")).collect()
    for r in found:
        parts[r["k"]][r["part"], r["topic"], r["name"]] = r["weight"]
    assert set(parts) == {3, 5, 8, 13}
    shown = {(r["k"], r["part"], r["topic"], r["name"]): r["weight"] for r in catalog.queries()["scene_topics"](spark, SF).collect()}
    errors = []
    for k, weights in sorted(parts.items()):
        w, h = np.zeros((len(docs), k)), np.zeros((k, len(names)))
        for (part, topic, name), v in weights.items():
            assert v > 0 and abs(shown[k, part, topic, name] - v) < 1e-3
            if part == "doc":
                w[docs.index(name), topic] = v
            else:
                h[topic, names.index(name)] = v
        before = ((x - w @ h) ** 2).sum()
        for _ in range(50):
            h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
            w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
        assert before - ((x - w @ h) ** 2).sum() < 0.01 * before
        errors.append(before)
    assert errors == sorted(errors, reverse=True) and errors[-1] < (x**2).sum()


def reach(x, samples):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(far, axis=1)[:, samples - 1]
    return np.maximum(far, np.maximum(core[:, None], core[None]))


def plain_clusters(far, least):
    """The clusters as sets: every height of the full reachability graph is cut, and masses are summed from the cuts."""
    n = len(far)

    def pieces(points, height):
        left, out = set(points), []
        while left:
            edge, seen = [left.pop()], set()
            while edge:
                p = edge.pop()
                seen.add(p)
                near = {q for q in left if far[p, q] < height}
                left -= near
                edge += near
            out.append(frozenset(seen))
        return out

    heights = sorted({far[i, j] for i, j in plain_tree(far)}, reverse=True)

    def best(points, birth, level):
        """Mass and chosen clusters of the cluster ``points`` that begins at 1 / height ``birth``."""
        mass, inside = 0.0, points
        for at in range(level, len(heights)):
            lam, parts = 1 / heights[at], pieces(inside, heights[at])
            big = [p for p in parts if len(p) >= least]
            if len(big) == 1:
                mass += (lam - birth) * (len(inside) - len(big[0]))
                inside = big[0]
                continue
            mass += (lam - birth) * len(inside)
            below = [best(p, lam, at + 1) for p in big]
            if below and sum(m for m, _ in below) > mass:
                return sum(m for m, _ in below), [c for _, cs in below for c in cs]
            return (mass, [points]) if birth else (0.0, [c for _, cs in below for c in cs])
        return mass, [points] if birth else []

    return set(best(frozenset(range(n)), 0.0, 0)[1])


def plain_tree(far):
    """The edges of a minimum spanning tree, shortest first."""
    group, out = list(range(len(far))), []
    for i, j in sorted(zip(*np.triu_indices(len(far), 1), strict=True), key=lambda e: far[e]):
        if group[i] != group[j]:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
            out.append((i, j))
    return out


def assert_same_clusters(label, far, least):
    """Clusters agree; only a point that is as near to one cluster as to another, at the height where they part, may be in one of them or in none."""
    found, want = [frozenset(np.flatnonzero(label == c).tolist()) for c in sorted(set(label) - {-1})], plain_clusters(far, least)
    heights = collections.Counter(far[i, j] for i, j in plain_tree(far))
    assert len(found) == len(want)
    for cluster in found:
        (own,) = [w for w in want if w <= cluster]
        assert all(heights[min(far[p, q] for q in own)] > 1 for p in cluster - own)


@pytest.mark.parametrize("seed", range(2))
def test_clusters_are_the_plain_ones(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(rng.normal(0, 2, 3), rng.uniform(0.1, 0.6), (rng.integers(5, 40), 3)) for _ in range(5)])
    found = density.density_clusters(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id bigint, x array<double>"), 8, 4)
    label = {tuple(r["x"]): r["cluster"] for r in found.collect()}
    assert_same_clusters(np.array([label[tuple(p)] for p in x]), reach(x, 4), 8)


def test_audio_clusters(spark, con):
    dims = AudioParams().cluster_features
    rows = con.execute(f"WITH {RECORDS} SELECT track_id, {', '.join(dims)} FROM records WHERE {' AND '.join(f'{d} IS NOT NULL' for d in dims)} ORDER BY track_id").fetchall()
    ids, x = [r[0] for r in rows], np.array([r[1:] for r in rows], float)
    got = {r["track_id"]: r["found"] for r in catalog.queries()["audio_clusters"](spark, SF).collect()}
    assert sorted(got) == ids
    assert_same_clusters(np.array([got[t] for t in ids]), reach((x - x.mean(0)) / x.std(0), 5), 20)
