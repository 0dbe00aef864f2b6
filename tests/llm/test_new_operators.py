"""Periodic runs, the quality classifier and centroid clustering against plain versions, on whole tables and odd rows."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listenlake.llm import centroids, classifier, oracles, periods, queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def plain_runs(w, least):
    """Every stretch with a period that nothing extends, by trying all periods."""
    n, found = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q)):
                found.add((i, q, length))
            i = j + 1
    return [(i, length, q) for i, q, length in sorted(found)]


def plain_collapsed(w, runs):
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4), st.integers(2, 12), st.integers(1, 6))
def test_runs_of_small_alphabets(texts, least, every):
    texts = [*texts, *(t[:every] * 5 for t in texts)]
    got = periods.measure([" ".join(t).encode() for t in texts], periods.RunRules(least)).to_pylist()
    for t, g in zip(texts, got, strict=True):
        want = plain_runs(t, least)
        assert [(r["start"], r["length"], r["period"]) for r in g["runs"]] == want
        assert (g["n_words"], g["collapsed"]) == (len(t), plain_collapsed(t, want))


def test_minima():
    x = np.array([5, 3, 8, 1, 9, 9, 2, 7, 4])
    table = periods.Minima(x)
    pairs = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
    low, high = (np.array(p) for p in zip(*pairs, strict=True))
    assert table.of(low, high).tolist() == [min(x[a:b]) for a, b in pairs]
    y = np.array([5, 3, 8, 1, 9, 10, 2, 7, 4])
    assert periods.Minima(y).next_smaller().tolist() == [next((j for j in range(i + 1, len(y)) if y[j] < y[i]), len(y)) for i in range(len(y))]


@pytest.mark.parametrize("sf", [SF, LARGER])
def test_op11_is_the_plain_one(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert set(got) == set(texts)
    several = 0
    for i, text in texts.items():
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        w = [x.decode() for x in w]
        if len(w) > 3000:  # the plain way takes n squared
            assert got[i]["n_runs"] >= 0
            continue
        want = plain_runs(w, 12)
        several += len(want) > 0
        best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, want).encode()).hexdigest()
    assert several > 10


def test_runs_of_odd_tables(spark):
    rows = [(1, None, 5), (None, "", 6), (2, " \n\t", 7), (3, "a " * 12, 8), (3, "a " * 12, 8), (4, "a " * 11, 9), (5, "a b c d e f " * 2, 10), (6, "　x " * 13, 11), (7, "ab" * 600_000, 12), (8, "x y z " * 70_000, 13)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, periods int")
    found, out = periods.periodic_runs(df)
    assert found.columns == ["doc_id", "text", "periods", out] and out != "periods"
    got = {r["periods"]: (r[out]["n_words"], [tuple(x) for x in r[out]["runs"]], r[out]["collapsed"]) for r in found.collect()}
    assert [got[k] for k in (5, 6, 7)] == [(0, [], "")] * 3
    assert got[8] == (12, [(0, 12, 1)], "a") and got[9] == (11, [], " ".join("a" * 11))
    assert got[10] == (12, [(0, 12, 6)], "a b c d e f") and got[11] == (13, [(0, 13, 1)], "　x")
    assert got[12][:2] == (1, []) and got[13] == (210_000, [(0, 210_000, 3)], "x y z")
    assert found.count() == len(rows)
    nothing, _ = periods.periodic_runs(spark.createDataFrame([], df.schema))
    assert nothing.count() == 0
    planted = queries.planted_periods(df.drop("periods")).collect()
    assert len(planted) == len(rows) and [r["text"] for r in planted if r["doc_id"] == 1] == [None]


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(1, len(score) + 1)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_op12_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op12_quality_classifier(spark, LARGER).collect()}
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert len(got) == docs
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    score, y = np.array([r["score"] for r, _ in held]), np.array([q for _, q in held])
    assert len(held) > 50 and auc(score, y) > 0.97
    assert np.mean([(r["predicted"] == q) for r, q in held]) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as label")
    kept = labels.where(~classifier.held_out("doc_id"))
    turned = labels.where(classifier.held_out("doc_id")).selectExpr("doc_id", "1 - label as label")
    a = classifier.train(docs, kept)
    b = classifier.train(docs, kept.unionByName(turned).where(~classifier.held_out("doc_id")))
    assert (a == b).all() and (a != 0).any()
    assert (a == classifier.train(docs.repartition(7), kept.repartition(3))).all()


def test_leader_is_the_plain_one():
    params = classifier.ClassifierParams(bits=4, passes=3, l1=0.05, l2=0.2, alpha=0.3)
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(16, 5, replace=False)), rng.random(5)) for _ in range(40)]
    labels = [int(at[0] < 3) for at, _ in rows]
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= params.l1:
            return 0.0
        return -(z[i] - math.copysign(params.l1, z[i])) / ((params.beta + math.sqrt(n[i])) / params.alpha + params.l2)

    for _ in range(params.passes):
        for (at, value), y in zip(rows, labels, strict=True):
            x = [*zip(at.tolist(), value.tolist(), strict=True), (16, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / params.alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    assert np.allclose(classifier.learn(rows, labels, params), [weight(i) for i in range(17)], atol=1e-6)


def test_features_are_counted():
    params = classifier.ClassifierParams()
    text, at, value = classifier.features([b"", b"A a b", b"a A b", b"a a b a a b"], params)
    assert set(text.tolist()) == {1, 2, 3}
    of = {d: dict(zip(at[text == d].tolist(), value[text == d].tolist(), strict=True)) for d in (1, 2, 3)}
    # Case is in shapes only: of 5 n-grams of words (a, b, a a, a b) the four are shared.
    assert len(set(of[1]) & set(of[2])) >= 4 and set(of[1]) != set(of[2])
    # Each of the two rows of n-grams has length one.
    assert all(abs(sum(v * v for v in x.values()) - 2) < 1e-9 for x in of.values())


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good words here", 0.5), (2, "BAD!! BAD!! BAD!!", 0.5), (None, None, 0.1), (4, "", 0.2), (1, "good words here", 0.3), (6, "x" * 1_500_000, 0.4)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (4, None), (9, 1), (6, 7)], "doc_id bigint, label int")
    weights = classifier.train(docs, labels)
    found, out = classifier.scored(docs, weights)
    assert found.columns == ["doc_id", "text", "score", out] and out != "score"
    got = {(r["doc_id"], r["score"]): r[out] for r in found.collect()}
    assert len(got) == 6 and got[1, 0.5] == got[1, 0.3] > 0.5 > got[2, 0.5]
    assert got[None, 0.1] == got[4, 0.2] == pytest.approx(1 / (1 + math.exp(-float(weights[-1]))))
    assert (classifier.train(docs, labels.limit(0)) == 0).all()
    assert {r[out] for r in classifier.scored(docs, np.zeros((1 << 18) + 1, np.float32))[0].collect()} == {0.5}
    assert classifier.scored(docs.limit(0), weights)[0].count() == 0


def plain_clusters(rows, params):
    """Lloyd's rounds with Python integers."""
    kept = [(i, [math.floor(params.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == params.dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{params.seed}{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    mid = [list(q) for _, q in first[: params.k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), c) for c, m in enumerate(mid))

    for _ in range(params.rounds):
        own = [near(q)[1] for _, q in kept]
        for c in range(len(mid)):
            mine = [q for (_, q), x in zip(kept, own, strict=True) if x == c]
            if mine:
                mid[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], mid


def test_op13_is_the_plain_one_and_its_sql(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, mid = plain_clusters(rows, centroids.CentroidParams())
    got = queries.op13_centroid_clustering(spark, SF).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    total = sum(d for _, _, d in want)
    assert {r["inertia"] for r in got} == {total}
    assert {(r["cluster"], r["cluster_inertia"], r["centroid_sha256"]) for r in got} == {(c, sum(d for _, x, d in want if x == c), hashlib.sha256(",".join(map(str, mid[c])).encode()).hexdigest()) for _, c, _ in want}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    rel = con.execute(oracles.oracle_sql()["op13_centroid_clustering"])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got[0].asDict())
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(rel.fetchall())


@pytest.mark.parametrize("k", [2, 5, 8])
def test_clusters_with_ties_and_empty_ones(spark, k):
    rng = random.Random(k)
    params = centroids.CentroidParams(k=k, rounds=4, dims=3, scale=2, block=1)
    rows = [(i, [float(rng.randint(-2, 2)) / rng.choice([1, 2]) for _ in range(3)]) for i in range(40)] + [(i, [1.0, 1.0, 1.0]) for i in range(40, 60)]
    odd = [(70, None), (71, [1.0, 2.0]), (72, [1.0, None, 2.0]), (73, [1.0, float("nan"), 2.0]), (74, [float("inf"), 0.0, 0.0]), (75, []), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id bigint, embedding array<double>, cluster string")
    assigned, mid = centroids.cluster(df, params=params)
    want, plain = plain_clusters(rows + odd, params)
    assert sorted((r["id"], r["cluster"], r["distance"]) for r in assigned.collect()) == sorted(want)
    assert mid.tolist() == plain


def test_clusters_of_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    empty, mid = centroids.cluster(spark.createDataFrame([], schema))
    assert centroids.with_inertia(empty, mid).count() == 0 and len(mid) == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (None, [0.25] * 64), (2, [3e38] * 64)], schema)
    assigned, mid = centroids.cluster(few)
    got = {r["id"]: r for r in centroids.with_inertia(assigned, mid).collect()}
    assert len(mid) == 3 and {r["distance"] for r in got.values()} == {0} and {r["inertia"] for r in got.values()} == {0}
    assert mid.max() == centroids.LARGEST
