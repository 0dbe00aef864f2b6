"""Operators that have to hold for groups of any size: percentiles, window counts, co-occurrence."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listenlake.operators import epochs, quantiles, scene
from listenlake.params import EpochParams


@pytest.mark.parametrize("most", [2, 1000])
def test_percentiles_are_exact(spark, most):
    rng = random.Random(5)
    values = {"flat": [rng.uniform(-3, 9) for _ in range(201)], "log": [10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(90)], "ties": [1.0] * 60 + [2.0, 0.0, 0.0], "wide": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1.0], "near": [1 + k * 2.0**-52 for k in range(40)], "one": [7.0], None: [3.0, 4.0]}
    rows = [(g, v) for g, x in values.items() for v in x] + [("flat", None), ("log", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    asked = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in quantiles.percentiles(df, "x", ["g"], asked, most).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        for name, q in asked.items():
            x = sorted(x)
            at = q * (len(x) - 1)
            low, high = x[int(at)], x[-int(-at // 1)]
            assert got[g][name] == low + (at - int(at)) * (high - low), (g, name)
    whole = quantiles.percentiles(df, "x", [], {"p50": 0.5}, most).first()["p50"]
    every = sorted(v for _, v in rows if v is not None and v == v)
    assert whole == (every[(len(every) - 1) // 2] + every[len(every) // 2]) / 2
    assert quantiles.percentiles(df.limit(0), "x", ["g"], asked, most).count() == 0


def plain_table(times, codes, window, step):
    out, start, end = [], times.min(), times.max()
    for i in range(1, int(-(-(end - start) // step))):
        b = start + i * step
        left, right = codes[(times >= b - window) & (times < b)], codes[(times >= b) & (times < b + window)]
        if len(left) >= 5 and len(right) >= 5:
            d = max(abs((left <= c).mean() - (right <= c).mean()) for c in set(codes.tolist()))
            out.append((b, len(left), len(right), round(d, 9)))
    return out


@pytest.mark.parametrize(("window", "step"), [(3, 1), (5, 2), (2, 5), (40, 1)])
def test_windows_are_differences_of_running_counts(spark, window, step):
    rng = np.random.default_rng(window)
    day = epochs.DAY
    times = np.sort(np.concatenate([rng.integers(0, 40 * day, 90), np.arange(5) * day, np.full(12, 7 * day)]))
    codes = rng.integers(0, 4, len(times)) * (times > 15 * day)
    df = spark.createDataFrame([(int(t), int(c)) for t, c in zip(times, codes, strict=True)], "t bigint, code int")
    got = epochs.ks_table(df, EpochParams(window_days=window, step_days=step)).collect()
    assert sorted((r["boundary"], r["n_left"], r["n_right"], round(r["d"], 9)) for r in got) == plain_table(times, codes, window * day, step * day)


def test_rows_of_windows_do_not_grow_with_their_length(spark):
    day = epochs.DAY
    df = spark.range(400).select((F.col("id") * day / 2).cast("bigint").alias("t"), (F.col("id") % 3).cast("int").alias("code"))

    def exploded(window):
        found = epochs.ks_table(df, EpochParams(window_days=window, step_days=1))
        return found.count()

    assert exploded(5) <= 200 and exploded(100) <= 200


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_cooccurrence_in_blocks(spark, block):
    rng = random.Random(2)
    docs = {d: set(rng.sample("abcdefghijkl", rng.randint(1, 12))) for d in range(15)}
    rows = [(d, t) for d, x in docs.items() for t in x]
    df = spark.createDataFrame(rows + rows[:5], "doc bigint, tag string")
    want = sorted((a, b, n) for a, b in itertools.combinations_with_replacement("abcdefghijkl", 2) if (n := sum(a in x and b in x for x in docs.values())))
    assert sorted(map(tuple, scene.cooccurrence(df, block).collect())) == want
