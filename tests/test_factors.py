"""Factors by blocks and rounds against the whole matrix in one place."""

import numpy as np
import pytest

from listenlake.operators.factors import FactorParams, _small, _wide, factor_table, nmf


def table(rng, n=60, t=14, rank=4):
    x = np.round(rng.random((n, rank)) ** 3 @ rng.random((rank, t)) ** 3 * 8, 1)
    x[rng.random((n, t)) < 0.4] = 0
    x[0, x[0] == 0] = 0.5
    return np.vstack([x, np.repeat(x[:3], [9, 4, 2], axis=0)])


def frame(spark, x):
    return spark.createDataFrame([(f"d{i:03d}", f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "doc string, tag string, weight double")


def matrices(rows, k, n, t):
    w, h = np.zeros((n, k)), np.zeros((k, t))
    for r in rows:
        if r["k"] == k:
            if r["part"] == "doc":
                w[int(r["name"][1:]), r["topic"]] = r["weight"]
            else:
                h[r["topic"], int(r["name"][1:])] = r["weight"]
    return w, h


def test_patterns_change_nothing(spark):
    x = table(np.random.default_rng(3))
    rows = factor_table(frame(spark, x), (2, 4, 99, 0), 300).collect()
    assert {r["k"] for r in rows} == {2, 4}
    for k in (2, 4):
        w, h = matrices(rows, k, *x.shape)
        want_w, want_h = nmf(x, k, 300)
        assert np.allclose(w, want_w, atol=2e-3) and np.allclose(h, want_h, atol=2e-3)


def test_blocks_are_the_whole_matrix(spark):
    x = table(np.random.default_rng(5), n=30, t=9, rank=3)
    few = FactorParams(cells=0, rows=8, columns=4, turns=25)
    rows = factor_table(frame(spark, x).repartition(3), (3,), 12, few).collect()
    w, h = matrices(rows, 3, *x.shape)
    want_w, want_h = nmf(x, 3, 12)
    assert np.allclose(w, want_w, atol=1e-3) and np.allclose(h, want_h, atol=1e-3)


@pytest.mark.parametrize("cells", [0, 1 << 20])
def test_odd_tables(spark, cells):
    schema = "doc string, tag string, weight double"
    params = FactorParams(cells=cells, turns=3)
    assert factor_table(spark.createDataFrame([], schema), (1, 2), 5, params).count() == 0
    odd = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), (None, "x", 1.0), ("b", None, 1.0), ("b", "x", None)], schema)
    got = factor_table(odd, (1, 2), 5, params).collect()
    assert {(r["k"], r["part"], r["name"]) for r in got} == {(1, "doc", "a"), (1, "tag", "x")}
    assert np.prod([r["weight"] for r in got]) == pytest.approx(2.0)


def test_few_tags_go_round_in_one_pass(spark):
    """Blocks of whole rows give the factors of the whole matrix, all K in the same rounds, two tables kept at most but for those of finished K."""
    x = table(np.random.default_rng(8), n=90, t=11)
    rows = factor_table(frame(spark, x).repartition(3), (2, 3, 99), 300, FactorParams(cells=0, rows=16)).collect()
    assert {r["k"] for r in rows} == {2, 3}
    for k in (2, 3):
        w, h = matrices(rows, k, *x.shape)
        want_w, want_h = nmf(x, k, 300)
        assert np.allclose(w, want_w, atol=1e-6) and np.allclose(h, want_h, atol=1e-6)


def test_rounds_of_few_tags_are_bounded_in_jobs(spark):
    """A round is a pass and a sum for all K together; it was some twenty jobs for each K."""
    x = table(np.random.default_rng(9), n=60, t=9)

    def jobs(max_iter):
        spark.sparkContext.setJobGroup(f"factors-{max_iter}", "")
        factor_table(frame(spark, x), (2, 3), max_iter, FactorParams(cells=0, rows=32)).count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"factors-{max_iter}"))

    assert jobs(6) - jobs(2) <= 4 * 4


def test_sums_of_a_round_come_in_one_job(spark):
    """However many files a round has: the driver ran one job after the other for their sums."""
    x = table(np.random.default_rng(10), n=60, t=9)

    def jobs(max_iter):
        spark.sparkContext.setJobGroup(f"sums-{max_iter}", "")
        factor_table(frame(spark, x), (2, 3), max_iter, FactorParams(cells=0, rows=4)).count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sums-{max_iter}"))

    assert jobs(6) - jobs(2) <= 4 * 3


def test_numbers_of_a_block_are_kept_in_the_least_kind_that_holds_them():
    for x, size in (([0, 255], 1), ([7, 65535], 2), ([-1, 0.5], 4), ([0.1, 3], 8), ([np.nan, np.inf], 8), ([1 << 40, 1], 4), ([(1 << 40) + 1, 1], 8), ([], 1)):
        packed = _small(np.array(x))
        assert np.array_equal(_wide(packed), np.array(x), equal_nan=True) and len(packed) == 8 + size * len(x)
