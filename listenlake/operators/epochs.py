"""Epochs: adjacent windows of root codes, two-sample KS tests, spaced change points, ranges and presence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlake.functions.keys import half_even
from listenlake.functions.times import micros
from listenlake.params import MIN_WINDOW_EVENTS, EpochParams

DAY = 86_400_000_000


def root_codes(members: DataFrame) -> DataFrame:
    """track_id, code: roots sorted by id are 1, 2, ...; the smallest root of a track counts."""
    codes = members.select("root_id").distinct().withColumn("code", F.row_number().over(Window.orderBy("root_id")))
    return members.join(codes, "root_id").groupBy("track_id").agg(F.min("code").alias("code"))


def coded_plays(plays: DataFrame, members: DataFrame, at: str = "played_at") -> DataFrame:
    """t (microseconds) and code of every play; 0 where the track is in no root."""
    return plays.join(root_codes(members), "track_id", "left").select(micros(F.col(at)).alias("t"), F.coalesce("code", F.lit(0)).alias("code"))


def ks_table(coded: DataFrame, params: EpochParams = EpochParams()) -> DataFrame:
    """boundary, n_left, n_right, d: the largest gap between the code distributions of the windows before and after each boundary.

    Boundaries are a grid from the first play. For each code, plays before a boundary, before
    its left window and before the end of its right one are running counts over the grid: a
    play is counted once at each of three places, and windows are differences of the counts,
    so rows do not grow with the length of a window.
    """
    window, step = params.window_days * DAY, params.step_days * DAY
    edge = coded.agg(F.min("t").alias("start"), F.max("t").alias("end"))
    # A play is before the place (with its shift) of every boundary after these.
    own, left, right = ((F.floor((F.col("t") + shift - F.col("start")) / step).cast("bigint") + 1).alias(name) for shift, name in ((0, "own"), (window, "left"), (-window, "right")))
    cells = coded.crossJoin(F.broadcast(edge)).select("start", (F.ceil((F.col("end") - F.col("start")) / step).cast("bigint") - 1).alias("last"), "code", own, left, right).groupBy("start", "last", "code", "own", "left", "right").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    at = F.array(*(F.struct(F.greatest(F.col(c), F.lit(1).cast("bigint")).alias("i"), *(F.col("n").alias(k) if k == c else zero.alias(k) for k in ("own", "left", "right"))) for c in ("own", "left", "right")))
    steps = cells.select("start", "last", "code", F.explode(at).alias("p")).where("p.i <= last").groupBy("start", "last", "code", "p.i").agg(*(F.sum(f"p.{k}").alias(k) for k in ("own", "left", "right")))
    grid = Window.partitionBy("code").orderBy("i")
    running = steps.select("start", "code", "i", *(F.sum(k).over(grid.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in ("own", "left", "right")), F.coalesce(F.lead("i").over(grid) - 1, F.col("last")).alias("until"))
    counted = running.select("start", "code", "i", "until", (F.col("own") - F.col("left")).alias("l"), (F.col("right") - F.col("own")).alias("r")).where("l > 0 or r > 0")
    sides = counted.select("start", "code", "l", "r", F.explode(F.sequence("i", "until")).alias("i"))
    every, upto = Window.partitionBy("i"), Window.partitionBy("i").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    wide = sides.withColumn("n_left", F.sum("l").over(every)).withColumn("n_right", F.sum("r").over(every)).withColumn("gap", F.abs(F.try_divide(F.sum("l").over(upto), F.col("n_left")) - F.try_divide(F.sum("r").over(upto), F.col("n_right"))))
    out = wide.groupBy("i").agg(F.first("start").alias("start"), F.first("n_left").alias("n_left"), F.first("n_right").alias("n_right"), F.max("gap").alias("d"))
    return out.where((F.col("n_left") >= MIN_WINDOW_EVENTS) & (F.col("n_right") >= MIN_WINDOW_EVENTS)).select((F.col("start") + F.col("i") * step).alias("boundary"), "start", "n_left", "n_right", "d")


def kolmogorov_sf(d: float, n: int) -> float:
    """P(D_n >= d) of one sample of n. Every way of counting it agrees with the exact law to 1e-8 and better where it is used, so none of them shows in the result."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d >= 4:
        return far_tail(d, n)
    return min(1.0, max(0.0, 1.0 - (inside_matrix(d, n) if n * d <= 120 else inside_series(d, n))))


def far_tail(d: float, n: int) -> float:
    """Twice Smirnov's exact one-sided sum: both sides at once are less likely than this by a factor of exp(-6 n d**2)."""
    j = np.arange(int(n * (1 - d)) + 1, dtype=float)
    choose = np.concatenate([[0.0], np.cumsum(np.log((n - j[1:] + 1) / j[1:]))])
    left = np.maximum(1 - d - j / n, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(n > j, (n - j) * np.log(left), 0.0)
    return min(1.0, 2 * d * float(np.exp(choose + (j - 1) * np.log(d + j / n) + rest).sum()))


def inside_series(d: float, n: int) -> float:
    """P(D_n < d) by the expansion of Pelz and Good, for n in the thousands."""
    z = math.sqrt(n) * d
    half, whole = np.arange(-40, 40) + 0.5, np.arange(-40, 41.0)
    a, b = (math.pi * half) ** 2, (math.pi * whole) ** 2
    by_half, by_whole = np.exp(-a / (2 * z * z)), np.exp(-b / (2 * z * z))
    root = math.sqrt(math.pi / 2)
    terms = (
        root / z * by_half.sum(),
        root / (6 * z**4) * ((a - z**2) * by_half).sum(),
        root / (72 * z**7) * ((6 * z**6 + 2 * z**4 + (2 * z**4 - 5 * z**2) * a + (1 - 2 * z**2) * a**2) * by_half).sum() - root / (36 * z**3) * (b * by_whole).sum(),
        root / (6480 * z**10) * (((5 - 30 * z**2) * a**3 + (212 * z**4 - 60 * z**2) * a**2 + (135 * z**4 - 96 * z**6) * a - 30 * z**6 - 90 * z**8) * by_half).sum() + root / (2160 * z**6) * ((3 * z**2 * b - b**2) * by_whole).sum(),
    )
    return float(sum(t / n ** (i / 2) for i, t in enumerate(terms)))


def inside_matrix(d: float, n: int) -> float:
    """P(D_n < d) by the matrix power of Marsaglia, Tsang and Wang."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    grid = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    power = (grid >= 0).astype(float)
    power[:, 0] -= h ** np.arange(1, m + 1)
    power[m - 1, :] -= h ** np.arange(m, 0, -1)
    power[m - 1, 0] += max(0.0, 2 * h - 1) ** m if 2 * h - 1 > 0 else 0.0
    logs = np.array([math.lgamma(max(g, 0) + 1) for g in grid.ravel()]).reshape(m, m)
    with np.errstate(over="ignore"):
        power = np.where(grid > 0, power / np.exp(logs), power)
    scale, result, square, e = 0.0, np.eye(m), power, 0.0
    left = n
    while left:
        if left & 1:
            result, scale = result @ square, scale + e
            top = result.max()
            if top > 1e100:
                result, scale = result / top, scale + math.log(top)
        square, e = square @ square, 2 * e
        top = square.max()
        if top > 1e100:
            square, e = square / top, e + math.log(top)
        left >>= 1
    inside = result[k - 1, k - 1]
    return 0.0 if inside <= 0 else math.exp(math.log(inside) + scale + math.lgamma(n + 1) - n * math.log(n))


@F.pandas_udf(T.DoubleType())
def ks_p_value(d: pd.Series, n_left: pd.Series, n_right: pd.Series) -> pd.Series:
    n = (n_left * n_right / (n_left + n_right)).round().astype(int).clip(lower=1)
    return pd.Series([kolmogorov_sf(x, k) for x, k in zip(d, n, strict=True)])


def change_points(tested: DataFrame, params: EpochParams = EpochParams()) -> DataFrame:
    """One row: points, the boundaries under the p-value that lie a window apart, with their p. There is one boundary per step of history, so they fit in a row."""
    passing = tested.where(F.col("p") < params.p_value)
    window = F.lit(params.window_days * DAY).cast("bigint")
    listed = passing.agg(F.array_sort(F.collect_list(F.struct("boundary", "p"))).alias("found"), F.min("start").alias("start"))
    empty = F.expr("array()").cast("array<struct<boundary:bigint,p:double>>")
    points = F.aggregate("found", F.struct(F.col("start").alias("last"), empty.alias("kept")), lambda a, x: F.when(x["boundary"] - a["last"] >= window, F.struct(x["boundary"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return listed.select(F.coalesce(points, empty).alias("points"))


def epoch_ranges(coded: DataFrame, points: DataFrame) -> DataFrame:
    """epoch_id, low, high (microseconds), last, p_value: half-open but for the last."""
    ends = coded.agg(F.min("t").alias("start"), F.max("t").alias("end")).where("start is not null").crossJoin(points)
    bounds = F.concat(F.array("start"), F.transform("points", lambda x: x["boundary"]), F.array("end"))
    wide = ends.select(bounds.alias("b"), F.transform("points", lambda x: x["p"]).alias("p"))
    index = F.sequence(F.lit(0), F.size("b") - 2)
    return wide.select("b", "p", F.explode(index).alias("i")).select(F.concat(F.lit("e-"), F.col("i") + 1).alias("epoch_id"), F.get("b", F.col("i")).alias("low"), F.get("b", F.col("i") + 1).alias("high"), (F.col("i") == F.size("b") - 2).alias("last"), F.get("p", F.col("i")).alias("p_value"))


def in_epochs(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (t) beside the epoch they fall in; an epoch spans a window at least, so the broadcast side is small."""
    inside = (F.col("t") >= F.col("low")) & ((F.col("t") < F.col("high")) | (F.col("last") & (F.col("t") == F.col("high"))))
    return rows.join(F.broadcast(ranges), inside)


def epoch_table(coded: DataFrame, ranges: DataFrame, top: int = 2) -> DataFrame:
    """Epochs with their number of events and their most frequent root codes, as text."""
    counts = in_epochs(coded, ranges).groupBy("epoch_id", "code").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("epoch_id").orderBy(F.desc("n"), "code"))
    dominant = counts.where("code > 0").withColumn("rank", rank).where(F.col("rank") <= top).groupBy("epoch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]), ",").alias("dominant"))
    total = counts.groupBy("epoch_id").agg(F.sum("n").alias("n_events"))
    return ranges.join(total, "epoch_id", "left").join(dominant, "epoch_id", "left").select("epoch_id", "low", "high", "p_value", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("dominant", F.lit("")).alias("dominant"))


def presence(plays: DataFrame, members: DataFrame, ranges: DataFrame, at: str = "played_at") -> DataFrame:
    """root_id, epoch_id, presence for every pair: the share of the epoch's plays that are of the root's own tracks."""
    timed = in_epochs(plays.select("track_id", micros(F.col(at)).alias("t")), ranges)
    per_track = timed.groupBy("epoch_id", "track_id").agg(F.count("*").alias("n"))
    own = per_track.join(members.select("root_id", "track_id").distinct(), "track_id").groupBy("root_id", "epoch_id").agg(F.sum("n").alias("n"))
    total = per_track.groupBy("epoch_id").agg(F.sum("n").alias("n_events"))
    grid = members.select("root_id").distinct().crossJoin(F.broadcast(ranges.select("epoch_id")))
    wide = grid.join(own, ["root_id", "epoch_id"], "left").join(total, "epoch_id", "left")
    return wide.select("root_id", "epoch_id", half_even(F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("n_events")), F.lit(0.0)), 4).alias("presence"))


def detect(plays: DataFrame, members: DataFrame, at: str = "played_at", params: EpochParams = EpochParams()) -> tuple[DataFrame, DataFrame]:
    """Epoch ranges and the epoch table."""
    coded = coded_plays(plays, members, at)
    tested = ks_table(coded, params).withColumn("p", ks_p_value("d", "n_left", "n_right"))
    ranges = epoch_ranges(coded, change_points(tested, params))
    return ranges, epoch_table(coded, ranges)
