"""Exact percentiles of groups of any size, by narrowing ranges.

The values next to a rank are looked for in a range that starts at a group's least and
greatest value. While it holds more than ``most`` values it is cut into bins, counted in
one pass with map-side sums, and the bin of the rank becomes the range: by sign where the
range crosses zero, by logarithm where its ends are far apart, else by equal width. So
ten passes at most lead to one value or to a range that is small enough to be sorted,
whatever the values are. What a task holds is the bins of a range or ``most`` distinct
values, not a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.shared import drop_since, made, stored

BINS, MOST, FAR = 1024, 1 << 18, 1024.0


def _bin(v: Column, low: Column, high: Column) -> Column:
    """A bin that never descends as ``v`` ascends; bins of a range keep each its own least and greatest value."""
    one_sign = (low > 0) | (high < 0)
    size_low, size_high = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
    by_log = F.floor((F.ln(F.abs(v)) - F.ln(size_low)) / (F.ln(size_high) - F.ln(size_low)) * BINS) * F.signum(v)
    # Halves, so that the width of no range overflows.
    by_width = F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BINS)
    return F.when(low == high, F.lit(0.0)).when(~one_sign, F.signum(v)).when(size_high / size_low > FAR, by_log).otherwise(by_width).cast("double")


def order_statistics(df: DataFrame, value: str, by: list[str], quantiles: list[float], most: int = MOST) -> DataFrame:
    """``by``, t (the place of a quantile in the list), r (rank from 0), part (how far between this value and the next) and v, two rows per group and quantile."""
    mark = made()
    clean = stored(df.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + 0.0), "values")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    groups = clean.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.struct(F.col("t"), (F.col("q") * (F.col("n") - 1)).alias("at"))
    wanted = groups.select("*", F.posexplode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("t", "q")).select(*by, "n", "low", "high", place.alias("p"))
    rank = F.explode(F.array(F.floor("p.at"), F.ceil("p.at")))
    targets = stored(wanted.select(*by, "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), "p.t", (F.col("p.at") - F.floor("p.at")).alias("part"), rank.alias("r")), "targets")
    ranges = lambda t: t.select(*by, "low", "high", "below", "inside").distinct()
    while targets.where((F.col("inside") > most) & (F.col("low") < F.col("high"))).limit(1).count():
        wide = ranges(targets).where((F.col("inside") > most) & (F.col("low") < F.col("high"))).alias("r")
        near = clean.alias("d").join(wide, [*same("d", "r"), F.col("v") >= F.col("low"), F.col("v") <= F.col("high")])
        own = [F.col(f"r.{c}").alias(c) for c in by]
        counts = near.select(*own, "low", "high", "below", "v", _bin(F.col("v"), F.col("low"), F.col("high")).alias("bin")).groupBy(*by, "low", "high", "below", "bin").agg(F.count("*").alias("k"), F.min("v").alias("new_low"), F.max("v").alias("new_high"))
        upto = Window.partitionBy(*by, "low", "high", "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = counts.withColumn("before", F.col("below") + F.coalesce(F.sum("k").over(upto), F.lit(0))).alias("b")
        inside = [*same("t", "b"), F.col("t.low") == F.col("b.low"), F.col("t.high") == F.col("b.high"), F.col("t.below") == F.col("b.below"), F.col("r") >= F.col("before"), F.col("r") < F.col("before") + F.col("k")]
        found = targets.alias("t").join(bins, inside, "left")
        hit = F.col("k").isNotNull()
        pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(f"t.{old}")).alias(old)
        targets = stored(found.select(*(F.col(f"t.{c}").alias(c) for c in by), pick("new_low", "low"), pick("new_high", "high"), pick("before", "below"), pick("k", "inside"), "t", "part", "r"), "targets")
    small = ranges(targets.where(F.col("low") < F.col("high"))).alias("r")
    near = clean.alias("d").join(small, [*same("d", "r"), F.col("v") >= F.col("low"), F.col("v") <= F.col("high")])
    values = near.select(*(F.col(f"r.{c}").alias(c) for c in by), "low", "high", "below", "v").groupBy(*by, "low", "high", "below", "v").agg(F.count("*").alias("k"))
    upto = Window.partitionBy(*by, "low", "high", "below").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("before", F.col("below") + F.coalesce(F.sum("k").over(upto), F.lit(0))).alias("b")
    inside = [*same("t", "b"), F.col("t.low") == F.col("b.low"), F.col("t.high") == F.col("b.high"), F.col("t.below") == F.col("b.below"), F.col("r") >= F.col("before"), F.col("r") < F.col("before") + F.col("k")]
    joined = targets.alias("t").join(placed, inside, "left")
    out = stored(joined.select(*(F.col(f"t.{c}").alias(c) for c in by), "t", "r", "part", F.coalesce("v", "t.low").alias("v")), "ranks")
    drop_since(df.sparkSession, mark, (out,))
    return out


def percentiles(df: DataFrame, value: str, by: list[str], quantiles: dict[str, float], most: int = MOST) -> DataFrame:
    """``by`` and one column per name: the exact percentile, linear between the two values next to it. Null and NaN values take no part, and a group of nothing else is in no row."""
    ranks = order_statistics(df, value, by, list(quantiles.values()), most)
    each = ranks.groupBy(*by, "t").agg((F.min("v") + F.max("part") * (F.max("v") - F.min("v"))).alias("p"))
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("t") == i, F.col("p"))).alias(name) for i, name in enumerate(quantiles)))
