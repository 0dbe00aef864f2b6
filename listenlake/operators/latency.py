"""Whether inference keeps up with what is played: latencies of clips, their ratio to real time, and a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.operators.quantiles import percentiles

# The most of the shortest clip that the 95th percentile may take, the most memory in MB, and the least clips.
MAX_RATIO, MAX_RSS_MB, MIN_CLIPS = 0.5, 1500.0, 50


def latency_report(runs: DataFrame, *by: str) -> DataFrame:
    """n, p50, p95, mean, realtime_ratio and sustainable of (clip_seconds, latency_seconds, rss_mb); percentiles are exact and linear, of groups of any size."""
    whole = runs.groupBy(*by).agg(F.count("latency_seconds").alias("n"), F.avg("latency_seconds").alias("mean"), F.min("clip_seconds").alias("shortest"), F.max("rss_mb").alias("peak_rss_mb"))
    found = percentiles(runs, "latency_seconds", list(by), {"p50": 0.5, "p95": 0.95})
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = whole.alias("a").join(found.alias("b"), same, "left").select(*(f"a.{c}" for c in by), "n", "p50", "p95", "mean", F.try_divide("p95", "shortest").alias("realtime_ratio"), "peak_rss_mb")
    good = (F.col("n") >= MIN_CLIPS) & (F.col("realtime_ratio") <= MAX_RATIO) & (F.col("peak_rss_mb") <= MAX_RSS_MB)
    return out.withColumn("sustainable", F.coalesce(good, F.lit(False)))
