"""Operators on play events: validity, deduplication, supersede, cut-off and facts.

An event has ``seq``, its place in the input, wherever order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.times import micros
from listenlake.params import MIN_VALID_MS

BULK_SOURCES = ("ifttt", "spotify_extended")


def is_valid(ms_played: Column, skipped: Column, min_ms: int = MIN_VALID_MS, ignore_skip: bool = False) -> Column:
    """False only for what is known to be no listening; what is unknown counts as valid."""
    short = F.coalesce(ms_played < min_ms, F.lit(False))
    return ~short if ignore_skip else ~(short | F.coalesce(skipped, F.lit(False)))


def keep_first(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key in the order of ``seq``. min_by combines before the shuffle, so a hot key stays small."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col(seq)).alias("first_row")).select("first_row.*")


def keep_last(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("last_row")).select("last_row.*")


def merge_history(existing: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, then imported ones, each key once; existing rows win."""
    both = existing.withColumn("side", F.lit(0)).unionByName(imported.withColumn("side", F.lit(1)))
    return keep_first(both.withColumn("merge_seq", F.struct("side", "seq")), keys, "merge_seq").drop("side", "merge_seq")


def supersede(history: DataFrame, sources: tuple[str, ...] = BULK_SOURCES) -> DataFrame:
    """History without the sources that a full export replaces."""
    return history.where(~F.coalesce(F.col("source").isin(*sources), F.lit(False)))


def cutoff(existing: DataFrame) -> DataFrame:
    """One row: the newest play of the full export, or null."""
    return existing.where(F.col("source") == "spotify_extended").agg(F.max("played_at").alias("cutoff"))


def after_cutoff(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows newer than the full export; all rows when there is none. The broadcast side is one row."""
    edge = F.broadcast(cutoff(existing))
    return rows.crossJoin(edge).where(F.col("cutoff").isNull() | (F.col("played_at") > F.col("cutoff"))).drop("cutoff")


def lost_by_import(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """One row: how many plays of the full export are older than all that is imported."""
    oldest = F.broadcast(imported.agg(F.min("played_at").alias("oldest")))
    return existing.where(F.col("source") == "spotify_extended").crossJoin(oldest).where(F.col("played_at") < F.col("oldest")).agg(F.count("*").alias("n_older"))


def facts(plays: DataFrame, *by: str) -> DataFrame:
    """min, max, counts, whole days between first and last play (elapsed, not calendar days), and sources."""
    span = F.floor((micros(F.max("played_at")) - micros(F.min("played_at"))) / F.lit(86_400_000_000)).cast("bigint")
    return plays.groupBy(*by).agg(F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"), F.count("*").alias("n_events"), F.countDistinct("track_id").alias("n_unique"), F.coalesce(span, F.lit(0)).alias("span_days"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def first_refs(plays: DataFrame) -> DataFrame:
    """One row per track: the columns it was first seen with."""
    return keep_first(plays, ["track_id"])


def reject_ledger(rows: DataFrame, samples: int = 5) -> DataFrame:
    """Rows per reject reason, with the first raw values of those that did not parse."""
    first = F.when(F.col("reason") == "unparseable_timestamp", F.struct("seq", "raw_time"))
    ranked = rows.where(F.col("reason").isNotNull()).withColumn("rank", F.when(F.col("reason") == "unparseable_timestamp", F.row_number().over(Window.partitionBy("reason").orderBy("seq"))))
    return ranked.groupBy("reason").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= samples, first))), lambda x: x["raw_time"]), "|").alias("samples"))


def cross_tab(plays: DataFrame, min_ms: int = MIN_VALID_MS) -> DataFrame:
    """Plays kept, short, skipped, or both."""
    short, skip = F.coalesce(F.col("ms_played") < min_ms, F.lit(False)), F.coalesce(F.col("skipped"), F.lit(False))
    kind = F.when(short & skip, "both").when(short, "short").when(skip, "skip").otherwise("kept")
    return plays.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def per_source(plays: DataFrame) -> DataFrame:
    return plays.groupBy("source").agg(F.count("*").alias("total"), F.count_if(is_valid(F.col("ms_played"), F.col("skipped"))).alias("valid"))


def hour_histogram(plays: DataFrame) -> DataFrame:
    """Plays per hour, all 24 present."""
    hours = plays.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    seen = plays.groupBy(F.hour("played_at").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(seen, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def evening_peak(histogram: DataFrame, width: int = 3) -> DataFrame:
    """The start of the busiest ``width`` hours round the clock; the latest start wins a tie."""
    around = histogram.unionByName(histogram.withColumn("hour", F.col("hour") + 24))
    total = F.sum("n").over(Window.orderBy("hour").rowsBetween(0, width - 1))
    return around.withColumn("total", total).where("hour < 24").agg(F.max(F.struct("total", "hour")).alias("peak")).select(F.col("peak.hour").alias("start_hour"), F.col("peak.total").alias("n"))
