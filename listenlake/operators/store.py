"""Shared metadata: upserts, staleness, pull-and-cache and bulk reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.params import TTL_DAYS


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "track_id") -> DataFrame:
    """Incoming rows replace existing ones whole."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def is_stale(fetched_at: Column, now: Column, days: int = TTL_DAYS) -> Column:
    """Older than ``days``; exactly that old is fresh."""
    return F.unix_micros(now) - F.unix_micros(fetched_at) > days * 86_400_000_000


def pull_and_cache(ids: DataFrame, cache: DataFrame, store: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """track_id, status (cache_hit, pulled, stale, missing) and fetched_at of what is used, for each distinct id."""
    wide = ids.select("track_id").distinct().join(cache.select("track_id", F.col("fetched_at").alias("cached_at")), "track_id", "left").join(store.select("track_id", F.col("fetched_at").alias("stored_at")), "track_id", "left")
    hit = F.col("cached_at").isNotNull() & ~is_stale(F.col("cached_at"), now, days)
    status = F.when(hit, "cache_hit").when(F.col("stored_at").isNull(), "missing").when(is_stale(F.col("stored_at"), now, days), "stale").otherwise("pulled")
    return wide.select("track_id", status.alias("status"), F.when(hit, F.col("cached_at")).otherwise(F.col("stored_at")).alias("fetched_at"))


def get_tracks(ids: DataFrame, tracks: DataFrame, features: DataFrame, tags: DataFrame) -> DataFrame:
    """Records of the ids that exist, put together from tracks, features and tags."""
    grouped = tags.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("tag", "weight", "source"))).alias("tags"))
    wide = tracks.join(ids.select("track_id").distinct(), "track_id", "left_semi").join(features, "track_id", "left").join(grouped, "track_id", "left")
    return wide.withColumn("tags", F.coalesce("tags", F.expr("array()").cast("array<struct<tag:string,weight:double,source:string>>")))


def missing_ids(ids: DataFrame, cache: DataFrame, key: str = "mbid") -> DataFrame:
    """What a resumed build still has to fetch; known misses count as fetched."""
    return ids.select(key).distinct().join(cache.select(key), key, "left_anti")
