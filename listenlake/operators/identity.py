"""Identity: dump joins, the track and artist waterfalls, lookups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.functions.keys import filled, folded, track_id
from listenlake.operators.plays import keep_first, keep_last

LEVELS = ("mbid", "isrc", "spotify_id", "name")


def isrc_pairs(isrcs: DataFrame, recordings: DataFrame) -> DataFrame:
    """isrc, mbid of (seq, recording_id, isrc) and (seq, recording_id, gid): the last non-empty gid of a recording counts, orphans go, pairs keep their number."""
    last = keep_last(recordings.where(filled(F.col("gid")).isNotNull()), ["recording_id"]).select("recording_id", "gid")
    return isrcs.where(filled(F.col("isrc")).isNotNull()).join(last, "recording_id").select("seq", "isrc", F.col("gid").alias("mbid"))


def artist_pairs(urls: DataFrame, links: DataFrame, artists: DataFrame) -> DataFrame:
    """spotify artist id, mbid of (url_id, url), (seq, artist_id, url_id), (artist_id, gid); the last url of an artist wins."""
    found = urls.withColumn("spotify_artist", F.regexp_extract("url", r"open\.spotify\.com/artist/([A-Za-z0-9]+)", 1)).where("spotify_artist <> ''")
    last = keep_last(links.join(found, "url_id").select("artist_id", "seq", "spotify_artist"), ["artist_id"])
    return last.join(artists, "artist_id").select(F.concat(F.lit("spotify:artist:"), "spotify_artist").alias("uri"), F.col("gid").alias("mbid"))


def spotify_lookup(plays: DataFrame, fold=folded) -> DataFrame:
    """name_key, artist_key, spotify_id where the pair of names has one id, and how many ids it has where not."""
    named = plays.where((F.col("source") == "spotify_extended") & filled(F.col("spotify_id")).isNotNull())
    keyed = named.select(fold(F.col("name")).alias("name_key"), fold(F.col("artist")).alias("artist_key"), "spotify_id")
    return keyed.groupBy("name_key", "artist_key").agg(F.countDistinct("spotify_id").alias("n_ids"), F.min("spotify_id").alias("spotify_id")).withColumn("spotify_id", F.when(F.col("n_ids") == 1, F.col("spotify_id")))


def pick_mbid(candidates: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """isrc, mbid: the smallest covered candidate, else the smallest."""
    if covered is None:
        return candidates.groupBy("isrc").agg(F.min("mbid").alias("mbid"))
    known = covered.select("mbid").distinct().withColumn("covered", F.lit(0))
    flagged = candidates.join(known, "mbid", "left")
    return flagged.groupBy("isrc").agg(F.min(F.struct(F.coalesce("covered", F.lit(1)).alias("rest"), "mbid")).alias("best")).select("isrc", F.col("best.mbid").alias("mbid"))


def level(mbid: Column, isrc: Column, spotify_id: Column) -> Column:
    return F.when(mbid.isNotNull(), "mbid").when(isrc.isNotNull(), "isrc").when(spotify_id.isNotNull(), "spotify_id").otherwise("name")


def waterfall(refs: DataFrame, isrc_index: DataFrame, spotify_isrc: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """Refs (input_key, spotify_id, isrc, mbid, ...) with isrc and mbid filled in and their level.

    Spotify id to ISRC where neither is known, then ISRC to one MBID; both are left joins on their key.
    """
    isrc = F.col("isrc")
    if spotify_isrc is not None:
        refs = refs.join(spotify_isrc.select("spotify_id", F.col("isrc").alias("found_isrc")), "spotify_id", "left")
        isrc = F.coalesce("isrc", F.when(F.col("mbid").isNull(), F.col("found_isrc")))
    refs = refs.withColumn("isrc", isrc)
    one = pick_mbid(isrc_index, covered).select("isrc", F.col("mbid").alias("found_mbid"))
    done = refs.join(one, "isrc", "left").withColumn("mbid", F.coalesce("mbid", "found_mbid")).drop("found_mbid", "found_isrc")
    return done.withColumn("level", level(F.col("mbid"), F.col("isrc"), F.col("spotify_id")))


def with_cache(refs: DataFrame, cache: DataFrame, resolve) -> tuple[DataFrame, DataFrame]:
    """Resolved refs and the new cache: hits count only when they reached an MBID, and only such rows are kept."""
    trusted = cache.where("level = 'mbid'")
    hits = refs.select("input_key").join(trusted, "input_key")
    fresh = resolve(refs.join(trusted.select("input_key"), "input_key", "left_anti"))
    new = fresh.where("level = 'mbid'").select(*trusted.columns)
    return hits.unionByName(fresh.select(*hits.columns)), trusted.unionByName(new)


def artist_waterfall(artists: DataFrame, uri_index: DataFrame, name_index: DataFrame | None = None, fold=folded) -> DataFrame:
    """artists (key, uri, name) with an mbid by uri, else by name."""
    found = artists.join(uri_index.select("uri", F.col("mbid").alias("by_uri")), "uri", "left")
    if name_index is None:
        return found.select("key", "uri", "name", F.col("by_uri").alias("mbid"))
    found = found.withColumn("name_key", fold(F.col("name"))).join(name_index.select(F.col("name_key"), F.col("mbid").alias("by_name")), "name_key", "left")
    return found.select("key", "uri", "name", F.coalesce("by_uri", "by_name").alias("mbid"))


def level_report(resolved: DataFrame) -> DataFrame:
    """One row: counts of all levels, and the share that reached an MBID (0 when empty)."""
    counts = [F.count_if(F.col("level") == x).alias(f"n_{x}") for x in LEVELS]
    return resolved.agg(F.count("*").alias("n_total"), *counts, F.coalesce(F.try_divide(F.count_if(F.col("level") == "mbid"), F.count("*")), F.lit(0.0)).alias("mbid_coverage"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("level <> 'mbid'").select("input_key")


def rekey(plays: DataFrame, resolved: DataFrame, key: str = "track_id") -> DataFrame:
    """Plays under the canonical id of their resolved track; one resolution per distinct raw id."""
    return plays.join(resolved.select(F.col("input_key").alias(key), "canonical_id"), key, "left").withColumn("track_id", F.coalesce("canonical_id", key)).drop("canonical_id")


def all_artists(artists: DataFrame, marquee: DataFrame) -> DataFrame:
    """Artists and marquee names, each key once, artists first."""
    both = artists.withColumn("part", F.lit(0)).unionByName(marquee.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return keep_first(both.withColumn("order_", F.struct("part", "seq")), ["key"], "order_").drop("part", "order_")


def track_refs(events: DataFrame) -> DataFrame:
    """One row per raw identity of events (seq, spotify_id, isrc, mbid, name, artist): input_key and its first-seen names."""
    keyed = events.select("seq", *(filled(F.col(c)).alias(c) for c in ("spotify_id", "isrc", "mbid")), "name", "artist")
    keyed = keyed.withColumn("input_key", track_id(*(F.col(c) for c in ("spotify_id", "isrc", "mbid", "name", "artist"))))
    return keep_first(keyed, ["input_key"], "seq").drop("seq")


def resolve(refs: DataFrame, isrc_index: DataFrame, spotify_isrc: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """``waterfall`` with the canonical id that the resolved identity has."""
    done = waterfall(refs, isrc_index, spotify_isrc, covered)
    return done.withColumn("canonical_id", track_id(*(F.col(c) for c in ("spotify_id", "isrc", "mbid", "name", "artist"))))


def metadata_records(resolved: DataFrame, now: Column) -> DataFrame:
    """One record per canonical track, from the first of its raw identities."""
    own = resolved.select(F.col("canonical_id").alias("track_id"), "input_key", "spotify_id", "isrc", "mbid", "name", "artist")
    return keep_first(own, ["track_id"], "input_key").drop("input_key").withColumn("fetched_at", now)


def now_playing(current: DataFrame, isrc_index: DataFrame, spotify_isrc: DataFrame | None = None) -> DataFrame:
    """The track that plays (spotify_id, title, artist; no row when none does) walked up the waterfall."""
    nothing = F.lit(None).cast("string")
    refs = track_refs(current.select(F.lit(0).alias("seq"), "spotify_id", nothing.alias("isrc"), nothing.alias("mbid"), F.col("title").alias("name"), "artist"))
    return resolve(refs, isrc_index, spotify_isrc)
