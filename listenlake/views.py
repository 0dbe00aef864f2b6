"""Domain views over the driver's tables, and the same views as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# country, zone of the five nation keys used below; public IANA names
ZONES = [("US", "America/New_York"), ("DE", "Europe/Berlin"), ("KZ", "Asia/Almaty"), ("JP", "Asia/Tokyo"), ("BR", "America/Sao_Paulo")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plays: one of 100 tracks, an error is a skip, the value is seconds; every third play has no country."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    source = F.when(F.col("event_type") == "view", "ifttt").when(F.col("event_type") == "signup", "spotify_account").otherwise("spotify_extended")
    country = F.element_at(F.array(*(F.lit(c) for c, _ in ZONES)), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", k.alias("k"), F.format_string("t%03d", k).alias("track_id"), F.col("ts").cast("timestamp").alias("played_at"), source.alias("source"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("ms_played"), (F.col("event_type") == "error").alias("skipped"), F.when(F.col("event_id") % 3 != 0, country).alias("conn_country"),
        F.when(k % 4 != 0, F.format_string("sp%03d", k)).alias("spotify_id"), F.concat(F.lit("Song "), k % 90).alias("name"), F.concat(F.lit("Artist "), k % 7).alias("artist"),
    )


PLAYS = """plays AS (
  SELECT event_id AS seq, user_id, k, printf('t%03d', k) AS track_id, ts AS played_at,
    CASE event_type WHEN 'view' THEN 'ifttt' WHEN 'signup' THEN 'spotify_account' ELSE 'spotify_extended' END AS source,
    CAST(floor(value * 1000) AS BIGINT) AS ms_played, event_type = 'error' AS skipped,
    CASE WHEN event_id % 3 <> 0 THEN ['US', 'DE', 'KZ', 'JP', 'BR'][user_id % 5 + 1] END AS conn_country,
    CASE WHEN k % 4 <> 0 THEN printf('sp%03d', k) END AS spotify_id, 'Song ' || (k % 90) AS name, 'Artist ' || (k % 7) AS artist
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events))"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks in roots: the label of the vector with the same number."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("root-"), "label").alias("root_id"), F.format_string("t%03d", "vec_id").alias("track_id"))


MEMBERS = "members AS (SELECT 'root-' || label AS root_id, printf('t%03d', vec_id) AS track_id FROM embeddings)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as track records: six features, some missing, an MBID for most."""
    e = table(spark, sf_dir, "embeddings")
    names = ("bpm", "energy", "valence", "danceability", "acousticness", "instrumentalness")
    scaled = [F.get("embedding", F.lit(i)).cast("double") * (100 if n == "bpm" else 1) + (120 if n == "bpm" else 0.5) for i, n in enumerate(names)]
    return e.select(F.format_string("t%05d", "vec_id").alias("track_id"), F.col("vec_id").alias("k"), F.col("label").cast("bigint").alias("cluster"), F.when(F.col("vec_id") % 5 != 0, F.format_string("mb%05d", "vec_id")).alias("mbid"), *(F.when(F.col("vec_id") % (7 + i) != 0, c).alias(n) for i, (c, n) in enumerate(zip(scaled, names, strict=True))))


RECORDS = """records AS (
  SELECT printf('t%05d', vec_id) AS track_id, vec_id AS k, CAST(label AS BIGINT) AS cluster, CASE WHEN vec_id % 5 <> 0 THEN printf('mb%05d', vec_id) END AS mbid,
    CASE WHEN vec_id % 7 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 100 + 120 END AS bpm, CASE WHEN vec_id % 8 <> 0 THEN CAST(embedding[2] AS DOUBLE) + 0.5::DOUBLE END AS energy,
    CASE WHEN vec_id % 9 <> 0 THEN CAST(embedding[3] AS DOUBLE) + 0.5::DOUBLE END AS valence, CASE WHEN vec_id % 10 <> 0 THEN CAST(embedding[4] AS DOUBLE) + 0.5::DOUBLE END AS danceability,
    CASE WHEN vec_id % 11 <> 0 THEN CAST(embedding[5] AS DOUBLE) + 0.5::DOUBLE END AS acousticness, CASE WHEN vec_id % 12 <> 0 THEN CAST(embedding[6] AS DOUBLE) + 0.5::DOUBLE END AS instrumentalness
  FROM embeddings)"""


def doc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, the parts' brands as tags, quantities as weights."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("tag")), "l_partkey")
    return lines.groupBy(F.col("l_orderkey").alias("doc"), "tag").agg(F.sum("l_quantity").alias("weight"))


DOC_TAGS = "doc_tags AS (SELECT l_orderkey AS doc, lower(p_brand) AS tag, sum(l_quantity) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


def long_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a history of years: one user, a track per customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.format_string("c%05d", F.col("o_custkey") % 40).alias("track_id"), F.col("o_orderdate").cast("timestamp").alias("played_at"), F.lit("spotify_extended").alias("source"))


LONG_HISTORY = "history AS (SELECT o_orderkey AS seq, printf('c%05d', o_custkey % 40) AS track_id, o_orderdate AS played_at FROM orders)"


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "country string, zone string")


ZONES_SQL = "zones(country, zone) AS (VALUES " + ", ".join(f"('{c}', '{z}')" for c, z in ZONES) + ")"
