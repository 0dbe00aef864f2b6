"""Every operator of the engine as a registered query over the driver's tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.functions import keys, times
from listenlake.operators import audio, enrich, epochs, identity, latency, library, listening, plays, quantiles, scene, store, temporal, validate
from listenlake.params import AudioParams, EpochParams, TemporalParams, ValidationParams
from listenlake.plans import sweep
from listenlake.shared import shared_path
from listenlake.sources import readers
from listenlake.sources.versioned import VersionedTable
from listenlake.views import DOC_TAGS, LONG_HISTORY, MEMBERS, PLAYS, RECORDS, ZONES_SQL, doc_tags, long_history, members, records, table, zones
from listenlake.views import plays as plays_view
from listenlake.zones import COUNTRY_ZONES, country_zones

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


VALID = "NOT (coalesce(ms_played < 30000, false) OR coalesce(skipped, false))"
BUCKETS = """CASE WHEN hour(played_at) >= 6 AND hour(played_at) < 12 THEN 'morning' WHEN hour(played_at) >= 12 AND hour(played_at) < 18 THEN 'day' WHEN hour(played_at) >= 18 AND hour(played_at) < 23 THEN 'evening' ELSE 'night' END AS day_part,
  CASE WHEN isodow(played_at) <= 5 THEN 'weekday' ELSE 'weekend' END AS weekday_kind,
  CASE WHEN month(played_at) IN (12, 1, 2) THEN 'winter' WHEN month(played_at) <= 5 THEN 'spring' WHEN month(played_at) <= 8 THEN 'summer' ELSE 'autumn' END AS season"""
MIDDLE = "epoch_us(min(played_at)) + (epoch_us(max(played_at)) - epoch_us(min(played_at))) // 2"
LIFT = f"""valid AS (SELECT *, {BUCKETS} FROM plays WHERE {VALID}),
  totals AS (SELECT day_part, weekday_kind, season, count(*) AS bucket_total FROM valid GROUP BY ALL),
  middle AS (SELECT {MIDDLE} AS m FROM valid),
  pairs AS (SELECT root_id, day_part, weekday_kind, season, count(*) AS n, count(*) FILTER (epoch_us(played_at) < m) AS n_before FROM valid JOIN (SELECT DISTINCT * FROM members) USING (track_id), middle GROUP BY ALL),
  events_r AS (SELECT root_id, sum(n) AS events_r FROM pairs GROUP BY 1),
  lifts AS (SELECT *, events_r / (SELECT count(*) FROM valid)::DOUBLE AS p_root_overall, n / bucket_total::DOUBLE AS p_root_given_bucket,
    (n / bucket_total::DOUBLE) / (events_r / (SELECT count(*) FROM valid)::DOUBLE) AS lift, round(1 - abs(n_before / n::DOUBLE - (n - n_before) / n::DOUBLE), 4) AS balance
    FROM pairs JOIN events_r USING (root_id) JOIN totals USING (day_part, weekday_kind, season))"""


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_buckets(plays_view(spark, sf_dir).where(plays.is_valid(F.col("ms_played"), F.col("skipped"))))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


LOW_FLOOR = TemporalParams(event_count_floor=5, lift_floor=1.1)


@query(f"WITH {PLAYS}, {MEMBERS}, {LIFT} SELECT root_id, day_part, weekday_kind, season, n, CAST(events_r AS BIGINT) AS events_r, bucket_total, round(p_root_overall, 6) AS p_root_overall, round(p_root_given_bucket, 6) AS p_root_given_bucket, round(lift, 6) AS lift, balance, CASE WHEN n < 30 THEN 'dropped:event_count_floor' WHEN lift >= 1.3 THEN 'candidate' ELSE 'rejected:lift_floor' END AS verdict FROM lifts")
def lift_table(spark, sf_dir):
    return rounded(temporal.lift_table(bucketed(spark, sf_dir), members(spark, sf_dir)), "p_root_overall", "p_root_given_bucket", "lift")


@query(f"WITH {PLAYS}, {MEMBERS}, {LIFT}, v AS (SELECT *, CASE WHEN lift >= 1.1 THEN 'candidate' ELSE 'rejected:lift_floor' END AS verdict FROM lifts WHERE n >= 5) SELECT (CASE verdict WHEN 'candidate' THEN 'r-temporal-' ELSE 'q-temporal-' END) || row_number() OVER (PARTITION BY verdict ORDER BY n DESC, root_id, day_part || '|' || weekday_kind || '|' || season) AS candidate_id, root_id, day_part, weekday_kind, season, n FROM v")
def temporal_ranks(spark, sf_dir):
    lifts = temporal.lift_table(bucketed(spark, sf_dir), members(spark, sf_dir), params=LOW_FLOOR)
    return temporal.ranked(lifts).select("candidate_id", "root_id", *temporal.BUCKET, "n")


@query(f"WITH {PLAYS} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN ms_played < 30000 AND skipped THEN 'both' WHEN ms_played < 30000 THEN 'short' WHEN skipped THEN 'skip' ELSE 'kept' END AS kind FROM plays) GROUP BY 1")
def validity_cross_tab(spark, sf_dir):
    return plays.cross_tab(plays_view(spark, sf_dir))


@query(f"WITH {PLAYS} SELECT source, count(*) AS total, count(*) FILTER ({VALID}) AS valid FROM plays GROUP BY 1")
def source_validity(spark, sf_dir):
    return plays.per_source(plays_view(spark, sf_dir))


@query(f"WITH {PLAYS} SELECT CAST(h AS INTEGER) AS hour, count(seq) AS n FROM range(24) r(h) LEFT JOIN plays ON hour(played_at) = h GROUP BY 1")
def hour_histogram(spark, sf_dir):
    return plays.hour_histogram(plays_view(spark, sf_dir))


@query(f"WITH {PLAYS}, c AS (SELECT h, count(seq) AS n FROM range(24) r(h) LEFT JOIN plays ON hour(played_at) = h GROUP BY 1), w AS (SELECT a.h, sum(b.n) AS n FROM c a JOIN c b ON (b.h - a.h + 24) % 24 < 3 GROUP BY 1) SELECT CAST(h AS INTEGER) AS start_hour, CAST(n AS BIGINT) AS n FROM w ORDER BY n DESC, h DESC LIMIT 1")
def evening_peak(spark, sf_dir):
    return plays.evening_peak(plays.hour_histogram(plays_view(spark, sf_dir)))


@query(f"WITH {PLAYS} SELECT user_id, min(played_at) AS first_at, max(played_at) AS last_at, count(*) AS n_events, count(DISTINCT track_id) AS n_unique, CAST((epoch_us(max(played_at)) - epoch_us(min(played_at))) // 86400000000 AS BIGINT) AS span_days, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM plays GROUP BY 1")
def generated_from(spark, sf_dir):
    found = plays.facts(plays_view(spark, sf_dir), "user_id")
    return found.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query(f"WITH {PLAYS} SELECT user_id, track_id, arg_min(seq, seq) AS seq, arg_min(source, seq) AS source FROM plays GROUP BY 1, 2")
def dedup_keep_first(spark, sf_dir):
    return plays.keep_first(plays_view(spark, sf_dir).select("user_id", "track_id", "seq", "source"), ["user_id", "track_id"])


@query(f"WITH {PLAYS} SELECT user_id, track_id, max(seq) AS seq, arg_max(source, seq) AS source FROM plays GROUP BY 1, 2")
def last_wins(spark, sf_dir):
    return plays.keep_last(plays_view(spark, sf_dir).select("user_id", "track_id", "seq", "source"), ["user_id", "track_id"])


@query(f"WITH {PLAYS}, old AS (SELECT *, 0 AS side FROM plays WHERE seq % 2 = 0 AND source = 'spotify_account'), new AS (SELECT *, 1 AS side FROM plays WHERE seq % 2 = 1 OR source <> 'spotify_account'), b AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT source, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM (SELECT *, row_number() OVER (PARTITION BY user_id, track_id ORDER BY side, seq) AS r FROM b) WHERE r = 1 GROUP BY 1")
def supersede_merge(spark, sf_dir):
    p = plays_view(spark, sf_dir)
    old = plays.supersede(p.where("seq % 2 = 0"))
    new = p.where("seq % 2 = 1 or source <> 'spotify_account'")
    return plays.merge_history(old, new, ["user_id", "track_id"]).groupBy("source").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


@query(f"WITH {PLAYS}, c AS (SELECT max(played_at) AS cut FROM plays WHERE source = 'spotify_extended' AND day(played_at) <= 10) SELECT source, count(*) AS n FROM plays, c WHERE played_at > cut GROUP BY 1")
def cutoff_filter(spark, sf_dir):
    p = plays_view(spark, sf_dir)
    return plays.after_cutoff(p, p.where(F.dayofmonth("played_at") <= 10)).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {PLAYS} SELECT count(*) AS n_older FROM plays WHERE source = 'spotify_extended' AND played_at < (SELECT min(played_at) FROM plays WHERE day(played_at) >= 5)")
def import_guard(spark, sf_dir):
    p = plays_view(spark, sf_dir)
    return plays.lost_by_import(p, p.where(F.dayofmonth("played_at") >= 5))


@query("SELECT p_partkey, coalesce('mbid:' || CASE WHEN p_partkey % 2 = 0 THEN nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'm' || p_partkey END, '') END, 'isrc:' || CASE WHEN p_partkey % 3 = 0 THEN 'i' || p_partkey END, 'spotify:' || CASE WHEN p_partkey % 5 = 0 THEN 's' || p_partkey END, 'name:' || lower(p_name) || chr(31) || lower(p_brand)) AS track_id FROM part")
def canonical_id(spark, sf_dir):
    k = F.col("p_partkey")
    mbid = F.when(k % 2 == 0, F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("m"), k)))
    return table(spark, sf_dir, "part").select("p_partkey", keys.track_id(F.when(k % 5 == 0, F.concat(F.lit("s"), k)), F.when(k % 3 == 0, F.concat(F.lit("i"), k)), mbid, F.col("p_name"), F.col("p_brand")).alias("track_id"))


@query("SELECT s_suppkey, coalesce('uri:' || CASE WHEN s_suppkey % 2 = 0 THEN 'spotify:artist:' || s_suppkey END, 'name:' || lower(s_name)) AS artist_key, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'spotify:artist:' || s_suppkey END, lower(s_name)) AS library_key, regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM supplier")
def artist_keys(spark, sf_dir):
    uri = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("spotify:artist:"), "s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", keys.artist_key(uri, F.col("s_name")).alias("artist_key"), keys.library_artist_key(uri, F.col("s_name")).alias("library_key"), keys.safe_name(F.col("s_name")).alias("safe"))


@query("WITH rec AS (SELECT o_custkey AS recording_id, arg_max('g' || o_orderkey, o_orderkey) AS gid FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1) SELECT l_orderkey AS seq, 'I' || l_suppkey AS isrc, gid AS mbid FROM lineitem JOIN rec ON recording_id = l_partkey")
def isrc_join(spark, sf_dir):
    isrcs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("recording_id"), F.concat(F.lit("I"), "l_suppkey").alias("isrc"))
    gid = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("g"), "o_orderkey")).otherwise("")
    return identity.isrc_pairs(isrcs, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("recording_id"), gid.alias("gid")))


@query("WITH u AS (SELECT o_orderkey AS url_id, 'A' || o_custkey AS spotify_artist FROM orders WHERE o_orderkey % 3 <> 0), l AS (SELECT l_suppkey AS artist_id, arg_max(spotify_artist, l_orderkey * 10 + l_linenumber) AS spotify_artist FROM (SELECT l_suppkey, l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2) JOIN u ON url_id = l_orderkey GROUP BY 1) SELECT 'spotify:artist:' || spotify_artist AS uri, s_name AS mbid FROM l JOIN supplier ON s_suppkey = artist_id")
def artist_join(spark, sf_dir):
    url = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("https://open.spotify.com/artist/A"), "o_custkey")).otherwise("https://example.com/a")
    urls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url_id"), url.alias("url"))
    links = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("artist_id"), F.col("l_orderkey").alias("url_id")).agg(F.min("l_linenumber").alias("n")).withColumn("seq", F.col("url_id") * 10 + F.col("n"))
    return identity.artist_pairs(urls, links, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("gid")))


@query(f"WITH {PLAYS} SELECT lower(name) AS name_key, lower(artist) AS artist_key, count(DISTINCT spotify_id) AS n_ids, CASE WHEN count(DISTINCT spotify_id) = 1 THEN min(spotify_id) END AS spotify_id FROM plays WHERE source = 'spotify_extended' AND spotify_id IS NOT NULL GROUP BY 1, 2")
def ambiguous_lookup(spark, sf_dir):
    return identity.spotify_lookup(plays_view(spark, sf_dir))


CANDIDATES = "cand AS (SELECT DISTINCT 'I' || l_suppkey AS isrc, 'm' || l_partkey AS mbid FROM lineitem), cov AS (SELECT 'm' || p_partkey AS mbid FROM part WHERE p_partkey % 9 = 0), one AS (SELECT isrc, arg_min(mbid, (CASE WHEN mbid IN (SELECT mbid FROM cov) THEN '0' ELSE '1' END) || mbid) AS mbid FROM cand GROUP BY 1)"


def candidate_index(spark, sf_dir):
    index = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("I"), "l_suppkey").alias("isrc"), F.concat(F.lit("m"), "l_partkey").alias("mbid")).distinct()
    return index, table(spark, sf_dir, "part").where("p_partkey % 9 = 0").select(F.concat(F.lit("m"), "p_partkey").alias("mbid"))


@query(f"WITH {CANDIDATES} SELECT isrc, mbid FROM one")
def disambiguate_mbid(spark, sf_dir):
    return identity.pick_mbid(*candidate_index(spark, sf_dir))


REFS = "refs AS (SELECT c_custkey AS input_key, CASE WHEN c_custkey % 2 = 0 THEN 's' || c_custkey END AS spotify_id, CASE WHEN c_custkey % 3 = 0 THEN 'I' || (c_custkey % 200) END AS isrc, CASE WHEN c_custkey % 11 = 0 THEN 'x' || c_custkey END AS mbid FROM customer), sp AS (SELECT 's' || c_custkey AS spotify_id, 'I' || (c_custkey % 150) AS isrc FROM customer WHERE c_custkey % 4 = 0), w AS (SELECT input_key, spotify_id, coalesce(refs.isrc, CASE WHEN mbid IS NULL THEN sp.isrc END) AS isrc, mbid FROM refs LEFT JOIN sp USING (spotify_id)), done AS (SELECT input_key, spotify_id, w.isrc, coalesce(w.mbid, one.mbid) AS mbid FROM w LEFT JOIN one USING (isrc)), levels AS (SELECT *, CASE WHEN mbid IS NOT NULL THEN 'mbid' WHEN isrc IS NOT NULL THEN 'isrc' WHEN spotify_id IS NOT NULL THEN 'spotify_id' ELSE 'name' END AS level FROM done)"


def resolved_refs(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    refs = c.select(k.alias("input_key"), F.when(k % 2 == 0, F.concat(F.lit("s"), k)).alias("spotify_id"), F.when(k % 3 == 0, F.concat(F.lit("I"), k % 200)).alias("isrc"), F.when(k % 11 == 0, F.concat(F.lit("x"), k)).alias("mbid"))
    index, covered = candidate_index(spark, sf_dir)
    spotify = c.where("c_custkey % 4 = 0").select(F.concat(F.lit("s"), k).alias("spotify_id"), F.concat(F.lit("I"), k % 150).alias("isrc"))
    return identity.waterfall(refs, index, spotify, covered)


@query(f"WITH {CANDIDATES}, {REFS} SELECT input_key, isrc, mbid, level FROM levels")
def identity_waterfall(spark, sf_dir):
    return resolved_refs(spark, sf_dir).select("input_key", "isrc", "mbid", "level")


@query(f"WITH {CANDIDATES}, {REFS} SELECT count(*) AS n_total, count(*) FILTER (level = 'mbid') AS n_mbid, count(*) FILTER (level = 'isrc') AS n_isrc, count(*) FILTER (level = 'spotify_id') AS n_spotify_id, count(*) FILTER (level = 'name') AS n_name, round(count(*) FILTER (level = 'mbid') / count(*)::DOUBLE, 6) AS mbid_coverage FROM levels")
def waterfall_levels(spark, sf_dir):
    return rounded(identity.level_report(resolved_refs(spark, sf_dir)), "mbid_coverage")


@query(f"WITH {CANDIDATES}, {REFS} SELECT input_key FROM levels WHERE level <> 'mbid'")
def unresolved_refs(spark, sf_dir):
    return identity.unresolved(resolved_refs(spark, sf_dir))


@query("WITH a AS (SELECT c_custkey AS key, 'u' || c_custkey AS uri, lower(c_mktsegment) AS name FROM customer) SELECT key, coalesce(CASE WHEN key % 3 = 0 THEN 'byuri' || key END, CASE WHEN name IN ('building', 'machinery') THEN 'byname-' || name END) AS mbid FROM a")
def artist_waterfall(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    artists = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit("u"), "c_custkey").alias("uri"), F.col("c_mktsegment").alias("name"))
    by_uri = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("uri"), F.concat(F.lit("byuri"), "c_custkey").alias("mbid"))
    by_name = c.select(F.lower("c_mktsegment").alias("name_key")).distinct().where("name_key in ('building', 'machinery')").select("name_key", F.concat(F.lit("byname-"), "name_key").alias("mbid"))
    return identity.artist_waterfall(artists, by_uri, by_name).select("key", "mbid")


NOW = "2001-01-01 00:00:00"


@query(f"SELECT o_orderkey, epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate) > 90 * 86400000000 AS stale FROM orders")
def staleness(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", store.is_stale(F.col("o_orderdate").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("stale"))


PULL = "ids AS (SELECT DISTINCT o_custkey % 2000 AS track_id FROM orders), cache AS (SELECT o_custkey AS track_id, max(o_orderdate) AS cached_at FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1), st AS (SELECT o_custkey AS track_id, min(o_orderdate) + INTERVAL 600 DAY AS stored_at FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)"


@query(f"WITH {PULL}, j AS (SELECT track_id, cached_at, stored_at, cached_at IS NOT NULL AND cached_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AS hit FROM ids LEFT JOIN cache USING (track_id) LEFT JOIN st USING (track_id)) SELECT track_id, CASE WHEN hit THEN 'cache_hit' WHEN stored_at IS NULL THEN 'missing' WHEN stored_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'stale' ELSE 'pulled' END AS status, CAST(CASE WHEN hit THEN cached_at ELSE stored_at END AS TIMESTAMP) AS fetched_at FROM j")
def pull_and_cache(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    cache = o.where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("track_id")).agg(F.max("at").alias("fetched_at"))
    stored = o.where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("track_id")).agg((F.min("at") + F.expr("INTERVAL 600 DAY")).alias("fetched_at"))
    found = store.pull_and_cache(o.select((F.col("o_custkey") % 2000).alias("track_id")), cache, stored, F.lit(NOW).cast("timestamp"))
    return found.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@query("SELECT c_custkey AS track_id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("name"))
    return store.upsert(c, c.where("track_id % 6 = 0").withColumn("name", F.concat(F.lit("new "), "track_id")))


@query("SELECT DISTINCT o_custkey AS mbid FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def resume_missing(spark, sf_dir):
    cache = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("mbid"))
    return store.missing_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mbid")), cache)


@query("SELECT c_custkey AS track_id, count(o_orderkey) AS n_tags, min(o_orderpriority) AS first_tag FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority, o_orderkey FROM orders) ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY 1")
def get_tracks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("name"))
    tags = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderpriority").alias("tag"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").cast("string").alias("source"))
    found = store.get_tracks(c.where("track_id % 2 = 0").select("track_id"), c, c.select("track_id", F.lit(0.5).alias("energy")), tags)
    return found.select("track_id", F.size("tags").cast("bigint").alias("n_tags"), F.get("tags", F.lit(0))["tag"].alias("first_tag"))


SIX = ("bpm", "energy", "valence", "danceability", "acousticness", "instrumentalness")
ENRICH = f"start AS (SELECT track_id, mbid, k, {', '.join(f'CASE WHEN k % 4 = 0 THEN {c} END AS {c}' for c in SIX)} FROM records), b AS (SELECT *, CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in SIX)} THEN 'already_present' WHEN mbid IS NULL THEN 'no_mbid' WHEN k % 3 = 0 THEN 'enriched' ELSE 'missing_features' END AS bucket FROM start)"


def enriched(spark, sf_dir):
    r = records(spark, sf_dir)
    start = r.select("track_id", "mbid", *(F.when(F.col("k") % 4 == 0, F.col(c)).alias(c) for c in SIX))
    return enrich.enrich_audio(start, r.where("k % 3 = 0 and mbid is not null").select("mbid", *SIX), SIX)


@query(f"WITH {RECORDS}, {ENRICH} SELECT bucket, count(*) AS n FROM b GROUP BY 1")
def enrich_buckets(spark, sf_dir):
    return enrich.bucket_counts(enriched(spark, sf_dir))


@query(f"WITH {RECORDS}, {ENRICH} SELECT count(*) AS considered, count(*) FILTER (bucket IN ('enriched', 'already_present')) AS covered, round(count(*) FILTER (bucket IN ('enriched', 'already_present')) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (bucket IN ('enriched', 'already_present')) / count(*) FILTER (bucket <> 'no_mbid')::DOUBLE, 6) AS features_given_mbid FROM b")
def enrich_coverage(spark, sf_dir):
    return rounded(enrich.coverage(enriched(spark, sf_dir)), "coverage", "features_given_mbid")


@query("WITH r AS (SELECT o_custkey AS mbid, lower(o_orderpriority) AS folded, o_orderpriority AS tag, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind FROM orders) SELECT mbid, tag, CAST(o_orderkey AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY mbid, folded ORDER BY kind, o_orderkey) AS i FROM r) WHERE i = 1")
def genre_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mbid"), F.when(F.col("o_orderstatus") == "F", "genre").otherwise("tag").alias("kind"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("count"))
    return enrich.genre_tags(rows)


@query("SELECT c_custkey AS track_id, CASE WHEN c_custkey % 5 = 0 THEN 'already_present' WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'enriched' ELSE 'missing_tags' END AS bucket, CASE WHEN c_custkey % 5 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'first' WHEN c_custkey % 2 = 0 THEN 'second' END AS tag FROM customer")
def composite_tags(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("key", k)
    none = F.expr("cast(array() as array<string>)")
    rows = c.select(k.alias("track_id"), "key", F.when(k % 5 == 0, F.array(F.lit("own"))).otherwise(none).alias("tags"))
    first = c.where("key % 2 = 0 or key % 3 = 0").select("key", F.when(k % 3 == 0, F.array(F.lit("first"))).otherwise(none).alias("tags"))
    second = c.where("key % 2 = 0").select("key", F.array(F.lit("second")).alias("tags"))
    return enrich.enrich_tags(rows, first, second).select("track_id", "bucket", F.get("tags", F.lit(0)).alias("tag"))


@query(f"WITH {PLAYS}, {ZONES_SQL} SELECT zone AS modal_zone FROM plays JOIN zones ON conn_country = country WHERE source = 'spotify_extended' GROUP BY 1 ORDER BY count(*) DESC, zone LIMIT 1")
def modal_zone(spark, sf_dir):
    return temporal.modal_zone(plays_view(spark, sf_dir), zones(spark))


@query(f"WITH {PLAYS}, {ZONES_SQL}, m AS (SELECT zone AS mz FROM plays JOIN zones ON conn_country = country WHERE source = 'spotify_extended' GROUP BY 1 ORDER BY count(*) DESC, zone LIMIT 1), z AS (SELECT seq, played_at, source, CASE WHEN source <> 'ifttt' THEN coalesce(zone, mz) END AS zone FROM plays LEFT JOIN zones ON conn_country = country, m) SELECT seq, CAST(CASE WHEN zone IS NULL THEN played_at ELSE timezone(zone, timezone('UTC', played_at)) END AS TIMESTAMP) AS local_at, zone IS NOT NULL AS shifted FROM z")
def localize(spark, sf_dir):
    return temporal.localize(plays_view(spark, sf_dir), zones(spark)).select("seq", "local_at", "shifted")


@query(f"WITH {PLAYS} SELECT source, count(*) AS n FROM plays WHERE source = 'ifttt' GROUP BY 1")
def unshifted_sources(spark, sf_dir):
    return temporal.unshifted(temporal.localize(plays_view(spark, sf_dir), zones(spark)))


@query(f"WITH {LONG_HISTORY} SELECT seq, {BUCKETS} FROM history")
def bucketize(spark, sf_dir):
    return temporal.with_buckets(long_history(spark, sf_dir)).select("seq", *temporal.BUCKET)


@query(f"WITH {PLAYS}, {MEMBERS}, m AS (SELECT {MIDDLE} AS m FROM plays) SELECT root_id, round(1 - abs(count(*) FILTER (epoch_us(played_at) < m) / count(*)::DOUBLE - count(*) FILTER (epoch_us(played_at) >= m) / count(*)::DOUBLE), 4) AS balance FROM plays JOIN members USING (track_id), m GROUP BY 1")
def stability(spark, sf_dir):
    return audio.stability(members(spark, sf_dir), plays_view(spark, sf_dir), "root_id")


DIMS = ("bpm", "energy", "valence", "danceability")
FULL = " AND ".join(f"{d} IS NOT NULL" for d in DIMS)
Z = f"clean AS (SELECT * FROM records WHERE {FULL}), zs AS (SELECT *, {', '.join(f'({d} - avg({d}) OVER ()) / coalesce(nullif(stddev_pop({d}) OVER (), 0), 1) AS z_{d}' for d in DIMS)} FROM clean)"


def zscored(spark, sf_dir):
    return audio.zscores(records(spark, sf_dir).where(audio.has_all(DIMS)), DIMS)


@query(f"WITH {RECORDS}, {Z} SELECT track_id, {', '.join(f'round(z_{d}, 5) AS z_{d}' for d in DIMS)} FROM zs")
def zscore(spark, sf_dir):
    return rounded(zscored(spark, sf_dir).select("track_id", *(f"z_{d}" for d in DIMS)), *(f"z_{d}" for d in DIMS), digits=5)


@query(f"WITH {RECORDS}, {Z}, c AS (SELECT cluster, count(*) AS cluster_size, min(track_id) AS min_id, avg(CASE WHEN acousticness IS NOT NULL AND instrumentalness IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage, avg(bpm) AS bpm, avg(energy) AS energy FROM clean GROUP BY 1) SELECT 'r-audio-' || row_number() OVER (ORDER BY cluster_size DESC, min_id) AS candidate_id, cluster_size, round(cluster_size / sum(cluster_size) OVER ()::DOUBLE, 6) AS cluster_share, round(coverage, 6) AS coverage, round(bpm, 4) AS c_bpm, CASE WHEN bpm < 100 THEN 'low' WHEN bpm < 140 THEN 'mid' ELSE 'high' END AS band_bpm, CASE WHEN energy < 0.4 THEN 'low' WHEN energy < 0.66 THEN 'mid' ELSE 'high' END AS band_energy FROM c")
def cluster_descriptor(spark, sf_dir):
    found = audio.describe(zscored(spark, sf_dir).withColumn("probability", F.lit(1.0)), plays_view(spark, sf_dir))
    return rounded(found.select("candidate_id", "cluster_size", "cluster_share", "coverage", "c_bpm", "band_bpm", "band_energy"), "cluster_share", "coverage")


@query(f"WITH {RECORDS}, {Z}, d AS (SELECT cluster, track_id, sqrt({' + '.join(f'pow(z_{d} - avg(z_{d}) OVER (PARTITION BY cluster), 2)' for d in DIMS)}) AS distance FROM zs) SELECT cluster, CAST(i AS INTEGER) AS rank, track_id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, track_id) AS i FROM d) WHERE i <= 5")
def sample_tracks(spark, sf_dir):
    return audio.samples(zscored(spark, sf_dir), DIMS, 5)


@query()
def audio_clusters(spark, sf_dir):
    found = audio.cluster(records(spark, sf_dir), AudioParams(min_cluster_size=20, min_samples=5))
    return found.select("track_id", F.col("cluster").alias("found"), F.round("probability", 6).alias("probability"))


@query(f"WITH {DOC_TAGS} SELECT tag, count(DISTINCT doc) AS df FROM doc_tags GROUP BY 1")
def doc_freq(spark, sf_dir):
    return scene.doc_frequency(doc_tags(spark, sf_dir))


PAIRS = "pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_both FROM doc_tags a JOIN doc_tags b ON a.doc = b.doc AND a.tag <= b.tag GROUP BY 1, 2), df AS (SELECT tag, count(*) AS df FROM doc_tags GROUP BY 1), nd AS (SELECT count(DISTINCT doc)::DOUBLE AS n FROM doc_tags)"
NPMI = "CASE WHEN n_both >= n THEN 1.0 ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ln((n_both / n) / ((x.df / n) * (y.df / n))) / -ln(n_both / n))) END"


@query(f"WITH {DOC_TAGS}, {PAIRS} SELECT tag_a, tag_b, n_both FROM pairs")
def cooccurrence(spark, sf_dir):
    return scene.cooccurrence(doc_tags(spark, sf_dir))


@query(f"WITH {DOC_TAGS}, {PAIRS} SELECT tag_a, tag_b, round({NPMI}, 6) AS npmi FROM pairs JOIN df x ON x.tag = tag_a JOIN df y ON y.tag = tag_b, nd WHERE tag_a < tag_b")
def npmi_pairs(spark, sf_dir):
    tags = doc_tags(spark, sf_dir)
    df = scene.doc_frequency(tags)
    n = F.broadcast(tags.agg(F.countDistinct("doc").alias("n")))
    wide = scene.cooccurrence(tags).where("tag_a < tag_b").join(df.select(F.col("tag").alias("tag_a"), F.col("df").alias("n_a")), "tag_a").join(df.select(F.col("tag").alias("tag_b"), F.col("df").alias("n_b")), "tag_b").crossJoin(n)
    return wide.select("tag_a", "tag_b", F.round(scene.npmi(F.col("n_both"), F.col("n_a"), F.col("n_b"), F.col("n")), 6).alias("npmi"))


TOPICS = "topics AS (SELECT l_suppkey % 8 AS topic, lower(p_brand) AS tag, sum(l_quantity) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), top AS (SELECT topic, tag, weight / sum(weight) OVER (PARTITION BY topic) AS share, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, tag) AS i FROM topics)"


def topic_weights(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("tag")), "l_partkey")
    return lines.groupBy((F.col("l_suppkey") % 8).alias("topic"), "tag").agg(F.sum("l_quantity").alias("weight"))


@query(f"WITH {TOPICS} SELECT topic, CAST(i AS INTEGER) AS rank, tag, round(share, 4) AS weight FROM top WHERE i <= 10 AND round(share, 4) > 0")
def top_tags(spark, sf_dir):
    return scene.top_tags(topic_weights(spark, sf_dir), 10)


@query(f"WITH {DOC_TAGS}, {PAIRS}, {TOPICS}, t AS (SELECT topic, tag FROM top WHERE i <= 10), p AS (SELECT a.topic, a.tag AS tag_a, b.tag AS tag_b FROM t a JOIN t b ON a.topic = b.topic AND a.tag < b.tag) SELECT p.topic, round(avg(CASE WHEN n_both IS NULL THEN -1.0 ELSE {NPMI} END), 6) AS coherence FROM p LEFT JOIN pairs USING (tag_a, tag_b) JOIN df x ON x.tag = tag_a JOIN df y ON y.tag = tag_b, nd GROUP BY 1")
def topic_coherence(spark, sf_dir):
    top = scene.top_tags(topic_weights(spark, sf_dir), 10)
    return rounded(scene.coherence(top.select("topic", "tag"), doc_tags(spark, sf_dir)), "coherence")


@query("WITH c AS (SELECT l_linenumber AS k, avg(l_discount) AS coherence, l_suppkey % l_linenumber AS topic FROM lineitem GROUP BY 1, 3), m AS (SELECT k, sum(coherence) / k AS mean_coherence, count(*) FILTER (coherence >= 0.01) AS n FROM c GROUP BY 1) SELECT k, round(mean_coherence, 6) AS mean_coherence FROM m WHERE n > 0 ORDER BY mean_coherence DESC, k LIMIT 1")
def choose_k(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % F.col("l_linenumber")).alias("topic")).agg(F.avg("l_discount").alias("coherence"))
    return rounded(scene.best_k(per, 0.01), "mean_coherence")


@query("WITH w AS (SELECT o_custkey AS doc, o_orderkey % 5 AS topic, sum(o_totalprice) AS weight FROM orders GROUP BY 1, 2), b AS (SELECT doc, topic, weight / sum(weight) OVER (PARTITION BY doc) AS dominance, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, topic) AS i FROM w) SELECT doc, topic, round(dominance, 6) AS dominance FROM b WHERE i = 1")
def argmax_topic(spark, sf_dir):
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 5).alias("topic")).agg(F.sum("o_totalprice").alias("weight"))
    return rounded(scene.assign(w), "dominance")


@query("WITH c AS (SELECT l_suppkey % 8 AS topic, p_brand AS artist, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT topic, artist, n, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, artist) AS i FROM c) WHERE i <= 5")
def top_artists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("artist")), "l_partkey")
    return scene.top_artists(lines.select((F.col("l_suppkey") % 8).alias("topic"), "artist"), 5)


@query()
def scene_topics(spark, sf_dir):
    found = scene.factor(doc_tags(spark, sf_dir))
    return found.select("k", "part", "topic", "name", F.round("weight", 3).alias("weight"))


CODES = "codes AS (SELECT track_id, min(code) AS code FROM (SELECT track_id, dense_rank() OVER (ORDER BY root_id) AS code FROM members) GROUP BY 1), coded AS (SELECT epoch_us(played_at) AS t, coalesce(code, 0) AS code FROM {plays} LEFT JOIN codes USING (track_id))"
YEARS = "members AS (SELECT 'root-' || (o_custkey % 40 % 4) AS root_id, printf('c%05d', o_custkey % 40) AS track_id FROM orders GROUP BY ALL)"
SHORT = EpochParams(window_days=5, step_days=1, p_value=0.2)
KS = "edge AS (SELECT min(t) AS s, max(t) AS e FROM coded), b AS (SELECT i, s + i * {step} AS boundary FROM edge, range(1, 100000) r(i) WHERE s + i * {step} < e), side AS (SELECT b.boundary, code, count(*) FILTER (t < b.boundary) AS l, count(*) FILTER (t >= b.boundary) AS r FROM b JOIN coded ON t >= b.boundary - {window} AND t < b.boundary + {window} GROUP BY 1, 2), cum AS (SELECT boundary, sum(l) OVER w AS n_left, sum(r) OVER w AS n_right, abs(sum(l) OVER c / (sum(l) OVER w)::DOUBLE - sum(r) OVER c / (sum(r) OVER w)::DOUBLE) AS gap FROM side WINDOW w AS (PARTITION BY boundary), c AS (PARTITION BY boundary ORDER BY code)) SELECT boundary, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, round(max(gap), 6) AS d FROM cum WHERE n_left >= 5 AND n_right >= 5 GROUP BY 1, 2, 3"


def year_members(spark, sf_dir):
    k = F.col("o_custkey") % 40
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("root-"), k % 4).alias("root_id"), F.format_string("c%05d", k).alias("track_id")).distinct()


@query(f"WITH {PLAYS}, {MEMBERS}, {CODES.format(plays='plays')}, {KS.format(step=86400000000, window=5 * 86400000000)}")
def ks_statistic(spark, sf_dir):
    return rounded(epochs.ks_table(epochs.coded_plays(plays_view(spark, sf_dir), members(spark, sf_dir)), SHORT).drop("start"), "d")


@query(f"WITH {LONG_HISTORY}, {YEARS}, {CODES.format(plays='history')}, {KS.format(step=14 * 86400000000, window=60 * 86400000000)}")
def ks_statistic_years(spark, sf_dir):
    return rounded(epochs.ks_table(epochs.coded_plays(long_history(spark, sf_dir), year_members(spark, sf_dir))).drop("start"), "d")


@query()
def epoch_detection(spark, sf_dir):
    _, found = epochs.detect(plays_view(spark, sf_dir), members(spark, sf_dir), params=SHORT)
    return rounded(found, "p_value")


THIRDS = "edge AS (SELECT min(epoch_us(played_at)) AS s, max(epoch_us(played_at)) AS e FROM plays), ranges AS (SELECT 'e-' || (i + 1) AS epoch_id, s + i * 864000000000 AS low, CASE WHEN i = 2 THEN e ELSE s + (i + 1) * 864000000000 END AS high, i = 2 AS last FROM edge, range(3) r(i)), timed AS (SELECT track_id, epoch_id FROM plays JOIN ranges ON epoch_us(played_at) >= low AND (epoch_us(played_at) < high OR (last AND epoch_us(played_at) = high)))"


def third_ranges(spark, sf_dir):
    edge = plays_view(spark, sf_dir).agg(F.min(F.unix_micros("played_at")).alias("s"), F.max(F.unix_micros("played_at")).alias("e"))
    ten = 864_000_000_000
    return edge.select("s", "e", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select(F.concat(F.lit("e-"), F.col("i") + 1).alias("epoch_id"), (F.col("s") + F.col("i") * ten).alias("low"), F.when(F.col("i") == 2, F.col("e")).otherwise(F.col("s") + (F.col("i") + 1) * ten).alias("high"), (F.col("i") == 2).alias("last"), F.lit(None).cast("double").alias("p_value"))


@query(f"WITH {PLAYS}, {MEMBERS}, {THIRDS}, o AS (SELECT root_id, epoch_id, count(*) AS n FROM timed JOIN members USING (track_id) GROUP BY ALL), t AS (SELECT epoch_id, count(*) AS n_events FROM timed GROUP BY 1) SELECT r.root_id, e.epoch_id, round(coalesce(n, 0) / n_events::DOUBLE, 4) AS presence FROM (SELECT DISTINCT root_id FROM members) r CROSS JOIN ranges e LEFT JOIN o ON o.root_id = r.root_id AND o.epoch_id = e.epoch_id LEFT JOIN t ON t.epoch_id = e.epoch_id")
def epoch_presence(spark, sf_dir):
    return epochs.presence(plays_view(spark, sf_dir), members(spark, sf_dir), third_ranges(spark, sf_dir))


@query(f"WITH {PLAYS}, {MEMBERS}, {THIRDS}, codes AS (SELECT track_id, min(code) AS code FROM (SELECT track_id, dense_rank() OVER (ORDER BY root_id) AS code FROM members) GROUP BY 1), c AS (SELECT epoch_id, coalesce(code, 0) AS code, count(*) AS n FROM timed LEFT JOIN codes USING (track_id) GROUP BY ALL), d AS (SELECT epoch_id, string_agg(code, ',' ORDER BY n DESC, code) AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY n DESC, code) AS i FROM c WHERE code > 0) WHERE i <= 2 GROUP BY 1) SELECT epoch_id, CAST(sum(n) AS BIGINT) AS n_events, any_value(dominant) AS dominant FROM c JOIN d USING (epoch_id) GROUP BY 1")
def dominant_roots(spark, sf_dir):
    coded = epochs.coded_plays(plays_view(spark, sf_dir), members(spark, sf_dir))
    return epochs.epoch_table(coded, third_ranges(spark, sf_dir)).select("epoch_id", "n_events", "dominant")


CANDIDATE_SQL = "cand AS (SELECT 'c' || p_partkey AS candidate_id, p_size * 3 AS evidence_count, p_size / 50.0::DOUBLE AS coverage, (p_partkey % 100) / 100.0::DOUBLE AS confidence, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS score, p_partkey % 3 <> 0 AS gate FROM part), f AS (SELECT *, list_filter([CASE WHEN coverage < 0.5 THEN 'coverage_floor' END, CASE WHEN confidence < 0.6 THEN 'confidence_floor' END, CASE WHEN gate AND score IS NOT NULL THEN CASE WHEN score < 0.5 THEN 'temporal_stability' END ELSE 'temporal_stability_not_evaluated' END], lambda x: x IS NOT NULL) AS failed FROM cand)"


def classified(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), k).alias("candidate_id"), F.lit("audio").alias("category"), (F.col("p_size") * 3).cast("bigint").alias("evidence_count"), (F.col("p_size") / 50.0).alias("coverage"), ((k % 100) / 100.0).alias("confidence"), F.when(k % 7 != 0, (k % 10) / 10.0).alias("stability_score"), F.when(k % 3 != 0, 1001).otherwise(1000).alias("n_unique"), F.lit(181).alias("span_days"))
    return validate.classify(rows)


VERDICT = "CASE WHEN evidence_count < 50 THEN 'rejected:calibration' WHEN coverage < 0.3 THEN 'rejected:coverage_floor' WHEN len(failed) = 0 THEN 'root' ELSE 'tendency' END"


@query(f"WITH {CANDIDATE_SQL} SELECT candidate_id, {VERDICT} AS verdict, array_to_string(failed, ',') AS failed_tests, CASE WHEN gate AND score IS NOT NULL THEN 'evaluated' ELSE 'not_evaluated' END AS stability_status, CASE WHEN gate THEN score END AS stability_score FROM f")
def validator_verdicts(spark, sf_dir):
    return classified(spark, sf_dir).select("candidate_id", "verdict", F.array_join("failed_tests", ",").alias("failed_tests"), "stability_status", "stability_score")


@query(f"WITH {CANDIDATE_SQL} SELECT candidate_id, category, split_part(verdict, ':', 2) AS failed_test FROM (SELECT candidate_id, 'audio' AS category, {VERDICT} AS verdict FROM f) WHERE verdict LIKE 'rejected:%'")
def quality_log(spark, sf_dir):
    return validate.quality_log(classified(spark, sf_dir)).select("candidate_id", "category", "failed_test")


@query("WITH o AS (SELECT DISTINCT n_name AS kind, c_custkey AS key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0), n AS (SELECT DISTINCT n_name AS kind, c_custkey AS key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 <> 0) SELECT coalesce(o.kind, n.kind) AS kind, count(*) FILTER (o.key IS NULL) AS added, count(*) FILTER (n.key IS NULL) AS removed FROM o FULL JOIN n ON o.kind = n.kind AND o.key = n.key GROUP BY 1")
def library_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("kind"), F.col("c_custkey").alias("key"))
    return library.diff_counts(c.where("key % 3 <> 0"), c.where("key % 5 <> 0"))


@query(f"WITH {PLAYS}, r AS (SELECT user_id, seq, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY played_at, seq)) SELECT user_id, count(*) FILTER (i <= n // 2) AS first_half, count(*) FILTER (i > n // 2) AS second_half, CAST(sum(seq) FILTER (i <= n // 2) AS BIGINT) AS first_seq FROM r GROUP BY 1")
def split_half(spark, sf_dir):
    halves = sweep.split_halves(plays_view(spark, sf_dir), "user_id")
    return halves.groupBy("user_id").agg(F.count_if(F.col("half") == 1).alias("first_half"), F.count_if(F.col("half") == 2).alias("second_half"), F.sum(F.when(F.col("half") == 1, F.col("seq"))).alias("first_seq"))


@query("WITH a AS (SELECT p_partkey AS pair, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS pair, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'x' END AS v FROM part WHERE p_partkey % 5 <> 0) SELECT count(*) AS n, round(avg(CASE WHEN coalesce(a.v, 'absent') = coalesce(b.v, 'absent') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM a FULL JOIN b USING (pair)")
def agreement_rate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair"), F.col("p_brand").alias("verdict"))
    other = p.withColumn("verdict", F.when(F.col("pair") % 2 == 0, F.col("verdict")).otherwise("x"))
    return rounded(library.agreement(p.where("pair % 3 <> 0"), other.where("pair % 5 <> 0")), "rate")


@query("SELECT l_shipdate IS NOT NULL AS ok, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").isNotNull().alias("ok"), "l_extendedprice")
    found = quantiles.percentiles(lines, "l_extendedprice", ["ok"], {"p50": 0.5, "p95": 0.95})
    return rounded(found.join(lines.groupBy("ok").agg(F.avg("l_extendedprice").alias("mean")), "ok"), "p50", "p95", "mean", digits=4)


@query(f"WITH {PLAYS}, {MEMBERS}, cfg AS (SELECT * FROM (VALUES (0, false), (5000, false), (10000, false), (20000, false), (30000, false), (45000, false), (60000, false), (90000, false), (30000, true)) x(min_ms, ignore_skip)) SELECT min_ms, ignore_skip, root_id, count(*) AS n FROM plays JOIN members USING (track_id), cfg WHERE NOT (ms_played < min_ms) AND (ignore_skip OR NOT skipped) GROUP BY ALL")
def validity_sweep(spark, sf_dir):
    return sweep.root_counts(plays_view(spark, sf_dir), members(spark, sf_dir))


@query("WITH r AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'bad ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS raw_time, event_type, ts FROM events), x AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'no_identity' WHEN raw_time LIKE 'bad%' THEN 'unparseable_timestamp' END AS reason FROM r) SELECT reason, count(*) AS n, coalesce(array_to_string((list(raw_time ORDER BY seq) FILTER (reason = 'unparseable_timestamp'))[1:5], '|'), '') AS samples FROM x WHERE reason IS NOT NULL GROUP BY 1")
def reject_ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("bad "), "event_id")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    rows = e.select(F.col("event_id").alias("seq"), raw.alias("raw_time"), "event_type")
    reason = F.when(F.col("event_type") == "signup", "no_identity").when(times.parse_minutes(F.col("raw_time")).isNull(), "unparseable_timestamp")
    return plays.reject_ledger(rows.withColumn("reason", reason))


@query("SELECT event_id AS seq, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minutes, CAST(ts AS TIMESTAMP) AS iso, CASE WHEN event_id % 2 = 0 THEN CAST(date_trunc('minute', ts) AS TIMESTAMP) END AS long_date FROM events")
def parse_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    long_text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "MMMM dd, yyyy 'at' hh:mma")).otherwise(F.date_format("ts", "MMMM dd, yyyy"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return e.select(F.col("event_id").alias("seq"), times.parse_minutes(F.date_format("ts", "yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("minutes"), times.parse_iso(iso).cast("timestamp_ntz").alias("iso"), times.parse_long_date(long_text).cast("timestamp_ntz").alias("long_date"))


@query(f"WITH {PLAYS}, {MEMBERS}, {LIFT}, c AS (SELECT *, round(n / events_r::DOUBLE, 6) AS share FROM lifts WHERE n >= 5 AND lift >= 1.1) SELECT root_id, day_part, weekday_kind, season, CASE WHEN n < 6 THEN 'rejected:calibration' ELSE 'tendency' END AS verdict, round(share, 6) AS cluster_share FROM c")
def temporal_verdicts(spark, sf_dir):
    lifts = temporal.lift_table(bucketed(spark, sf_dir), members(spark, sf_dir), params=LOW_FLOOR)
    facts = F.broadcast(plays.facts(plays_view(spark, sf_dir)).select("n_unique", "span_days"))
    done = validate.classify(temporal.candidates(lifts).crossJoin(facts), ValidationParams(evidence_count=6))
    return done.select("root_id", *temporal.BUCKET, "verdict", "cluster_share")


@query(f"WITH {PLAYS}, {MEMBERS}, {LIFT} SELECT concat_ws('|', root_id, day_part, weekday_kind, season) AS pair, CASE WHEN n < 5 THEN 'dropped:event_count_floor' WHEN lift < 1.1 THEN 'rejected:lift_floor' ELSE 'tendency' END AS verdict, CASE WHEN n >= 5 THEN round(lift, 6) END AS lift, n AS evidence_count FROM lifts WHERE n <> 5 OR lift < 1.1")
def sweep_verdicts(spark, sf_dir):
    lifts = temporal.lift_table(bucketed(spark, sf_dir), members(spark, sf_dir), params=LOW_FLOOR)
    return rounded(sweep.candidate_verdicts(lifts, plays.facts(plays_view(spark, sf_dir)), ValidationParams(evidence_count=6)), "lift")


@query("WITH o AS (SELECT o_custkey AS k, max(o_orderdate) AS seen, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) SELECT coalesce(k, c_custkey) AS k, CAST(seen AS VARCHAR) AS seen, coalesce(n, 0) AS n FROM customer FULL JOIN o ON k = c_custkey")
def versioned_upsert(spark, sf_dir):
    # All customers as the first version, then those with orders anew in a second one.
    versions = VersionedTable(spark, shared_path(spark, "versions"), "k bigint, seen string, n bigint", ["k"], 16)
    none = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(None).cast("string").alias("seen"), F.lit(0).cast("bigint").alias("n"))
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").cast("string").alias("seen"), F.count("*").alias("n"))
    versions.change(lambda c: c.replace(none))
    versions.change(lambda c: c.upsert(seen))
    return versions.read()


@query()
def profile_summary(spark, sf_dir):
    from listenlake.plans.analyze import Inputs, analyze

    # The plan wants one id for a track everywhere; plays name the first hundred.
    def name(k):
        return F.format_string("t%03d", k)

    r = records(spark, sf_dir).withColumn("track_id", name("k")).withColumn("artist", F.concat(F.lit("Artist "), F.col("k") % 7))
    said = F.filter(F.array("lang", "source"), lambda t: t.isNotNull())
    tags = table(spark, sf_dir, "documents").select(name("doc_id").alias("track_id"), F.transform(said, lambda t: F.struct(t.alias("tag"), F.lit(1.0).alias("weight"))).alias("tags"))
    inputs = Inputs(plays=plays_view(spark, sf_dir), records=r, tags=tags, zones=zones(spark))
    return analyze(inputs, audio_params=AudioParams(min_cluster_size=5, min_samples=2), temporal_params=LOW_FLOOR, epoch_params=SHORT, validation=ValidationParams(evidence_count=5)).summary


NAMES = "names AS (SELECT n_nationkey AS k, CASE k_ WHEN 0 THEN n_name || ' Straße' WHEN 1 THEN lower(n_name) || ' STRASSE' WHEN 2 THEN 'ﬁn ' || n_name ELSE n_name END AS name FROM (SELECT *, n_nationkey % 4 AS k_ FROM nation))"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names with letters whose full case folding is not their lower case."""
    n, k = F.col("n_name"), F.col("n_nationkey") % 4
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.when(k == 0, F.concat(n, F.lit(" Straße"))).when(k == 1, F.concat(F.lower(n), F.lit(" STRASSE"))).when(k == 2, F.concat(F.lit("ﬁn "), n)).otherwise(n).alias("name"))


@query(f"WITH {NAMES} SELECT k, 'name:' || replace(replace(lower(name), 'ß', 'ss'), 'ﬁ', 'fi') AS artist_key, replace(replace(lower(name), 'ß', 'ss'), 'ﬁ', 'fi') AS through_python FROM names")
def folded_names(spark, sf_dir):
    return names(spark, sf_dir).select("k", keys.artist_key(F.lit(None).cast("string"), F.col("name")).alias("artist_key"), keys.casefold("name").alias("through_python"))


@query(f"WITH {NAMES} SELECT k, url_encode(name || '~*+ /&é') AS quoted, 'x' || k AS bare FROM names")
def percent_encoding(spark, sf_dir):
    return names(spark, sf_dir).select("k", keys.quoted(F.concat("name", F.lit("~*+ /&é"))).alias("quoted"), keys.bare_spotify_id(F.concat(F.when(F.col("k") % 2 == 0, "spotify:track:").otherwise(""), F.lit("x"), F.col("k").cast("string"))).alias("bare"))


@query("SELECT l_orderkey, l_linenumber, round_even((l_linenumber + l_quantity) / 8.0::DOUBLE, 2) AS even FROM lineitem")
def half_even_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", keys.half_even((F.col("l_linenumber") + F.col("l_quantity")) / F.lit(8.0), 2).alias("even"))


@query(f"WITH {PLAYS}, z(country, zone) AS (VALUES {', '.join(f'({c!r}, {n!r})' for c, n in COUNTRY_ZONES.items())}) SELECT coalesce(zone, 'UTC') AS zone, count(*) AS n, (SELECT count(*) FROM z) AS n_zones FROM plays LEFT JOIN z ON country = conn_country GROUP BY 1")
def plays_by_zone(spark, sf_dir):
    z = country_zones(spark)
    counted = plays_view(spark, sf_dir).join(F.broadcast(z), F.col("conn_country") == F.col("country"), "left").groupBy(F.coalesce("zone", F.lit("UTC")).alias("zone")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(z.agg(F.count("*").alias("n_zones"))))


@query("WITH t AS (SELECT p_size % 3 + 2 AS k, p_partkey AS topic, (p_retailprice % 100) / 100.0::DOUBLE - 0.5 AS coherence, lower(p_brand) AS tag FROM part) SELECT 'q-scene-' || topic AS candidate_id, 'scene' AS category, 'coherence_floor' AS failed_test, k, tag FROM t WHERE coherence < 0.15::DOUBLE")
def coherence_rejections(spark, sf_dir):
    t = table(spark, sf_dir, "part").select((F.col("p_size") % 3 + 2).alias("k"), F.col("p_partkey").alias("topic"), ((F.col("p_retailprice") % 100) / 100.0 - 0.5).alias("coherence"), F.lower("p_brand").alias("tag"))
    log = scene.coherence_log(t.select("k", "topic", "coherence"), t.select("k", "topic", F.lit(1).alias("rank"), "tag"), 0.15)
    return log.select("candidate_id", "category", "failed_test", F.get_json_object("details", "$.K").cast("bigint").alias("k"), F.get_json_object("details", "$.top_tags[0]").alias("tag"))


DOCUMENTS = """docs AS (SELECT printf('mb%05d', vec_id) AS mbid, vec_id AS k, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id AS DOUBLE) / 8 END AS happy, CASE WHEN vec_id % 4 = 1 THEN CAST(vec_id AS DOUBLE) / 4 END AS danceable, CASE WHEN vec_id % 5 <> 0 THEN CAST(vec_id + 60 AS DOUBLE) END AS bpm FROM embeddings),
  scalars AS (SELECT mbid, k, happy, danceable, CASE WHEN k % 2 = 0 THEN bpm END AS bpm FROM docs WHERE k % 7 <> 0)"""


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """High-level and low-level answers of the feature service as JSON, and all ids."""
    k = F.col("vec_id")
    d = table(spark, sf_dir, "embeddings").select(F.format_string("mb%05d", k).alias("mbid"), k.alias("k"), F.when(k % 3 != 0, k / 8).alias("happy"), F.when(k % 4 == 1, k / 4).alias("danceable"), F.when(k % 5 != 0, (k + 60).cast("double")).alias("bpm"))

    def nested(name: str, leaf: str):
        return F.struct(F.struct(F.col(leaf).alias(leaf)).alias("all")).alias(name)

    high = d.where("k % 7 <> 0").select("mbid", F.to_json(F.struct(F.struct(nested("mood_happy", "happy"), nested("danceability", "danceable")).alias("highlevel"))).alias("document"))
    low = d.where("k % 2 = 0").select("mbid", F.to_json(F.struct(F.struct("bpm").alias("rhythm"))).alias("document"))
    return high, low, d


@query(f"WITH {DOCUMENTS} SELECT mbid, happy, danceable, bpm, coalesce(happy, danceable, bpm) IS NOT NULL AS hit FROM scalars")
def raw_scalars(spark, sf_dir):
    high, low, _ = documents(spark, sf_dir)
    return listening.raw_scalars(high, low).select("mbid", "happy", "danceable", "bpm", "hit")


@query(f"WITH {DOCUMENTS} SELECT mbid, bpm, happy AS valence, danceable AS danceability FROM scalars WHERE coalesce(happy, danceable, bpm) IS NOT NULL")
def features_of_scalars(spark, sf_dir):
    high, low, _ = documents(spark, sf_dir)
    return enrich.scalars_to_features(listening.raw_scalars(high, low)).select("mbid", "bpm", "valence", "danceability")


@query(f"WITH {DOCUMENTS}, w AS (SELECT d.mbid, d.k % 11 = 0 AS cached, s.mbid IS NOT NULL AND coalesce(s.happy, s.danceable, s.bpm) IS NOT NULL AS hit FROM docs d LEFT JOIN scalars s USING (mbid)) SELECT count(*) AS asked, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached) AS fetched, count(*) FILTER (NOT cached AND hit) AS hits, count(*) FILTER (NOT cached AND NOT hit) AS misses FROM w")
def index_build_report(spark, sf_dir):
    high, low, d = documents(spark, sf_dir)
    return listening.build_report(d, d.where("k % 11 = 0").select("mbid"), listening.raw_scalars(high, low))


@query("SELECT 'mb' || c_custkey AS mbid, '{\"v\":' || c_custkey || '}' AS document FROM customer WHERE c_custkey % 3 <> 0")
def service_answers(spark, sf_dir):
    c = F.col("c_custkey").cast("string")
    inner = F.when(F.col("c_custkey") % 3 == 0, F.lit('["x"]')).otherwise(F.concat(F.lit('{"0":{"v":'), c, F.lit('},"1":{"v":0}}')))
    payload = F.concat(F.lit('{"mb'), c, F.lit('":'), inner, F.lit(',"mbid_mapping":{"0":{"a":1}}}'))
    return readers.response_documents(table(spark, sf_dir, "customer").select(payload.alias("payload")))


@query("SELECT 'c' || c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 + c_custkey % 2 END AS n, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(c_mktsegment) END AS first FROM customer")
def release_styles(spark, sf_dir):
    c, styles = F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lower("c_mktsegment"))).otherwise(F.array(F.lower("c_mktsegment"), F.lit("z")))
    found = F.to_json(F.struct(F.array(F.struct(styles.alias("style")), F.struct(F.array(F.lit("other")).alias("style"))).alias("results")))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c).alias("key"), F.when(c % 4 == 0, F.lit('{"results":[]}')).otherwise(found).alias("payload"))
    return enrich.style_tags(rows).select("key", F.size("tags").alias("n"), F.get("tags", F.lit(0))["tag"].alias("first"))


@query("WITH r AS (SELECT n_name AS key, n_nationkey AS k FROM nation), c AS (SELECT * FROM r WHERE k % 2 = 0) SELECT r.key, CASE WHEN k % 4 = 0 THEN 'cached' ELSE 'fresh' END AS origin, k % 4 = 0 OR k % 3 = 0 AS kept FROM r")
def identity_cache(spark, sf_dir):
    refs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("input_key"), F.col("n_nationkey").alias("k"))
    cache = refs.where("k % 2 = 0").select("input_key", F.lit("cached").alias("mbid"), F.when(F.col("k") % 4 == 0, "mbid").otherwise("isrc").alias("level"))
    done, kept = identity.with_cache(refs, cache, lambda r: r.select("input_key", F.lit("fresh").alias("mbid"), F.when(F.col("k") % 3 == 0, "mbid").otherwise("name").alias("level")))
    return done.join(kept.select("input_key", F.lit(True).alias("kept")), "input_key", "left").select(F.col("input_key").alias("key"), F.col("mbid").alias("origin"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("WITH a AS (SELECT DISTINCT c_mktsegment AS key FROM customer), m AS (SELECT DISTINCT CASE WHEN n_nationkey % 5 = 0 THEN 'BUILDING' ELSE n_name END AS key FROM nation) SELECT key, CASE WHEN key IN (SELECT key FROM a) THEN 'library' ELSE 'marquee' END AS origin FROM (SELECT key FROM a UNION SELECT key FROM m)")
def artists_and_marquee(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("seq"), F.lit("library").alias("origin"))
    m = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, "BUILDING").otherwise(F.col("n_name")).alias("key"), F.col("n_nationkey").alias("seq"), F.lit("marquee").alias("origin"))
    return identity.all_artists(a, m).select("key", "origin")


@query(f"WITH {PLAYS}, r AS (SELECT *, CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN 'mbid:m' || k WHEN k % 4 <> 0 THEN 'isrc:i' || k ELSE 'name:' || lower(name) || chr(31) || lower(artist) END AS track FROM plays) SELECT track, count(*) AS n, CASE WHEN track LIKE 'mbid%' THEN 'mbid' WHEN track LIKE 'isrc%' THEN 'isrc' ELSE 'name' END AS level FROM r GROUP BY 1")
def plays_of_resolved_tracks(spark, sf_dir):
    nothing = F.lit(None).cast("string")
    events = plays_view(spark, sf_dir).withColumn("isrc", nothing).withColumn("mbid", nothing)
    isrcs = events.where("spotify_id is not null").select("spotify_id", F.concat(F.lit("i"), "k").alias("isrc"), "k").distinct()
    index = isrcs.where("k % 3 = 0").select("isrc", F.concat(F.lit("m"), "k").alias("mbid"))
    refs = identity.track_refs(events)
    done = identity.resolve(refs, index, isrcs.select("spotify_id", "isrc"))
    raw = events.withColumn("track_id", keys.track_id(*(F.col(c) for c in ("spotify_id", "isrc", "mbid", "name", "artist"))))
    rekeyed = identity.rekey(raw, done).groupBy(F.col("track_id").alias("track")).agg(F.count("*").alias("n"))
    return rekeyed.join(done.select(F.col("canonical_id").alias("track"), "level").distinct(), "track")


@query("WITH r AS (SELECT l_linenumber AS g, l_quantity AS clip, l_extendedprice / 10000 AS s, 100.0 * l_linenumber AS rss FROM lineitem), x AS (SELECT g, count(*) AS n, quantile_cont(s, 0.95) AS p95, min(clip) AS c, max(rss) AS m FROM r GROUP BY 1) SELECT g, n, round(p95, 6) AS p95, round(p95 / c, 6) AS realtime_ratio, n >= 50 AND p95 / c <= 0.5 AND m <= 1500 AS sustainable FROM x")
def realtime_verdict(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("clip_seconds"), (F.col("l_extendedprice") / 10000).alias("latency_seconds"), (F.col("l_linenumber") * F.lit(100.0)).alias("rss_mb"))
    return rounded(latency.latency_report(r, "g"), "p95", "realtime_ratio").select("g", "n", "p95", "realtime_ratio", "sustainable")


@query("WITH o AS (SELECT o_orderkey AS seq, o_orderpriority AS reason FROM orders) SELECT coalesce(r, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN seq % 5 = 0 THEN 'no_identity' WHEN seq % 7 = 0 THEN 'unparseable_timestamp' WHEN o_orderdate <= TIMESTAMP '1995-06-17' THEN 'before_cutoff' END AS r FROM (SELECT o_orderkey AS seq, o_orderdate FROM orders)) GROUP BY 1")
def account_rejects(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(F.when(k % 5 == 0, "").otherwise("a").alias("artistName"), F.when(k % 5 == 0, None).otherwise("t").alias("trackName"), F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("endTime"), F.lit("9").alias("msPlayed"), k.alias("seq"))
    edge = spark.sql("SELECT TIMESTAMP '1995-06-17' AS cutoff")
    return readers.account_rows(rows, None, edge).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'spotify:episode:' || c_custkey ELSE 'spotify:track:' || c_custkey END AS uri FROM customer) SELECT CASE WHEN starts_with(uri, 'spotify:track:') THEN substr(uri, 15) END AS spotify_id, count(*) AS n FROM t GROUP BY 1")
def track_uris(spark, sf_dir):
    c = F.col("c_custkey")
    uri = F.concat(F.when(c % 3 == 0, "spotify:episode:").otherwise("spotify:track:"), c.cast("string"))
    return table(spark, sf_dir, "customer").groupBy(keys.uri_tail(uri).alias("spotify_id")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS name, regexp_replace(n_name || ' é/x', '[^A-Za-z0-9._-]+', '_', 'g') AS safe, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE -1 END AS whole FROM nation")
def names_and_numbers(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), keys.safe_name(F.concat("n_name", F.lit(" é/x"))).alias("safe"), F.coalesce(readers.whole_number(F.when(F.col("n_nationkey") % 2 == 0, k).otherwise(F.concat(k, F.lit(".5")))), F.lit(-1)).alias("whole"))
