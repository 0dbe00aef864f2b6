"""Local time and the lift of roots in calendar buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.times import buckets, micros, wall_clock
from listenlake.params import TemporalParams

BUCKET = ["day_part", "weekday_kind", "season"]
UTC_SOURCES = ("spotify_extended", "spotify_account")


def modal_zone(plays: DataFrame, zones: DataFrame) -> DataFrame:
    """One row: the zone of most plays of the full export; the smallest name wins a tie. The country table is small by nature."""
    own = plays.where(F.col("source") == "spotify_extended").join(F.broadcast(zones), F.upper(F.trim("conn_country")) == F.col("country"))
    return own.groupBy("zone").agg(F.count("*").alias("n")).agg(F.min_by("zone", F.struct(-F.col("n"), "zone")).alias("modal_zone"))


def localize(plays: DataFrame, zones: DataFrame) -> DataFrame:
    """Plays with local_at: sources stamped in UTC move to their own zone, else to the modal one, else stay; others keep their clock. ``shifted`` says which moved."""
    modal = F.broadcast(modal_zone(plays, zones))
    wide = plays.crossJoin(modal).join(F.broadcast(zones), F.upper(F.trim("conn_country")) == F.col("country"), "left")
    zone = F.when(F.col("source").isin(*UTC_SOURCES), F.coalesce("zone", "modal_zone"))
    local = F.coalesce(wall_clock(F.col("played_at"), zone), F.col("played_at").cast("timestamp_ntz"))
    return wide.withColumn("local_at", local).withColumn("shifted", zone.isNotNull()).drop("modal_zone", "zone", "country")


def unshifted(localized: DataFrame) -> DataFrame:
    return localized.where(~F.col("shifted")).groupBy("source").agg(F.count("*").alias("n"))


def with_buckets(plays: DataFrame, at: str = "played_at", params: TemporalParams = TemporalParams()) -> DataFrame:
    return plays.select("*", *buckets(F.col(at), params))


def bucket_totals(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy(*BUCKET).agg(F.count("*").alias("bucket_total"))


def midpoint(plays: DataFrame, at: str = "played_at") -> DataFrame:
    """One row: the middle of the history in microseconds, rounded down."""
    low, high = micros(F.min(at)), micros(F.max(at))
    return plays.agg((low + (high - low - F.pmod(high - low, F.lit(2))) / 2).cast("bigint").alias("middle"))


def balance(before, total):
    """1 - |share before - share after|, or null without plays."""
    return F.round(1 - F.abs(F.try_divide(before, total) - F.try_divide(total - before, total)), 4)


def lift_table(bucketed: DataFrame, members: DataFrame, at: str = "played_at", params: TemporalParams = TemporalParams()) -> DataFrame:
    """Root and bucket pairs with counts, probabilities, lift, balance and verdict.

    Per-bucket counts are taken before anything is joined, so the joins are over a few
    rows per root. A play counts once for each root its track is in.
    """
    totals = bucket_totals(bucketed)
    middle = F.broadcast(midpoint(bucketed, at))
    # Plays are counted per track and bucket first; the bridge to roots then multiplies counts, not plays.
    per_track = bucketed.crossJoin(middle).groupBy("track_id", *BUCKET).agg(F.count("*").alias("n"), F.count_if(micros(F.col(at)) < F.col("middle")).alias("n_before"))
    pairs = per_track.join(members.select("root_id", "track_id").distinct(), "track_id").groupBy("root_id", *BUCKET).agg(F.sum("n").alias("n"), F.sum("n_before").alias("n_before"))
    events = pairs.groupBy("root_id").agg(F.sum("n").alias("events_r"))
    every = F.broadcast(totals.agg(F.sum("bucket_total").alias("n_total")))
    wide = pairs.join(events, "root_id").join(totals, BUCKET).crossJoin(every)
    wide = wide.withColumn("p_root_overall", F.col("events_r") / F.col("n_total")).withColumn("p_root_given_bucket", F.col("n") / F.col("bucket_total"))
    wide = wide.withColumn("lift", F.try_divide("p_root_given_bucket", "p_root_overall")).withColumn("balance", balance(F.col("n_before"), F.col("n")))
    verdict = F.when(F.col("n") < params.event_count_floor, "dropped:event_count_floor").when(F.col("lift") >= params.lift_floor, "candidate").otherwise("rejected:lift_floor")
    return wide.select("root_id", *BUCKET, "n", "events_r", "bucket_total", "p_root_overall", "p_root_given_bucket", "lift", "balance", verdict.alias("verdict"))


def ranked(lifts: DataFrame) -> DataFrame:
    """Candidates and lift rejections, each numbered by count, root and bucket: r-temporal-N and q-temporal-N."""
    kept = lifts.where("verdict <> 'dropped:event_count_floor'")
    order = Window.partitionBy("verdict").orderBy(F.desc("n"), "root_id", F.concat_ws("|", *BUCKET))
    head = F.when(F.col("verdict") == "candidate", "r-temporal-").otherwise("q-temporal-")
    return kept.withColumn("rank", F.row_number().over(order)).withColumn("candidate_id", F.concat(head, "rank"))


def candidates(lifts: DataFrame) -> DataFrame:
    """Candidates for the validator."""
    rows = ranked(lifts).where("verdict = 'candidate'")
    return rows.select("candidate_id", F.lit("temporal").alias("category"), "root_id", *BUCKET, F.col("n").alias("cluster_size"), F.round(F.col("n") / F.col("events_r"), 6).alias("cluster_share"), F.col("n").alias("evidence_count"), F.lit(1.0).alias("coverage"), F.round("p_root_given_bucket", 6).alias("confidence"), F.col("balance").alias("stability_score"))


def descriptors(lifts: DataFrame) -> DataFrame:
    """candidate_id, descriptor of every temporal candidate: its root, bucket, lift and a hint, as JSON."""
    rows = ranked(lifts).where("verdict = 'candidate'")
    when = F.concat_ws(" ", *BUCKET)
    hint = F.concat(F.lit("play more of "), "root_id", F.lit(" in the "), when, F.lit(": "), F.round("lift", 2).cast("string"), F.lit(" times its usual share"))
    return rows.select("candidate_id", F.to_json(F.struct(F.col("root_id").alias("conditioned_root_id"), F.struct(*BUCKET).alias("time_bucket"), F.round("lift", 4).alias("lift"), F.col("n").alias("events_in_bucket"), hint.alias("hint"))).alias("descriptor"))
