"""The validity-floor sweep: one pass over plays for all configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.operators import temporal, validate
from listenlake.operators.library import agreement
from listenlake.operators.plays import facts, is_valid
from listenlake.operators.temporal import localize
from listenlake.params import AudioParams, SceneParams, TemporalParams, ValidationParams
from listenlake.plans.analyze import Inputs, Profile, upstream
from listenlake.shared import stored

CONFIGS = tuple((ms, False) for ms in (0, 5_000, 10_000, 20_000, 30_000, 45_000, 60_000, 90_000)) + ((30_000, True),)


def configured(plays: DataFrame, configs) -> DataFrame:
    """Each play beside the configurations under which it is valid; their list is a literal of a few entries."""
    listed = F.explode(F.array(*(F.struct(F.lit(ms).alias("min_ms"), F.lit(skip).alias("ignore_skip")) for ms, skip in configs))).alias("c")
    wide = plays.select("*", listed).select(*plays.columns, "c.*")
    short = F.coalesce(F.col("ms_played") < F.col("min_ms"), F.lit(False))
    return wide.where(~short & (F.col("ignore_skip") | ~F.coalesce("skipped", F.lit(False))))


def root_counts(plays: DataFrame, members: DataFrame, configs=CONFIGS) -> DataFrame:
    """Valid plays per configuration and root; plays are counted per track before they meet the roots."""
    per_track = plays.groupBy("track_id", "ms_played", "skipped").agg(F.count("*").alias("n"))
    own = configured(per_track, configs).groupBy("min_ms", "ignore_skip", "track_id").agg(F.sum("n").alias("n"))
    return own.join(members.select("root_id", "track_id").distinct(), "track_id").groupBy("min_ms", "ignore_skip", "root_id").agg(F.sum("n").alias("n"))


def candidate_verdicts(lifts: DataFrame, facts: DataFrame, validation: ValidationParams = ValidationParams()) -> DataFrame:
    """pair, verdict, lift, evidence_count of a lift table: root or tendency by the classifier, then what the lift floor rejected and what the count floor dropped. Candidates that the classifier rejects are in no row."""
    pair = F.concat_ws("|", "root_id", *temporal.BUCKET).alias("pair")
    named = temporal.candidates(lifts).join(temporal.ranked(lifts).where("verdict = 'candidate'").select("candidate_id", "lift"), "candidate_id")
    judged = validate.survivors(validate.classify(named.crossJoin(F.broadcast(facts.select("n_unique", "span_days"))), validation))
    floors = lifts.where("verdict <> 'candidate'").select(pair, "verdict", F.when(F.col("verdict") == "rejected:lift_floor", F.col("lift")).alias("lift"), F.col("n").alias("evidence_count"))
    return judged.select(pair, "verdict", "lift", "evidence_count").unionByName(floors)


def verdict_tables(plays: DataFrame, members: DataFrame, configs=CONFIGS, params: TemporalParams = TemporalParams(), validation: ValidationParams = ValidationParams()) -> dict[tuple, DataFrame]:
    """pair, verdict per configuration. Plays get their buckets once, and are read from a table after that; the classifier's facts are those of all plays."""
    bucketed = stored(temporal.with_buckets(plays, params=params), "sweep")
    whole = stored(facts(plays.withColumn("source", F.lit(""))), "facts")
    out = {}
    for ms, skip in configs:
        lifts = temporal.lift_table(bucketed.where(is_valid(F.col("ms_played"), F.col("skipped"), ms, skip)), members, params=params)
        out[ms, skip] = candidate_verdicts(stored(lifts, "lifts"), whole, validation)
    return out


def report(plays: DataFrame, members: DataFrame, configs=CONFIGS, params: TemporalParams = TemporalParams(), validation: ValidationParams = ValidationParams()) -> DataFrame:
    """Agreement of every configuration with the first."""
    tables = {c: stored(t, "verdicts") for c, t in verdict_tables(plays, members, configs, params, validation).items()}
    first, out = tables[configs[0]], None
    for c in configs:
        row = agreement(first, tables[c]).withColumn("min_ms", F.lit(c[0])).withColumn("ignore_skip", F.lit(c[1]))
        out = row if out is None else out.unionByName(row)
    return out


def sweep(inputs: Inputs, configs=CONFIGS, audio_params: AudioParams = AudioParams(), scene_params: SceneParams = SceneParams(), temporal_params: TemporalParams = TemporalParams(), validation: ValidationParams = ValidationParams()) -> DataFrame:
    """The report over raw inputs: audio and scene run once, and every configuration meets the same members."""
    listened = stored(inputs.plays, "plays")
    members = upstream(inputs, listened, audio_params, scene_params, validation).members
    local = stored(localize(listened, inputs.zones).drop("played_at").withColumnRenamed("local_at", "played_at"), "local")
    return report(local, members, configs, temporal_params, validation)


def write_report(found: DataFrame, path: str) -> None:
    """The report as one JSON file."""
    rows = found.agg(F.to_json(F.array_sort(F.collect_list(F.struct("min_ms", "ignore_skip", "n", "rate")))).alias("value"))
    rows.write.mode("overwrite").text(path)


def surviving(profile: Profile) -> DataFrame:
    """root_id, track_id of the roots and tendencies of one analysis: what all configurations are swept with."""
    return profile.members


def same_epochs(epochs: DataFrame, config: str = "config") -> DataFrame:
    """The epochs, or an error when configurations differ in them: the validity floor must not move epochs."""
    digests = epochs.groupBy(config).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("low", "high", "n_events")))), 256).alias("h"))
    guard = digests.agg(F.countDistinct("h").alias("kinds"))
    return epochs.crossJoin(F.broadcast(guard)).where(F.when(F.col("kinds") <= 1, True).otherwise(F.raise_error(F.lit("epochs differ between validity floors")).cast("boolean"))).drop("kinds")


def split_halves(plays: DataFrame, by: str) -> DataFrame:
    """half 1 or 2 by place in time; with an odd number the first half is the smaller."""
    order = Window.partitionBy(by).orderBy("played_at", "seq")
    at, n = F.row_number().over(order), F.count("*").over(Window.partitionBy(by))
    return plays.withColumn("half", F.when(at <= F.floor(n / 2), 1).otherwise(2))
