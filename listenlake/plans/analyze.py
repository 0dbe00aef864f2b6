"""The whole analysis: audio, then scene, then temporal roots and epochs, each candidate validated, and one profile."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.functions.keys import filled, folded, track_id
from listenlake.operators import audio, enrich, epochs, identity, plays, scene, temporal, validate
from listenlake.shared import stored
from listenlake.params import AudioParams, EpochParams, SceneParams, TemporalParams, ValidationParams


@dataclass(frozen=True)
class Inputs:
    """plays (seq, track_id, played_at, source, ms_played, skipped, conn_country), records (track_id, artist, features), tags (track_id, tags) and zones."""

    plays: DataFrame
    records: DataFrame | None
    tags: DataFrame | None
    zones: DataFrame


@dataclass(frozen=True)
class Profile:
    """``quality_log`` has the order of its entries in stage (audio, scene, temporal) and phase (a stage's own floors before the validator's)."""

    classified: DataFrame
    epochs: DataFrame
    presence: DataFrame
    quality_log: DataFrame
    summary: DataFrame
    facts: DataFrame
    members: DataFrame
    descriptors: DataFrame
    params: dict

    def document(self, snapshot_id: str, diagnostics: dict[str, DataFrame] | None = None) -> DataFrame:
        """One row: the profile as JSON, with the facts of its data, its parameters, and diagnostics such as enrichment buckets."""
        parts = {"candidates": self.classified, "descriptors": self.descriptors, "epochs": self.epochs, "presence": self.presence, "quality_log": self.quality_log.select("stage", "phase", "candidate_id", "category", "failed_test", "details"), "generated_from": self.facts} | (diagnostics or {})
        row = None
        for name, df in parts.items():
            one = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias(name))
            row = one if row is None else row.crossJoin(one)
        return row.withColumn("method_params", F.lit(json.dumps(self.params, default=str))).withColumn("snapshot_id", F.lit(snapshot_id)).withColumn("schema_version", F.lit("v0"))


COLUMNS = ["candidate_id", "category", "cluster_size", "cluster_share", "evidence_count", "coverage", "confidence", "stability_score"]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: without this a stage's plan holds those of all stages before it."""
    return stored(df, "analyze")


@dataclass(frozen=True)
class Roots:
    """Audio and scene candidates with verdicts, the members of those that stay, descriptors, and what the scene's own floor rejected (or None)."""

    classified: DataFrame
    members: DataFrame
    descriptors: DataFrame
    rejected: DataFrame | None


def described_as_json(described: DataFrame) -> DataFrame:
    return described.select("candidate_id", F.to_json(F.struct(*(c for c in described.columns if c not in COLUMNS))).alias("descriptor"))


def audio_roots(records: DataFrame, listened: DataFrame, params: AudioParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, descriptors and members of the density clusters of all records."""
    clusters = cut(audio.cluster(records, params))
    described = cut(audio.describe(clusters, listened, params))
    members = clusters.join(described.select("cluster", "candidate_id"), "cluster").select(F.col("candidate_id").alias("root_id"), "track_id")
    return described.select(*COLUMNS), described_as_json(described), members


def scene_roots(records: DataFrame, tagged: DataFrame, listened: DataFrame, params: SceneParams) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates, descriptors and members of the topics of the best K, and its topics under the coherence floor."""
    tags = cut(scene.doc_tags(tagged))
    weights = cut(scene.factor(tags, params))
    top = cut(scene.top_tags(weights.where("part = 'tag'").select(F.struct("k", "topic").alias("topic"), F.col("name").alias("tag"), "weight"), params.top_tags))
    scored = cut(scene.coherence(top.select("topic", "tag"), tags).select("topic.k", F.col("topic.topic").alias("topic"), "coherence"))
    chosen = F.broadcast(scene.best_k(scored, params.coherence_floor).select("k"))
    flat = top.select("topic.k", F.col("topic.topic").alias("topic"), "rank", "tag")
    low = scene.coherence_log(scored.join(chosen, "k"), flat, params.coherence_floor)
    good = scored.where(F.col("coherence") >= params.coherence_floor).join(chosen, "k").select("k", "topic")
    assigned = scene.assign(weights.where("part = 'doc'").join(chosen, "k").select(F.col("name").alias("doc"), "topic", "weight"))
    own = cut(assigned.join(good.select("topic"), "topic", "left_semi"))
    described = scene.describe(own, records.select("track_id", "artist"), tags.select("doc").distinct().count(), params)
    stable = audio.stability(own.select("topic", F.col("doc").alias("track_id")), listened, "topic")
    hints = scene.hints(flat.join(chosen, "k").select("topic", "rank", "tag"))
    described = cut(described.join(stable, "topic", "left").withColumn("stability_score", F.col("balance")).join(hints, "topic", "left"))
    members = own.join(described.select("topic", "candidate_id"), "topic").select(F.col("candidate_id").alias("root_id"), F.col("doc").alias("track_id"))
    return described.select(*COLUMNS), described_as_json(described), members, low


def upstream(inputs: Inputs, listened: DataFrame, audio_params: AudioParams = AudioParams(), scene_params: SceneParams = SceneParams(), validation: ValidationParams = ValidationParams()) -> Roots:
    """The audio and scene stages and their verdicts: what the temporal stage, and any sweep over it, is conditioned on."""
    spark = listened.sparkSession
    found, low = [], None
    if inputs.records is not None and "bpm" in inputs.records.columns:
        found.append(audio_roots(inputs.records, listened, audio_params))
    if inputs.tags is not None:
        *own, low = scene_roots(inputs.records, inputs.tags, listened, scene_params)
        found.append(own)
    if not found:
        empty = "candidate_id string, category string, cluster_size bigint, cluster_share double, evidence_count bigint, coverage double, confidence double, stability_score double"
        found = [tuple(spark.createDataFrame([], x) for x in (empty, "candidate_id string, descriptor string", "root_id string, track_id string"))]
    candidates, descriptors, bridge = found[0]
    for more in found[1:]:
        candidates, descriptors, bridge = (x.unionByName(y) for x, y in zip((candidates, descriptors, bridge), more, strict=True))
    classified = cut(validate.classify(candidates.crossJoin(F.broadcast(plays.facts(listened).select("n_unique", "span_days"))), validation))
    return Roots(classified, cut(validate.surviving_members(bridge, classified)), descriptors, low)


def analyze(inputs: Inputs, audio_params: AudioParams = AudioParams(), scene_params: SceneParams = SceneParams(), temporal_params: TemporalParams = TemporalParams(), epoch_params: EpochParams = EpochParams(), validation: ValidationParams = ValidationParams()) -> Profile:
    """Stages that find nothing give empty frames; temporal stages run on members of surviving roots only."""
    listened = cut(inputs.plays)
    roots = upstream(inputs, listened, audio_params, scene_params, validation)
    facts = F.broadcast(plays.facts(listened).select("n_unique", "span_days"))
    localized = cut(temporal.localize(listened, inputs.zones))
    valid = localized.where(plays.is_valid(F.col("ms_played"), F.col("skipped")))
    lifts = cut(temporal.lift_table(temporal.with_buckets(valid, "local_at", temporal_params), roots.members, "local_at", temporal_params))
    timed = validate.classify(temporal.candidates(lifts).select(*COLUMNS).crossJoin(facts), validation)
    everything = cut(roots.classified.unionByName(timed))
    rejected = temporal.ranked(lifts).where("verdict = 'rejected:lift_floor'").select("candidate_id", F.lit("temporal").alias("category"), F.lit("lift_floor").alias("failed_test"), F.to_json(F.struct("lift", F.lit(temporal_params.lift_floor).alias("floor"), "root_id", *temporal.BUCKET)).alias("details"))
    ranges, table = epochs.detect(localized, roots.members, "local_at", epoch_params)
    present = epochs.presence(localized, roots.members, ranges, "local_at")
    stage = F.when(F.col("category") == "audio", 0).when(F.col("category") == "scene", 1).otherwise(2)
    own_floors = rejected if roots.rejected is None else rejected.unionByName(roots.rejected)
    log = own_floors.withColumn("phase", F.lit(0)).unionByName(validate.quality_log(everything, validation).withColumn("phase", F.lit(1))).withColumn("stage", stage)
    summary = everything.groupBy("category", "verdict").agg(F.count("*").alias("n"))
    chosen_params = {n: asdict(p) for n, p in (("audio", audio_params), ("scene", scene_params), ("temporal", temporal_params), ("epoch", epoch_params), ("validation", validation))}
    return Profile(everything, table, present, log, summary, plays.facts(listened), roots.members, roots.descriptors.unionByName(temporal.descriptors(lifts)), chosen_params)


FEATURES = ("bpm", "energy", "valence", "danceability", "acousticness", "instrumentalness")


def enriched(events: DataFrame, zones: DataFrame, isrc_index: DataFrame, features: DataFrame | None, tag_sources: tuple[DataFrame, ...] = (), spotify_isrc: DataFrame | None = None, covered: DataFrame | None = None) -> tuple[Inputs, dict[str, DataFrame]]:
    """What ``analyze`` takes, from raw events (seq, spotify_id, isrc, mbid, name, artist, played_at, source, ms_played, skipped, conn_country).

    Every raw identity walks up the waterfall once, plays get the canonical id, and the
    tracks are enriched by MBID (``features``) and by folded artist (``tag_sources``: key,
    tags). A stage without its source is left out. Also the counts of levels and buckets.
    """
    refs = cut(identity.track_refs(events))
    resolved = cut(identity.resolve(refs, isrc_index, spotify_isrc, covered))
    raw = events.withColumn("track_id", track_id(*(filled(F.col(c)) for c in ("spotify_id", "isrc", "mbid")), F.col("name"), F.col("artist")))
    listened = identity.rekey(raw, resolved).select("seq", "track_id", "played_at", "source", "ms_played", "skipped", "conn_country")
    tracks = cut(identity.metadata_records(resolved, F.current_timestamp()))
    diagnostics = {"identity": identity.level_report(resolved)}
    records = tags = None
    if features is not None:
        bare = tracks.select("*", *(F.lit(None).cast("double").alias(f) for f in FEATURES))
        records = cut(enrich.enrich_audio(bare, features, FEATURES))
        diagnostics["audio"] = enrich.bucket_counts(records)
    if tag_sources:
        keyed = tracks.select("track_id", folded(F.col("artist")).alias("key"), F.array().cast("array<struct<tag:string,weight:double>>").alias("tags"))
        tagged = cut(enrich.enrich_tags(keyed, *tag_sources))
        diagnostics["tags"] = enrich.bucket_counts(tagged)
        tags = tagged.where(F.size("tags") > 0).select("track_id", "tags")
    return Inputs(listened, records if records is not None or tags is None else tracks, tags, zones), diagnostics
