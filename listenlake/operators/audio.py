"""Audio roots: z-scores, density clusters and what describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.keys import band
from listenlake.functions.times import micros
from listenlake.operators.density import DensityParams, density_clusters
from listenlake.operators.temporal import balance, midpoint
from listenlake.params import AudioParams
from listenlake.shared import stored


def has_all(dims: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for d in dims:
        out = out & F.col(d).isNotNull()
    return out


def zscores(records: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """z_<dim> by population deviation; a constant column is all zeros. One small aggregate row is broadcast."""
    facts = F.broadcast(records.agg(*(F.avg(d).alias(f"mean_{d}") for d in dims), *(F.stddev_pop(d).alias(f"std_{d}") for d in dims)))
    wide = records.crossJoin(facts)
    for d in dims:
        wide = wide.withColumn(f"z_{d}", (F.col(d) - F.col(f"mean_{d}")) / F.coalesce(F.nullif(F.col(f"std_{d}"), F.lit(0.0)), F.lit(1.0)))
    return wide.drop(*(f"{k}_{d}" for d in dims for k in ("mean", "std")))


def cluster(records: DataFrame, params: AudioParams = AudioParams(), density: DensityParams = DensityParams()) -> DataFrame:
    """Clusterable records (all cluster dims) with z-scores, cluster (-1 for noise, numbered by the least track) and probability, all in one fit."""
    dims = params.cluster_features
    usable = records.drop("cluster", "probability", *(f"z_{d}" for d in dims)).where(has_all(dims))
    # Stored, so that a vector is the same number whenever it is read.
    wide = stored(zscores(usable, dims).withColumn("zs", F.array(*(F.col(f"z_{d}") + F.lit(0.0) for d in dims))), "zscores")
    found = density_clusters(wide.select(F.col("track_id").alias("id"), F.col("zs").alias("x")), params.min_cluster_size, params.min_samples, density)
    joined = wide.join(found.withColumnRenamed("x", "zs"), "zs", "left")
    return joined.select(*usable.columns, F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("probability"), *(f"z_{d}" for d in dims))


def describe(clustered: DataFrame, plays: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """One row per cluster, ranked by size and smallest id: share, centroid, bands, evidence, coverage, confidence, balance and samples."""
    dims, kept = params.cluster_features, clustered.where("cluster >= 0")
    n = F.broadcast(clustered.agg(F.count_if(F.col("cluster") >= 0).alias("n_clustered")))
    full = F.avg(has_all(params.features).cast("double"))
    base = kept.groupBy("cluster").agg(F.count("*").alias("cluster_size"), F.min("track_id").alias("min_id"), full.alias("coverage"), F.round(F.avg("probability"), 6).alias("confidence"), *(F.avg(d).alias(f"c_{d}") for d in dims)).crossJoin(n)
    rank = F.row_number().over(Window.orderBy(F.desc("cluster_size"), "min_id"))
    base = base.withColumn("candidate_id", F.concat(F.lit("r-audio-"), rank)).withColumn("cluster_share", F.col("cluster_size") / F.col("n_clustered"))
    for d in dims:
        base = base.withColumn(f"band_{d}", band(F.col(f"c_{d}"), *(params.bpm_bands if d == "bpm" else params.bands)))
    stable = stability(kept.select("cluster", "track_id"), plays, "cluster")
    picked = samples(kept, dims, params.samples).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "track_id"))), lambda x: x["track_id"]), ",").alias("sample_tracks"))
    hint = F.concat(F.lit("seek tracks near "), F.concat_ws(", ", *(F.concat(F.col(f"band_{d}"), F.lit(f" {d}")) for d in dims)))
    return base.join(stable, "cluster", "left").join(picked, "cluster").select("candidate_id", F.lit("audio").alias("category"), "cluster", "cluster_size", "cluster_share", F.col("cluster_size").alias("evidence_count"), "coverage", "confidence", F.col("balance").alias("stability_score"), *(F.round(f"c_{d}", 4).alias(f"c_{d}") for d in dims), *(f"band_{d}" for d in dims), "sample_tracks", hint.alias("hint"))


def stability(members: DataFrame, plays: DataFrame, by: str, at: str = "played_at") -> DataFrame:
    """Balance of each group's plays about the middle of the history."""
    middle = F.broadcast(midpoint(plays, at))
    per_track = plays.crossJoin(middle).groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(micros(F.col(at)) < F.col("middle")).alias("n_before"))
    return per_track.join(members, "track_id").groupBy(by).agg(balance(F.sum("n_before"), F.sum("n")).alias("balance"))


def samples(clustered: DataFrame, dims: tuple[str, ...], k: int) -> DataFrame:
    """The k tracks nearest to the centroid of their cluster in z-space; ids break ties."""
    centre = clustered.groupBy("cluster").agg(*(F.avg(f"z_{d}").alias(f"zc_{d}") for d in dims))
    total = F.lit(0.0)
    for d in dims:
        total = total + F.pow(F.col(f"z_{d}") - F.col(f"zc_{d}"), 2)
    near = clustered.join(centre, "cluster").withColumn("distance", F.sqrt(total))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "track_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("cluster", "rank", "track_id", F.round("distance", 4).alias("distance"))
