"""The one classifier: root, tendency, or a logged rejection. Nothing is dropped without a log entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.params import ValidationParams


def classify(candidates: DataFrame, params: ValidationParams = ValidationParams()) -> DataFrame:
    """Candidates beside n_unique and span_days of their data, with verdict, failed_tests, stability_status and the score that counts.

    Hard floors reject in order; comparisons are strict, so a value equal to its floor passes.
    """
    gate = (F.col("n_unique") > params.n_threshold) & (F.col("span_days") > params.t_threshold_days)
    evaluated = gate & F.col("stability_score").isNotNull()
    failed = F.filter(
        F.array(
            F.when(F.col("coverage") < params.coverage_root, "coverage_floor"),
            F.when(F.col("confidence") < params.confidence, "confidence_floor"),
            F.when(evaluated & (F.col("stability_score") < params.stability), "temporal_stability").when(~F.coalesce(evaluated, F.lit(False)), "temporal_stability_not_evaluated"),
        ),
        lambda x: x.isNotNull(),
    )
    verdict = F.when(F.col("evidence_count") < params.evidence_count, "rejected:calibration").when(F.col("coverage") < params.coverage_tendency, "rejected:coverage_floor").when(F.size("failed_tests") == 0, "root").otherwise("tendency")
    status = F.when(evaluated, "evaluated").otherwise("not_evaluated")
    wide = candidates.withColumn("failed_tests", failed).withColumn("stability_status", status).withColumn("stability_score", F.when(evaluated, F.col("stability_score")))
    return wide.withColumn("verdict", verdict)


def quality_log(classified: DataFrame, params: ValidationParams = ValidationParams()) -> DataFrame:
    """One row per rejected candidate: its id, the test it failed, and the figures as JSON."""
    details = F.when(F.col("verdict") == "rejected:calibration", F.to_json(F.struct("evidence_count", F.lit(params.evidence_count).alias("floor")))).otherwise(F.to_json(F.struct("coverage", F.lit(params.coverage_tendency).alias("floor_artifact"))))
    return classified.where(F.col("verdict").startswith("rejected:")).select("candidate_id", "category", F.substring_index("verdict", ":", -1).alias("failed_test"), details.alias("details"))


def survivors(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("verdict").isin("root", "tendency"))


def surviving_members(members: DataFrame, classified: DataFrame) -> DataFrame:
    """Members (root_id, track_id) of candidates that became a root or tendency."""
    return members.join(survivors(classified).select(F.col("candidate_id").alias("root_id")), "root_id", "left_semi")
