"""Writers. Rewrites go to a new folder first, so a table being read is never overwritten."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.functions.keys import safe_name
from listenlake.operators.enrich import scalars_to_features


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Write beside ``path``, move the old table aside, then swap: the rows are never without a whole copy. ``recover`` mends what a crash left."""
    spark, new, old = rows.sparkSession, f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    rows.write.format(form).save(new)
    jvm = spark.sparkContext._jvm
    target, fresh, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, new, old))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        files.delete(aside, True)
        if not files.rename(target, aside):
            raise OSError(f"could not move {path} aside")
    if not files.rename(fresh, target):
        raise OSError(f"could not rename {new} to {path}")
    files.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Put the old table back where a crash came between the two moves of ``replace``."""
    jvm = spark.sparkContext._jvm
    target, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.old"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(aside) and not files.exists(target):
        files.rename(aside, target)


def index_tsv(pairs: DataFrame, path: str, comment: str) -> None:
    """Two columns as a tab-separated table below a comment line, in the order of ``seq`` where there is one, else of the pairs."""
    names = [c for c in pairs.columns if c != "seq"]
    body = pairs.select(F.lit(1).alias("at"), F.col("seq") if "seq" in pairs.columns else F.struct(*names).alias("seq"), F.concat_ws("\t", *names).alias("value"))
    head = pairs.sparkSession.range(1).select(F.lit(0).alias("at"), F.lit(None).cast(body.schema["seq"].dataType).alias("seq"), F.lit(f"# {comment}").alias("value"))
    head.unionByName(body).orderBy("at", "seq", "value").select("value").write.text(path)


def document_files(rows: DataFrame, path: str, name: Column | str) -> None:
    """One JSON document per row, each in a file of its own, in a folder named by its safe name."""
    named = rows.select(safe_name(F.col(name) if isinstance(name, str) else name).alias("snapshot"), F.to_json(F.struct(*rows.columns)).alias("value"))
    named.repartition("snapshot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").text(path)


def profiles(rows: DataFrame, path: str) -> None:
    """One JSON document per snapshot; those of other snapshots stay."""
    document_files(rows, path, "snapshot_id")


def profile(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """The document of one snapshot."""
    return spark.read.text(path).where(F.col("snapshot") == safe_name(F.lit(snapshot_id))).select("value")


def latest_profile(spark: SparkSession, path: str) -> DataFrame:
    """The document whose name is last."""
    rows = spark.read.text(path)
    return rows.agg(F.max_by("value", "snapshot").alias("value"))


def audio_analyses(rows: DataFrame, path: str) -> None:
    """track_id, embedding and tag scores of live captures, a document each; local folders only by intent."""
    document_files(rows.select("track_id", F.col("embedding").cast("array<double>").alias("embedding"), "tags"), path, "track_id")


def write_features(cache: DataFrame, path: str) -> None:
    """The features of a raw scalar cache (mbid and scalar columns), rewritten whole."""
    replace(scalars_to_features(cache), path, "json")


def append_raw(scalars: DataFrame, path: str) -> None:
    """Append fetched scalars (mbid, hit and scalar columns) to the raw cache; a miss is a row whose scalars are null, so it is not asked for again."""
    values = F.struct(*(c for c in scalars.columns if c not in ("mbid", "hit")))
    line = F.to_json(F.struct("mbid", F.when(F.col("hit"), values).alias("scalars")), {"ignoreNullFields": "false"})
    scalars.select(line.alias("value")).write.mode("append").text(path)
