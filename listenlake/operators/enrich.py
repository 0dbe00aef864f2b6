"""Enrichment of track records with audio features and tags; every record falls into one bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.keys import filled, folded


def audio_bucket(has_features: Column, mbid: Column, found: Column) -> Column:
    return F.when(has_features, "already_present").when(filled(mbid).isNull(), "no_mbid").when(found, "enriched").otherwise("missing_features")


def enrich_audio(records: DataFrame, source: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Records (track_id, mbid, features...) with features filled in by mbid, and their bucket."""
    present = F.lit(False)
    for f in features:
        present = present | F.col(f).isNotNull()
    given = source.select("mbid", F.lit(True).alias("found"), *(F.col(f).alias(f"new_{f}") for f in features))
    wide = records.join(given, "mbid", "left").withColumn("bucket", audio_bucket(present, F.col("mbid"), F.col("found").isNotNull()))
    for f in features:
        wide = wide.withColumn(f, F.when(F.col("bucket") == "enriched", F.col(f"new_{f}")).otherwise(F.col(f)))
    return wide.drop("found", *(f"new_{f}" for f in features))


def bucket_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("bucket").agg(F.count("*").alias("n"))


def coverage(records: DataFrame) -> DataFrame:
    """One row: considered, present or enriched, their share, and the share of those with an MBID that have features."""
    good, mbid = F.count_if(F.col("bucket").isin("enriched", "already_present")), F.count_if(F.col("bucket") != "no_mbid")
    return records.agg(F.count("*").alias("considered"), good.alias("covered"), F.coalesce(F.try_divide(good, F.count("*")), F.lit(0.0)).alias("coverage"), F.coalesce(F.try_divide(good, mbid), F.lit(0.0)).alias("features_given_mbid"))


def enrich_tags(records: DataFrame, *sources: DataFrame) -> DataFrame:
    """Records (track_id, key, tags) with the tags of the first source that has any for their key, and their bucket."""
    wide, found = records, []
    for i, s in enumerate(sources):
        wide = wide.join(s.select("key", F.col("tags").alias(f"tags_{i}")), "key", "left")
        found.append(F.when(F.size(f"tags_{i}") > 0, F.col(f"tags_{i}")))
    first = F.coalesce(*found)
    bucket = F.when(F.size("tags") > 0, "already_present").when(first.isNotNull(), "enriched").otherwise("missing_tags")
    return wide.select("track_id", "key", bucket.alias("bucket"), F.when(F.size("tags") > 0, F.col("tags")).otherwise(first).alias("tags"))


def genre_tags(rows: DataFrame, fold=folded) -> DataFrame:
    """mbid, tag, weight of (mbid, kind, pos, name, count): each folded name once, genres before free tags."""
    rank = F.row_number().over(Window.partitionBy("mbid", fold(F.col("name"))).orderBy(F.when(F.col("kind") == "genre", 0).otherwise(1), "pos"))
    return rows.withColumn("rank", rank).where("rank = 1").select("mbid", F.col("name").alias("tag"), F.col("count").cast("double").alias("weight"))


def scalars_to_features(rows: DataFrame) -> DataFrame:
    """Feature columns of raw scalars; a row without any is dropped."""
    names = {"bpm": "bpm", "energy": "average_loudness", "valence": "happy", "danceability": "danceable", "acousticness": "acoustic", "instrumentalness": "instrumental"}
    picked = rows.select("mbid", *(F.col(c).cast("double").alias(f) for f, c in names.items()))
    return picked.where(F.coalesce(*names).isNotNull())


def batched(keys: DataFrame, fetch, size: int = 25, ddl: str = "mbid string, document string") -> DataFrame:
    """What ``fetch`` (a list of at most ``size`` keys to rows) gives for all distinct keys: the seam for a client that answers in batches. Failed calls raise, so a task runs again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for f in frames:
            held += f["key"].tolist()
            while len(held) >= size:
                yield pd.DataFrame(fetch(held[:size]), columns=names)
                held = held[size:]
        if held:
            yield pd.DataFrame(fetch(held), columns=names)

    names = [c.split()[0] for c in ddl.split(", ")]
    return keys.select(F.col(keys.columns[0]).alias("key")).where("key is not null").distinct().mapInPandas(run, ddl)


def style_tags(responses: DataFrame) -> DataFrame:
    """key, tags of search responses (key, payload): the styles of the first result only, without weight; none where there is no result."""
    styles = F.from_json(F.get_json_object("payload", "$.results[0].style"), "array<string>")
    tag = F.transform(F.coalesce(styles, F.array().cast("array<string>")), lambda t: F.struct(t.alias("tag"), F.lit(None).cast("double").alias("weight"), F.lit("discogs").alias("source")))
    return responses.select("key", tag.alias("tags"))
