"""Library documents: difference of two imports, drop ledger, and the stamp that an unchanged import keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_counts(old: DataFrame, new: DataFrame, key: str = "key", kind: str = "kind") -> DataFrame:
    """kind, added, removed of two sets of keys; one full outer join."""
    both = new.select(kind, key).distinct().withColumn("in_new", F.lit(1)).join(old.select(kind, key).distinct().withColumn("in_old", F.lit(1)), [kind, key], "full_outer")
    return both.groupBy(kind).agg(F.count_if(F.col("in_old").isNull()).alias("added"), F.count_if(F.col("in_new").isNull()).alias("removed"))


def content_hash(document: DataFrame, without: str = "imported_at") -> Column:
    return F.sha2(F.to_json(F.struct(*(c for c in sorted(document.columns) if c != without))), 256)


def keep_stamp(prior: DataFrame, new: DataFrame, stamp: str = "imported_at") -> DataFrame:
    """The new document, with the prior stamp when nothing else changed; both are one row."""
    old = prior.select(content_hash(prior, stamp).alias("old_hash"), F.col(stamp).alias("old_stamp"))
    wide = new.withColumn("new_hash", content_hash(new, stamp)).join(F.broadcast(old), F.col("new_hash") == F.col("old_hash"), "left")
    return wide.withColumn(stamp, F.coalesce("old_stamp", stamp)).select(*new.columns)


def drop_ledger(document: DataFrame, mapped: tuple[str, ...]) -> DataFrame:
    """key, n of a one-row map<string, string> column ``root``: the length of each unmapped list, 1 for other values; empty lists leave no row."""
    each = document.select(F.explode("root").alias("key", "value")).where(~F.col("key").isin(*mapped))
    length = F.coalesce(F.json_array_length("value"), F.when(F.col("value").isNotNull(), 1))
    return each.select("key", length.cast("bigint").alias("n")).where("n > 0")


def agreement(left: DataFrame, right: DataFrame, key: str = "pair") -> DataFrame:
    """One row: compared keys of both tables and the share with equal verdicts; a key of one table only is 'absent' in the other."""
    a = left.select(key, F.col("verdict").alias("a"))
    b = right.select(key, F.col("verdict").alias("b"))
    wide = a.join(b, key, "full_outer").select(F.coalesce("a", F.lit("absent")).alias("a"), F.coalesce("b", F.lit("absent")).alias("b"))
    return wide.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("a") == F.col("b")).cast("double")), F.lit(1.0)).alias("rate"))
