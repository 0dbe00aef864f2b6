"""Scene roots: document tags, co-occurrence, coherence, topics and the choice of their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.keys import folded
from listenlake.operators.factors import FactorParams, factor_table
from listenlake.params import SceneParams

# Stop tags, version 1.
STOP_TAGS = {
    "v1": (
        "seen live",
        "favorite",
        "favorites",
        "favourite",
        "favourites",
        "favorite songs",
        "good",
        "awesome",
        "love",
        "loved",
        "beautiful",
        "cool",
        "nice",
        "best",
        "amazing",
        "great",
        "epic",
        "masterpiece",
        "various",
        "various artists",
        "misc",
        "miscellaneous",
        "music",
        "songs i like",
        "albums i own",
        "owned",
        "spotify",
        "itunes",
    ),
}


def stop_tags(version: str) -> tuple[str, ...]:
    """The stop tags of a version; none for a version that is not known."""
    return STOP_TAGS.get(version, ())


def doc_tags(records: DataFrame, stop: tuple[str, ...] = stop_tags("v1"), fold=folded) -> DataFrame:
    """doc, tag, weight of records (track_id, tags): folded, without stop tags; the last weight of a tag counts, and weights that are not positive are 1."""
    each = records.select(F.col("track_id").alias("doc"), F.posexplode("tags").alias("pos", "t")).select("doc", "pos", fold(F.col("t.tag")).alias("tag"), F.col("t.weight").alias("weight"))
    last = each.where(~F.col("tag").isin(*stop)).groupBy("doc", "tag").agg(F.max_by("weight", "pos").alias("weight"))
    return last.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0))


def doc_frequency(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.countDistinct("doc").alias("df"))


def cooccurrence(tags: DataFrame, block: int = 1000) -> DataFrame:
    """tag_a <= tag_b and the documents that hold both: the product of the incidence of tags with itself, a document's tags in blocks of about ``block``.

    Two blocks of a document meet under a key of their own, so no task makes all pairs of
    a document with very many tags; counts are added before they are shuffled.
    """
    own = tags.select("doc", "tag").distinct()
    parts = F.ceil(F.count("*").over(Window.partitionBy("doc")) / F.lit(block)).cast("int")
    dealt = own.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("tag"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.select("doc", F.col("tag").alias("tag_a"), F.col("part").alias("a"), every.alias("b"))
    right = dealt.select("doc", F.col("tag").alias("tag_b"), F.col("part").alias("b"), every.alias("a"))
    return left.join(right, ["doc", "a", "b"]).where("tag_a <= tag_b").groupBy("tag_a", "tag_b").agg(F.count("*").alias("n_both"))


def npmi(n_both: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    p = n_both / n
    value = F.try_divide(F.ln(F.try_divide(p, (n_a / n) * (n_b / n))), -F.ln(p))
    return F.when(n_both <= 0, -1.0).when(p >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def coherence(top: DataFrame, tags: DataFrame) -> DataFrame:
    """topic, coherence of (topic, tag): the mean NPMI over all pairs of its tags; pairs that never meet count as -1, fewer than two tags as 0."""
    n = F.broadcast(tags.agg(F.countDistinct("doc").alias("n_docs")))
    freq = doc_frequency(tags)
    used = top.select("tag").distinct()
    both = cooccurrence(tags.join(used, "tag", "left_semi"))
    pairs = top.select("topic", F.col("tag").alias("tag_a")).join(top.select("topic", F.col("tag").alias("tag_b")), "topic").where("tag_a < tag_b")
    wide = pairs.join(both, ["tag_a", "tag_b"], "left").join(freq.select(F.col("tag").alias("tag_a"), F.col("df").alias("n_a")), "tag_a").join(freq.select(F.col("tag").alias("tag_b"), F.col("df").alias("n_b")), "tag_b").crossJoin(n)
    scored = wide.groupBy("topic").agg(F.avg(npmi(F.coalesce("n_both", F.lit(0)), F.col("n_a"), F.col("n_b"), F.col("n_docs"))).alias("coherence"))
    return top.select("topic").distinct().join(scored, "topic", "left").select("topic", F.coalesce("coherence", F.lit(0.0)).alias("coherence"))


def top_tags(weights: DataFrame, n: int) -> DataFrame:
    """topic, tag, weight: shares of each topic's weight; the n largest, then without those that round to 0."""
    share = F.try_divide("weight", F.sum("weight").over(Window.partitionBy("topic")))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "tag"))
    wide = weights.withColumn("rank", rank).withColumn("weight", F.round(F.coalesce(share, F.lit(0.0)), 4))
    return wide.where((F.col("rank") <= n) & (F.col("weight") > 0)).select("topic", "rank", "tag", "weight")


def best_k(per_topic: DataFrame, floor: float) -> DataFrame:
    """k, mean_coherence of (k, coherence): the best mean among those with a topic over the floor; fewer topics win a tie."""
    means = per_topic.groupBy("k").agg((F.sum("coherence") / F.col("k")).alias("mean_coherence"), F.count_if(F.col("coherence") >= floor).alias("n_passing"))
    return means.where("n_passing > 0").agg(F.max_by(F.struct("k", "mean_coherence"), F.struct("mean_coherence", -F.col("k"))).alias("b")).where("b is not null").select("b.k", "b.mean_coherence")


def coherence_log(scored: DataFrame, top: DataFrame, floor: float) -> DataFrame:
    """One row per topic (k, topic, coherence) under the floor, as the quality log has it; ``top`` has the topics' tags (k, topic, rank, tag)."""
    tags = top.groupBy("k", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("top_tags"))
    low = scored.where(F.col("coherence") < floor).join(tags, ["k", "topic"], "left")
    details = F.to_json(F.struct(F.round("coherence", 4).alias("coherence"), F.lit(floor).alias("floor"), F.col("k").alias("K"), "top_tags"))
    return low.select(F.concat(F.lit("q-scene-"), F.col("topic").cast("string")).alias("candidate_id"), F.lit("scene").alias("category"), F.lit("coherence_floor").alias("failed_test"), details.alias("details"))


def factor(tags: DataFrame, params: SceneParams = SceneParams(), factors: FactorParams = FactorParams()) -> DataFrame:
    """Rows (k, part, topic, name, weight) for every K of the grid, part 'doc' or 'tag'."""
    return factor_table(tags, params.k_grid, params.max_iter, factors)


def assign(doc_weights: DataFrame) -> DataFrame:
    """doc, topic, dominance of (doc, topic, weight): the first largest topic and its share; documents without weight are left out."""
    best = F.min_by(F.struct("topic", "weight"), F.struct(-F.col("weight"), "topic"))
    return doc_weights.groupBy("doc").agg(best.alias("b"), F.sum("weight").alias("total")).where("total > 0").select("doc", F.col("b.topic").alias("topic"), (F.col("b.weight") / F.col("total")).alias("dominance"))


def hints(top: DataFrame, n: int = 3) -> DataFrame:
    """topic, hint: what to look for next in a scene, named by its first tags (topic, rank, tag)."""
    named = top.where(F.col("rank") <= n).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ", ").alias("tags"))
    return named.select("topic", F.concat(F.lit("look for artists not heard yet in the scene of "), "tags").alias("hint"))


def describe(assigned: DataFrame, records: DataFrame, n_docs: int | Column, params: SceneParams = SceneParams()) -> DataFrame:
    """One row per topic with members, ranked: size, share, confidence, coverage, top artists and samples."""
    base = assigned.groupBy("topic").agg(F.count("*").alias("cluster_size"), F.min("doc").alias("min_id"), F.round(F.avg("dominance"), 6).alias("confidence"), F.round(F.avg((F.col("dominance") >= 0.5).cast("double")), 4).alias("coverage"))
    artists = top_artists(assigned.join(records.select(F.col("track_id").alias("doc"), "artist"), "doc"), params.top_artists)
    listed = artists.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "artist"))), lambda x: x["artist"]), ",").alias("top_artists"))
    order = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("dominance"), "doc"))
    picked = assigned.withColumn("rank", order).where(F.col("rank") <= params.samples).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]), ",").alias("sample_tracks"))
    rank = F.row_number().over(Window.orderBy(F.desc("cluster_size"), "min_id"))
    share = F.col("cluster_size") / (F.lit(n_docs) if isinstance(n_docs, int) else n_docs)
    return base.join(listed, "topic", "left").join(picked, "topic").withColumn("candidate_id", F.concat(F.lit("r-scene-"), rank)).select("candidate_id", F.lit("scene").alias("category"), "topic", "cluster_size", share.alias("cluster_share"), F.col("cluster_size").alias("evidence_count"), "coverage", "confidence", "top_artists", "sample_tracks")


def top_artists(rows: DataFrame, n: int) -> DataFrame:
    """topic, rank, artist, n of (topic, artist); names break ties."""
    counts = rows.groupBy("topic", "artist").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "artist"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)
