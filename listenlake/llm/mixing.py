"""Mixing sources to target weights by Pareto order sampling (operator 4).

Targets: sources, ordered by code point with null last, share all words by
repeating weights; a target stops at ``cap`` times its source's words and the
excess is shared again by weight (water filling, in closed form).

Copies: a source whose target is r times its words gives every document
floor(r) whole copies. The remaining words come from a Pareto order sample:
documents are ranked by their random odds u/(1-u) over their inclusion odds
pi/(1-pi). A document's inclusion probability pi is its lean (by default the
root of its size, so that longer documents are likelier) times one factor per
source, 1 at most; the factor makes the expected words of the sample those that
remain, where those that it lifts to 1 are certain; it is found from sums over
equal leans.
Documents are taken in that order until the next one would exceed the
remaining words; then the order goes on with those that fit the gap, ``ROUNDS``
times in all, so that a long document at the edge leaves no wide gap. The rank
where a round stops is found from sums over narrow bands of the rank, then
inside one band, so no task sees all of a source.

A null text has size 0; documents of size 0 take nothing. Rows that repeat
are ranked alike and taken or left together. A null lean counts as 1, a null
id as the string 'null' in the draw. An empty table gives no rows; input columns
of any name stay. Results depend on ``seed`` and the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import WORD, drop_since, made, stored

BANDS, ROUNDS = 1 << 16, 4


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(id_col: str, seed: str) -> Column:
    """A number in (0, 1) that the id alone decides."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def odds_of(id_col: str, seed: str) -> Column:
    u = draw(id_col, seed)
    return u / (1 - u)


def lean_of(size: Column, lean: Column | None = None) -> Column:
    """The root of the size, or ``lean`` to 12 bits, so that a source has a bounded number of them."""
    if lean is None:
        return F.sqrt(F.greatest(size, F.lit(1)).cast("double"))
    given = F.coalesce(lean.cast("double"), F.lit(1.0))
    octave = F.pow(F.lit(2.0), F.floor(F.log2(given)))
    return F.floor(given / octave * 4096) / 4096 * octave


def rank_of(odds: Column, lean: Column, factor: Column) -> Column:
    """Random odds over inclusion odds; 0 for a document that is certain."""
    pi = factor * lean
    return F.when(pi >= 1, F.lit(0.0)).otherwise(odds / (pi / (1 - pi)))


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lean: str | None = None, seed: str = "mix") -> DataFrame:
    """One slim row per document: id, source, size, its random odds and its lean (a column that is over 0, or the root of its size)."""
    slim = docs.select(F.col(id_col).alias("mix_id"), F.col(source).alias("mix_source"), words_in(text).alias("size"), *([F.col(lean).alias("lean")] if lean else []))
    return slim.select("mix_id", "mix_source", "size", odds_of("mix_id", seed).alias("odds"), lean_of(F.col("size"), F.col("lean") if lean else None).alias("lean"))


def targets(slim: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """One row per source: source, source_size, target, whole copies and words left to sample."""
    per = slim.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", cap * F.col("source_size").cast("double") / F.col("weight"))
    order = Window.orderBy("full", F.col("mix_source").asc_nulls_last())
    every = Window.partitionBy()
    before, total = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum("source_size").over(every)
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - cap * before) / left).withColumn("at", F.row_number().over(order))
    # The first source in this order that stays under its cap sets the level for all after it.
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("at", "level"))).over(every)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("weight") * level, cap * F.col("source_size").cast("double"))))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    whole = F.floor(rate).cast("bigint")
    return per.select("mix_source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))


def calibrated(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with the factor of each source: the sum of min(1, factor * lean) * size over its documents is what remains. Null where nothing does.

    Leans are ordered from the top: the factor is the first that the next lean does not
    lift to 1 when all before it are certain. A source has a row per lean, not per document.
    """
    # Decimal sums do not depend on the order of rows.
    per = slim.where("size > 0").groupBy("mix_source", "lean").agg(F.sum("size").alias("words"), F.sum((F.col("lean") * F.col("size")).cast("decimal(38,9)")).alias("leaned"))
    open_ = F.broadcast(goal.where("rest > 0").select(F.col("mix_source").alias("s"), "rest"))
    by_lean = Window.partitionBy("s").orderBy(F.desc("lean"))
    before = F.coalesce(F.sum("words").over(by_lean.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("leaned").over(by_lean.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    tried = per.join(open_, per["mix_source"].eqNullSafe(F.col("s"))).select("s", "lean", ((F.col("rest") - before) / after).alias("factor"))
    found = tried.where(F.col("factor") * F.col("lean") < 1).groupBy("s").agg(F.max_by("factor", "lean").alias("factor"))
    return goal.join(found, goal["mix_source"].eqNullSafe(found["s"]), "left").drop("s")


def plan(slim: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """``targets`` with the rounds of each source: the words it had left, and the last rank and id that it took. ``slim`` is read a few times."""
    mark = made()
    goal = stored(targets(slim, weights, cap), "targets")
    goal = stored(calibrated(slim, goal), "targets")
    ranked = slim.join(F.broadcast(goal.where("rest > 0")), slim["mix_source"].eqNullSafe(goal["mix_source"])).select(slim["mix_source"], "mix_id", "size", rank_of(F.col("odds"), F.col("lean"), F.col("factor")).alias("rank")).where("size > 0 and rank is not null")
    place = F.struct("rank", "mix_id")
    # Certain documents are a band of their own, which the first round takes whole.
    band = F.when(F.col("rank") == 0, -1).otherwise(F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BANDS), F.lit(BANDS - 1))).cast("int")
    open_ = stored(ranked.select("mix_source", "size", place.alias("place"), band.alias("band")), "ranked")
    gaps = goal.where("rest > 0").select(F.col("mix_source").alias("s"), F.col("rest").alias("gap"), F.lit(None).cast(open_.schema["place"].dataType).alias("upto"))
    rounds = []
    for _ in range(ROUNDS):
        fits = open_.join(F.broadcast(gaps), open_["mix_source"].eqNullSafe(gaps["s"])).where((F.col("size") <= F.col("gap")) & (F.col("upto").isNull() | (F.col("place") > F.col("upto"))))
        by_band = Window.partitionBy("s").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
        sums = stored(fits.groupBy("s", "band").agg(F.sum("size").alias("words"), F.max("place").alias("top"), F.first("gap").alias("gap")).withColumn("total", F.sum("words").over(by_band)), "bands")
        whole = sums.where("total <= gap").groupBy("s").agg(F.max("total").alias("before"), F.max("top").alias("top"))
        crossed = sums.where("total > gap and total - words <= gap").select(F.col("s").alias("cross"), F.col("band").alias("b"), (F.col("total") - F.col("words")).alias("before"))
        inside = fits.join(F.broadcast(crossed), fits["mix_source"].eqNullSafe(crossed["cross"]) & (fits["band"] == crossed["b"]))
        ahead = F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("place"))
        last = inside.withColumn("ahead", ahead).where("ahead <= gap").groupBy(F.col("s").alias("t")).agg(F.max("ahead").alias("ahead"), F.max("place").alias("last"))
        ends = whole.join(last, whole["s"].eqNullSafe(last["t"]), "full").select(F.coalesce("s", "t").alias("e"), F.coalesce("ahead", "before").alias("words"), F.coalesce("last", "top").alias("last"))
        moved = gaps.join(ends, gaps["s"].eqNullSafe(ends["e"]), "left").select("s", F.col("gap").alias("had"), "last", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"), F.coalesce("last", "upto").alias("upto"))
        moved = stored(moved, "round")
        rounds.append(moved.where("last is not null").select(F.col("s").alias("r"), F.struct(F.col("had").alias("gap"), "last").alias("round")))
        gaps = moved.select("s", "gap", "upto")
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    every = every.groupBy("r").agg(F.collect_list("round").alias("rounds"))
    out = stored(goal.join(every, goal["mix_source"].eqNullSafe(every["r"]), "left").select("mix_source", "source_size", "target", "whole", "factor", "rounds"), "mix-plan")
    drop_since(slim.sparkSession, mark, (out,))
    return out


def copies(rank: Column) -> Column:
    """Copies of a document of known ``rank`` beside the columns of its source's plan: it is in the sample when a round came past it and it fitted that round's gap."""
    place = F.struct(rank.alias("rank"), F.col("mix_id"))
    extra = F.exists("rounds", lambda r: (F.col("size") <= r["gap"]) & (place <= r["last"]))
    return F.when(F.col("size") > 0, F.col("whole") + F.coalesce(extra.cast("bigint"), F.lit(0))).otherwise(F.lit(0))


def mix(slim: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """One row per document: mix_id, size, source_size, target, copies, taken."""
    found = plan(slim, weights, cap).withColumnRenamed("mix_source", "plan_source")
    joined = slim.join(found, slim["mix_source"].eqNullSafe(found["plan_source"]))
    return joined.select("mix_id", "size", "source_size", "target", copies(rank_of(F.col("odds"), F.col("lean"), F.col("factor"))).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns."""
    slim = stored(sized(docs, id_col, text, source, None, seed), "sized")
    found = plan(slim, weights, cap).withColumnRenamed("mix_source", "plan_source")
    wide = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("mix_id"), F.col(source).alias("mix_source"), words_in(text).alias("size"))
    joined = wide.join(found, wide["mix_source"].eqNullSafe(found["plan_source"]))
    taken = joined.select("row", copies(rank_of(odds_of("mix_id", seed), lean_of(F.col("size")), F.col("factor"))).alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
