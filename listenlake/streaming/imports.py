"""Streaming twins of the batch imports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from listenlake import schema
from listenlake.operators.plays import keep_first
from listenlake.sources.readers import or_empty
from listenlake.sources.sinks import replace


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema.EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def merge_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends to the history at ``path`` what it does not hold; a batch that is seen again changes nothing.

    Of the history only the keys are read, and of a key that comes twice in a batch the
    first row stays (by ``seq`` where the rows have one, else by time).
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = F.struct("seq") if "seq" in batch.columns else F.struct("played_at")
        new = keep_first(batch.withColumn("merge_seq", order), keys, "merge_seq").drop("merge_seq")
        held = or_empty(spark, lambda: spark.read.parquet(path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"new.{k}").eqNullSafe(F.col(f"held.{k}"))
        new.alias("new").join(held.select(*keys).alias("held"), same, "left_anti").write.mode("append").parquet(path)

    return merge


def before_cutoff(events: DataFrame, cutoff, source: str = "spotify_account") -> DataFrame:
    """Stream rows without those of ``source`` that are not later than ``cutoff``, as the batch import leaves them out."""
    return events.where((F.col("source") != source) | (F.col("played_at") > cutoff))


def compact(spark: SparkSession, path: str, files: int) -> None:
    """Rewrite an appended history into few files; run it apart from the stream."""
    replace(spark.read.parquet(path).repartition(files), path)


def import_events(spark: SparkSession, source: str, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Import all files there are, then stop."""
    return event_stream(spark, source).writeStream.foreachBatch(merge_into(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Rows whose key has not come within the watermark; later ones are late."""
    return events.withWatermark("played_at", delay).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, width: str = "60 days", step: str = "14 days", start: str = "0 seconds", delay: str = "1 day") -> DataFrame:
    """Plays per sliding window; ``start`` sets the grid."""
    return events.withWatermark("played_at", delay).groupBy(F.window("played_at", width, step, start)).agg(F.count("*").alias("n"))


class RingBuffer(StatefulProcessor):
    """Frames in a map by their number, and one value (first number, next number, seconds): an append or an eviction is one operation on the map."""

    def __init__(self, max_seconds: float):
        self.max_seconds = max_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "n bigint", "at double, seconds double, frame binary")
        self.ends = handle.getValueState("ends", "first bigint, next bigint, seconds double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        first, after, total = self.ends.get() if self.ends.exists() else (0, 0, 0.0)
        came = pd.concat([*rows]).sort_values("at", kind="stable")
        out = []
        for at, seconds, frame in zip(came["at"].tolist(), came["seconds"].tolist(), came["frame"].tolist(), strict=True):
            self.frames.updateValue((after,), (at, seconds, frame))
            out.append((key[0], "added", at, seconds, frame))
            after, total = after + 1, total + seconds
            while after - first > 1 and total > self.max_seconds:
                old = self.frames.getValue((first,))
                self.frames.removeKey((first,))
                out.append((key[0], "dropped", old[0], old[1], None))
                first, total = first + 1, total - old[1]
        self.ends.update((first, after, total))
        yield pd.DataFrame(out, columns=["stream", "change", "at", "seconds", "frame"])

    def close(self) -> None:
        pass


def ring_buffer(frames: DataFrame, max_seconds: float) -> DataFrame:
    """Changes (stream, change 'added' or 'dropped', at, seconds, frame) of a buffer of the newest frames (stream, at, seconds, frame) per stream.

    It holds ``max_seconds`` at most, but one frame at least. State and output are written
    for new and evicted frames only; frames of a batch are taken by time, batches as they
    come. ``ring_contents`` has what is held. The session's state store has to be RocksDB's.
    """
    form = "stream string, change string, at double, seconds double, frame binary"
    return frames.select("stream", "at", "seconds", "frame").groupBy("stream").transformWithStateInPandas(RingBuffer(max_seconds), form, "Update", "None")


def ring_contents(changes: DataFrame) -> DataFrame:
    """What is held (stream, at, seconds, frame) after all of ``changes``; frames of one stream with one time and length go in turn."""
    n = F.count_if(F.col("change") == "dropped")
    kept = changes.groupBy("stream", "at", "seconds").agg(n.alias("gone"), F.filter(F.collect_list(F.when(F.col("change") == "added", F.col("frame"))), lambda f: f.isNotNull()).alias("frames"))
    return kept.select("stream", "at", "seconds", F.explode(F.slice("frames", F.col("gone").cast("int") + 1, F.greatest(F.lit(0), F.size("frames") - F.col("gone").cast("int")))).alias("frame"))
