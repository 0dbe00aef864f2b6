"""Streaming import into a versioned history, with what the batch imports do about overlaps.

A full export replaces the sources it covers: when its first rows come, plays of those
sources from before are retracted, and rows of an export that was replaced are left out
from then on. Rows of the short account history count only if they are later than the
newest play of the full export. Apart from that a key that is held stays as it is. Each
micro-batch is one version of the table and is noted there with its number, so one that
is run again changes nothing.

Rows have ``track_key``, ``played_at``, ``source``, ``seq`` and ``export`` (what tells one
full export from another; exports of one batch are taken in the order of their names).
Only buckets of a batch's keys are read, but for the first batch of an export, which
looks through the table once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listenlake.operators.plays import BULK_SOURCES, keep_first
from listenlake.shared import drop_since, made, stored
from listenlake.sources.versioned import Change, VersionedTable

FULL, SHORT = "spotify_extended", "spotify_account"


def import_rows(change: Change, rows: DataFrame) -> None:
    """Merge one batch of rows into a change of the history. ``change.info`` keeps the export that counts, those it replaced, its newest play, and how many older plays each export lost at most."""
    info, keys = change.info, change.table.keys
    micros = F.unix_micros("played_at")
    facts = rows.groupBy("source", "export").agg(F.min(micros).alias("oldest"), F.max(micros).alias("newest")).where(F.col("source") == FULL).orderBy("export").collect()
    for f in facts:
        name = f["export"] or ""
        if name in info.get("replaced", []):
            continue
        if info.get("export") != name:
            held = change.read().where(F.col("source") == FULL)
            info.setdefault("lost", {})[name] = held.where(micros < f["oldest"]).count()
            change.retract(F.col("source").isin(*BULK_SOURCES))
            if "export" in info:
                info.setdefault("replaced", []).append(info["export"])
            info |= {"export": name, "cutoff": f["newest"]}
        info["cutoff"] = max(info["cutoff"], f["newest"])
        own = rows.where((F.col("source") == FULL) & (F.coalesce("export", F.lit("")) == name))
        change.append_new(keep_first(own, keys))
    rest = rows.where(~F.coalesce(F.col("source") == FULL, F.lit(False)))
    if "cutoff" in info:
        rest = rest.where(F.coalesce(F.col("source") != SHORT, F.lit(True)) | (micros > info["cutoff"]))
    change.append_new(keep_first(rest, keys))


def importer(table: VersionedTable, stream: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: one version per micro-batch of ``stream``."""

    def run(batch: DataFrame, number: int) -> None:
        mark = made()
        rows = stored(batch.select(*table.columns), "batch")

        def make(change: Change) -> None:
            done = change.info.setdefault("streams", {})
            if done.get(stream, -1) < number:
                import_rows(change, rows)
                done[stream] = number

        if table.info().get("streams", {}).get(stream, -1) < number:
            table.change(make)
        drop_since(batch.sparkSession, mark)

    return run


def import_stream(rows: DataFrame, table: VersionedTable, checkpoint: str, stream: str = "import", **trigger) -> StreamingQuery:
    """Start the import of a stream of rows; without a trigger all that is there is taken, then it stops."""
    return rows.writeStream.foreachBatch(importer(table, stream)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def cutoff(table: VersionedTable) -> dt.datetime | None:
    """The newest play of the full export that counts, in UTC."""
    found = table.info().get("cutoff")
    return None if found is None else dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=found)
