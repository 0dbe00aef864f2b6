"""Versioned tables, and the streaming import against the batch one on the same files."""

import datetime as dt
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from listenlake.operators import plays
from listenlake.sources.versioned import ConflictError, VersionedTable
from listenlake.streaming import history

SCHEMA = "k bigint, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(df):
    return sorted(((r["k"] is None, r["k"], r["v"]) for r in df.collect()), key=str)


def table(spark, tmp_path, buckets=4):
    return VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets)


def test_changes_and_snapshots(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.versions() == []
    assert t.change(lambda c: c.replace(rows(spark, *((i, "a") for i in range(20)), (None, "n")))) == 1
    old = t.read()
    t.change(lambda c: c.upsert(rows(spark, (3, "b"), (99, "b"), (None, "m"))))
    t.change(lambda c: c.append_new(rows(spark, (3, "c"), (100, "c"))))
    t.change(lambda c: c.retract(F.col("v") == "n"))
    t.change(lambda c: c.retract(F.col("k") == 5))
    want = [(i, "b" if i == 3 else "a") for i in range(20) if i != 5] + [(99, "b"), (100, "c"), (None, "m")]
    assert held(t.read()) == held(rows(spark, *want)) and t.versions() == [1, 2, 3, 4, 5]
    assert held(old) == held(t.read(1)) and old.count() == 21
    t.change(lambda c: c.compact())
    assert held(t.read()) == held(rows(spark, *want)) and all(len(f) == 1 for f in t.manifest()["buckets"].values())
    t.vacuum(keep=2)
    assert t.versions() == [5, 6] and held(t.read(5)) == held(t.read())
    # The number of buckets is the table's, whatever a reader says.
    assert held(VersionedTable(spark, t.path, SCHEMA, ["k"], 9).read()) == held(t.read())


def test_a_change_reads_and_writes_its_own_buckets(spark, tmp_path):
    t = table(spark, tmp_path, 16)
    t.change(lambda c: c.replace(rows(spark, *((i, "a") for i in range(200)))))
    before = t.manifest()["buckets"]
    change = t.begin()
    new = rows(spark, (7, "b"))
    only = change.touched(new)
    assert len(only) == 1 and len(change.read(only).inputFiles()) == 1
    change.upsert(new)
    assert change.commit()
    after = t.manifest()["buckets"]
    assert [b for b in before if before[b] != after[b]] == [str(b) for b in only]
    t.change(lambda c: c.append_new(rows(spark, (7, "c"), (1000, "c"))))
    assert all(set(after[b]) <= set(t.manifest()["buckets"][b]) for b in after)


def test_second_writer_tries_again(spark, tmp_path):
    t = table(spark, tmp_path)
    t.change(lambda c: c.replace(rows(spark, (1, "a"))))
    one, two = t.begin(), t.begin()
    one.upsert(rows(spark, (1, "one")))
    two.append_new(rows(spark, (2, "two")))
    assert one.commit() and not two.commit() and t.versions() == [1, 2]
    assert held(t.read()) == held(rows(spark, (1, "one")))
    assert not [n for n in t.folder.names(f"{t.path}/manifests") if n.startswith(".")]
    errors = []

    def write(k):
        try:
            table(spark, tmp_path).change(lambda c: c.append_new(rows(spark, (k, "x"))), tries=20)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(10, 14)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and held(t.read()) == held(rows(spark, (1, "one"), *((k, "x") for k in range(10, 14))))
    assert t.versions() == list(range(1, 7))

    def always_late(change):
        t.change(lambda c: None)

    with pytest.raises(ConflictError):
        t.change(always_late, tries=2)


EVENT = "track_key string, played_at timestamp, source string, export string, seq struct<file:string,row:bigint>, ms_played bigint"


def lines(export, source, file, *events):
    return [{"track_key": k, "played_at": f"2024-01-{d:02d}T10:00:00Z", "source": source, "export": export, "seq": {"file": file, "row": i}, "ms_played": ms} for i, (k, d, ms) in enumerate(events)]


FILES = [
    lines(None, "spotify_account", "a1", ("x", 1, 1), ("y", 9, 2), ("y", 9, 3)),
    lines(None, "ifttt", "i1", ("x", 2, 4), ("z", 3, 5)),
    lines("2024-01", "spotify_extended", "e1", ("x", 2, 6), ("w", 4, 7), ("w", 4, 8)),
    lines("2024-01", "spotify_extended", "e2", ("x", 5, 9), ("y", 9, 10)),
    lines(None, "spotify_account", "a2", ("q", 4, 11), ("q", 5, 12), ("q", 10, 13)),
    lines("2024-02", "spotify_extended", "f1", ("x", 5, 14), ("w", 7, 15)),
    lines("2024-01", "spotify_extended", "e3", ("late", 6, 16)),
    lines(None, "ifttt", "i2", ("z", 3, 17), ("x", 5, 18)),
    lines(None, "spotify_account", "a3", ("q", 7, 19), ("q", 8, 20)),
]
#: The commands of the batch import: the files of each; an export that was replaced is not imported again.
COMMANDS = [[0], [1], [2, 3], [4], [5], [7], [8]]


def test_stream_and_batch_give_the_same_history(spark, tmp_path):
    keys = ["track_key", "played_at"]
    want = spark.createDataFrame([], EVENT)
    for files in COMMANDS:
        text = spark.sparkContext.parallelize([json.dumps(r) for i in files for r in FILES[i]])
        new = spark.read.schema(EVENT).json(text)
        source = FILES[files[0]][0]["source"]
        if source == history.SHORT:
            new = plays.after_cutoff(new, want)
        want = spark.createDataFrame(plays.merge_history(plays.supersede(want) if source == history.FULL else want, new.select(*want.columns), keys).collect(), EVENT)
    src = tmp_path / "in"
    src.mkdir()
    t = VersionedTable(spark, str(tmp_path / "h"), EVENT, keys, 4)
    for i, f in enumerate(FILES):
        (src / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in f))
        os.utime(src / f"{i}.json", (1_700_000_000 + i,) * 2)  # files are taken by their times
        if i in (2, 8):  # some files come alone, others in one run of a file a batch
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(src))
            history.import_stream(stream, t, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(str, t.read().collect())) == sorted(map(str, want.select(*t.columns).collect()))
    assert t.info()["replaced"] == ["2024-01"] and t.info()["export"] == "2024-02"
    assert t.info()["lost"] == {"2024-01": 0, "2024-02": 2}
    assert history.cutoff(t) == dt.datetime(2024, 1, 7, 10, tzinfo=dt.timezone.utc)
    # A batch that is run again changes nothing.
    version = t.versions()[-1]
    history.importer(t, "import")(spark.read.schema(EVENT).json(str(src / "1.json")), 1)
    assert t.versions()[-1] == version
