"""Keyed tables with versions: writers commit by one rename, readers keep the version they opened.

A table is a folder of Parquet files in hash buckets of the key, and a folder of
manifests, one per version, that name the files of every bucket. A change writes new
files beside the old ones, then a manifest for the next version, and renames that to its
number. A number can be taken once: who comes second builds the change again on what the
first has left. Files are never rewritten or removed under a reader; ``vacuum`` drops
those that no kept version names.

Work follows the change, not the table: a batch reads and writes the buckets of its own
keys. The rename has to fail where its target exists, as it does on HDFS and on local
disks; the manifest is read back, so that a file system that merges folders is noticed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConflictError(RuntimeError):
    """Others committed before every try."""


class Folder:
    """The few calls of the Hadoop file system that versions need."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.place(path)
        self.fs = self.root.getFileSystem(self.conf)

    def place(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        place = self.place(path)
        return [x.getPath().getName() for x in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.place(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def text(self, path: str) -> str:
        src = self.fs.open(self.place(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(src)).decode()
        finally:
            src.close()

    def take(self, path: str, to: str) -> bool:
        """Rename; false where the target is taken."""
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self.fs.makeQualified(self.place(path)), self.fs.makeQualified(self.place(to)), options)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or self.fs.exists(self.place(to)):
                return False
            raise
        return True

    def drop(self, path: str) -> None:
        self.fs.delete(self.place(path), True)


class Change:
    """A version to be: what is read from it includes what was written to it."""

    def __init__(self, table: VersionedTable, manifest: dict):
        self.table, self.base = table, manifest["version"]
        self.buckets = {b: list(f) for b, f in manifest["buckets"].items()}
        self.info = json.loads(json.dumps(manifest["info"]))

    def read(self, only: list[int] | None = None) -> DataFrame:
        return self.table._frame(self.buckets, only)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys in ``rows``; there are no more of them than the table has."""
        return sorted(r[0] for r in rows.select(self.table.bucket()).distinct().collect())

    def _write(self, rows: DataFrame) -> dict[str, str]:
        folder = f"{self.table.path}/data/{uuid.uuid4().hex}"
        rows.select(*self.table.columns, self.table.bucket().alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self.table.folder.names(folder) if n.startswith("bucket=")}

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew."""
        self.buckets = {b: [f] for b, f in self._write(rows).items()}

    def _rewrite(self, rows: DataFrame, only: list[int]) -> None:
        new = self._write(rows)
        for b in map(str, only):
            self.buckets.pop(b, None)
        self.buckets |= {b: [f] for b, f in new.items()}

    def append_new(self, rows: DataFrame) -> None:
        """Rows (each key once) whose keys the table does not hold; only the keys of their buckets are read, and nothing is rewritten."""
        keys = self.table.keys
        held = self.read(self.touched(rows)).select(*(F.col(k).alias(f"held_{k}") for k in keys))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"held_{k}"))
        for b, f in self._write(rows.join(held, same, "left_anti")).items():
            self.buckets.setdefault(b, []).append(f)

    def upsert(self, rows: DataFrame) -> None:
        """Rows (each key once) replace those of their keys whole; only their buckets are rewritten."""
        keys, only = self.table.keys, self.touched(rows)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"held.{k}").eqNullSafe(F.col(f"new.{k}"))
        kept = self.read(only).alias("held").join(rows.select(*keys).alias("new"), same, "left_anti")
        self._rewrite(kept.unionByName(rows.select(*self.table.columns)), only)

    def retract(self, condition: Column) -> None:
        """Rows that meet the condition go; buckets without any stay as they are."""
        hit = F.coalesce(condition, F.lit(False))
        only = self.touched(self.read().where(hit))
        self._rewrite(self.read(only).where(~hit), only)

    def compact(self, most: int = 1) -> None:
        """Buckets of more than ``most`` appends become one."""
        only = [int(b) for b, f in self.buckets.items() if len(f) > most]
        if only:
            self._rewrite(self.read(only), only)

    def commit(self) -> bool:
        """Publish as the version after the one this began with; false if that is taken."""
        return self.table._publish(self.base + 1, {"version": self.base + 1, "buckets": self.buckets, "info": self.info})


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        """``buckets`` is fixed when the first version is written."""
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.frame = spark.createDataFrame([], schema)
        self.columns, self.n_buckets, self.folder = self.frame.columns, buckets, Folder(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names(f"{self.path}/manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Of a version or the newest; version 0 is the empty table."""
        number = max(self.versions(), default=0) if version is None else version
        found = json.loads(self.folder.text(f"{self.path}/manifests/{number:020d}/manifest.json")) if number else {"version": 0, "buckets": {}, "info": {}, "n_buckets": self.n_buckets}
        self.n_buckets = found["n_buckets"]
        return found

    def read(self, version: int | None = None) -> DataFrame:
        return self._frame(self.manifest(version)["buckets"], None)

    def info(self) -> dict:
        return self.manifest()["info"]

    def _frame(self, buckets: dict[str, list[str]], only: list[int] | None) -> DataFrame:
        wanted = buckets if only is None else {str(b): buckets.get(str(b), []) for b in only}
        paths = [p for f in wanted.values() for p in f]
        return self.spark.read.schema(self.frame.schema).parquet(*paths) if paths else self.frame

    def begin(self) -> Change:
        return Change(self, self.manifest())

    def _publish(self, number: int, manifest: dict) -> bool:
        mine = uuid.uuid4().hex
        draft, target = f"{self.path}/manifests/.{mine}", f"{self.path}/manifests/{number:020d}"
        self.folder.write(f"{draft}/manifest.json", json.dumps(manifest | {"id": mine, "n_buckets": self.n_buckets}))
        won = self.folder.take(draft, target) and json.loads(self.folder.text(f"{target}/manifest.json"))["id"] == mine
        if not won:
            self.folder.drop(draft)
            self.folder.drop(f"{target}/.{mine}")
        return won

    def change(self, make: Callable[[Change], None], tries: int = 10) -> int:
        """Commit what ``make`` does to a change; done again on the newest version whenever another writer was first. The new version."""
        for _ in range(tries):
            change = self.begin()
            make(change)
            if change.commit():
                return change.base + 1
        raise ConflictError(f"{self.path}: {tries} tries were overtaken")

    def vacuum(self, keep: int = 10) -> None:
        """Drop all versions but the ``keep`` newest, and files that none of those name. Not while a change is being made."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {p.rsplit("/", 2)[-2] for v in kept for f in self.manifest(v)["buckets"].values() for p in f}
        for v in versions[:-keep]:
            self.folder.drop(f"{self.path}/manifests/{v:020d}")
        for n in self.folder.names(f"{self.path}/data"):
            if n not in used:
                self.folder.drop(f"{self.path}/data/{n}")
