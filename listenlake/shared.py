"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder made here where that is unset and all runs on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="listenlake-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it goes with ``drop_since`` or when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_drop_at_exit, spark)
    _MADE.append(path)
    return path


def stored(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage. ``options`` go to the writer."""
    path = shared_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


_MADE: list[str] = []


def made() -> int:
    """How many tables were made so far, for ``drop_since``."""
    return len(_MADE)


def drop_since(spark: SparkSession, mark: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables made after ``mark`` but for those in ``keep`` (frames from ``stored``). Frames that read them can't be run again."""
    used = {df.shared_path for df in keep}
    gone = [x for x in _MADE[mark:] if x not in used]
    _MADE[mark:] = [x for x in _MADE[mark:] if x not in gone]
    jvm = spark.sparkContext._jvm
    for x in gone:
        place = jvm.org.apache.hadoop.fs.Path(x)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:  # a session that was stopped can't delete any more
            drop_since(spark, 0)
    except (Py4JError, OSError):
        return
