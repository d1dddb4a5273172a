"""Intermediate tables in the folder all executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset and Spark runs in
local mode (tests), a temporary folder is made; on a cluster its absence is an
error, since a machine-local folder would not survive a lost executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
#: Shuffle files of a query are removed when it ends, not when the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set on first use in local mode only."""
    held = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
    spark.conf.set(_CONF, made)
    atexit.register(_delete_local, made)
    return made


def _delete_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


#: Folders of this process's intermediate tables.
_ROOTS: list[str] = []


class Scratch:
    """Written tables of one operator call.

    ``keep`` writes a DataFrame and returns a reader over the files, which cuts
    the lineage and survives lost executors.  ``drop`` deletes a table that no
    later step reads; what a result still reads goes with ``release``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        if not _ROOTS:
            atexit.register(release, spark)
        _ROOTS.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        read = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(read)] = path
        read._scratch_path = path  # keeps id(read) meaningful while read lives
        return read

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self._paths.pop(id(table), None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        _delete_path(self.spark, path)


def _delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this process.  A long session calls it when no
    result is read any more; otherwise it runs when the process ends."""
    try:
        while _ROOTS:
            _delete_path(spark, _ROOTS.pop())
    except Exception:  # the JVM is gone; the session's folder is deleted by its owner
        _ROOTS.clear()
