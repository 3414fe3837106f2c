"""Intermediate tables in the folder that all executors share.

Whatever has to cut its lineage, or is read several times, is written as Parquet
below ``spark.checkpoint.dir``. A lost executor loses no such table, and a rerun
task reads the same files.

What happens to the tables: an operator drops those that its result does not read
before it returns. Those that the result does read stay until :func:`release`, or
until the program ends, when the session's folder is removed. A program that is
killed leaves its folder; the next session removes folders that nothing has been
added to for KEEP_HOURS.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEEP_HOURS = 96

_own_root: list[str] = []
_swept: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one in plain local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="lexiloom-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return "file://" + _own_root[0]


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def session_folder(spark: SparkSession) -> str:
    """The folder of this session's tables; the first call of a session sweeps what dead ones left."""
    root = f"{shared_root(spark)}/lexiloom"
    own = f"{root}/{spark.sparkContext.applicationId}"
    if own not in _swept:
        _swept.add(own)
        files, path = _path(spark, root)
        if files.exists(path):
            oldest = spark._jvm.System.currentTimeMillis() - KEEP_HOURS * 3_600_000
            for entry in files.listStatus(path):
                if entry.getModificationTime() < oldest:
                    files.delete(entry.getPath(), True)
        atexit.register(_at_end, spark, own)
    return own


def _at_end(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # stopped sessions leave the folder to the next one's sweep
        files, path = _path(spark, folder)
        files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove all tables of this session; results that have not been written by now cannot be read any more."""
    files, path = _path(spark, session_folder(spark))
    files.delete(path, True)


class Scratch:
    """Tables of one operator call, below a folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._names: list[str] = []

    def folder(self, name: str) -> str:
        if name not in self._names:
            self._names.append(name)
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and give back a frame that reads the files."""
        df.write.mode("errorifexists").option("compression", "zstd").parquet(self.folder(name))
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.folder(name))

    def drop(self, *names: str) -> None:
        """Remove tables nothing reads any more."""
        for name in names:
            files, path = _path(self.spark, self.folder(name))
            files.delete(path, True)
            self._names.remove(name)

    def keep_only(self, *names: str) -> None:
        """Remove all tables but these, which a result still reads."""
        self.drop(*[n for n in self._names if n not in names])


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, for plans that use it several times."""
    return Scratch(df.sparkSession, label).write(df, "rows")
