"""Shared storage for results that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; in local mode a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(Path(tempfile.mkdtemp(prefix="canopy-")).as_uri())
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """The folders that store() made inside a block, but those kept; they go when the block ends."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, a result of store(), outlives the block: an outer block, if any, takes it over."""
        path = _path_of(df)
        if path in self.paths:
            self.paths.remove(path)
            if len(_open) > 1:
                _open[_open.index(self) - 1].paths.append(path)
        return df


_open: list[Scratch] = []
#: Seconds between two collections, at least.
RELEASE_S = 15.0
_released = -RELEASE_S


def _path_of(df: DataFrame) -> str | None:
    return getattr(df, "_stored_at", None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """What store() writes inside is deleted at the end of the block, also after an error, but for what keep() names.

    Nothing that is still to be computed may read a deleted folder: keep the
    stored results that leave the block.
    """
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        for path in own.paths:
            delete(spark, path)
        release(spark)


def release(spark: SparkSession, now: bool = False) -> None:
    """Lets go what ended jobs hold: shuffle files, broadcasts and plans go when the driver collects their handles.

    By itself a driver with memory to spare may not collect for half an hour
    (spark.cleaner.periodicGC.interval), while executors keep every shuffle.
    Within RELEASE_S of the last time it does nothing, unless ``now``.
    """
    global _released
    if not now and time.monotonic() - _released < RELEASE_S:
        return
    gc.collect()  # Python's handles of Java objects first
    spark.sparkContext._jvm.System.gc()
    trim()
    _released = time.monotonic()


def trim() -> None:
    """Gives what this process holds but doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if _open:
        _open[-1].paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._stored_at = path
    release(df.sparkSession)  # a block may have many steps
    return out
