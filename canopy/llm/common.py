"""What the operators of this subpackage share: reading tables, shared storage, fixed splits."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.storage import scratch, trim
from canopy.storage import store as materialise

__all__ = ["WORD", "free_name", "free_names", "held_out", "lean", "materialise", "read_table", "scratch", "ship_code"]

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"
#: A word, for the operators that count words with SQL functions.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers started from now on import this package in local mode; a cluster gets it by --py-files.

    Where the session has Spark's default size of Arrow batches they become
    smaller: rows hold whole texts, and JVM and worker hold a batch each.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function whose worker, which outlives the task, keeps no free memory after it."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return outer


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    return [free_name(df, name) for name in names]


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
