"""The catalogue: written as partitioned Parquet, or as the binary record files that older tools read."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.schema import output_record, output_schema
from canopy.sources import files

#: Digits that encode (file, tree, halo) in one number; the smaller factor serves ten thousand files or more.
TREE_FACTOR, FILE_FACTOR, FILE_FACTOR_MANY = 10**9, 10**15, 10**14


def encode_index(file_nr: Column, tree_id: Column, halo_nr: Column, last_file: int = 0) -> Column:
    factor = FILE_FACTOR_MANY if last_file >= 10_000 else FILE_FACTOR
    return halo_nr.cast("long") + tree_id.cast("long") * TREE_FACTOR + file_nr.cast("long") * factor


def decode_index(index: Column, last_file: int = 0) -> tuple[Column, Column, Column]:
    """(file_nr, tree_id, halo_nr)."""
    factor = FILE_FACTOR_MANY if last_file >= 10_000 else FILE_FACTOR
    inside = F.pmod(index, F.lit(factor).cast("long"))
    return F.call_function("div", index, F.lit(factor).cast("long")), F.call_function("div", inside, F.lit(TREE_FACTOR).cast("long")), F.pmod(inside, F.lit(TREE_FACTOR).cast("long"))


def write_catalogue(rows: DataFrame, path: str, snapshots: list[int] | None = None, mode: str = "overwrite") -> None:
    """Rows of the listed snapshots as Parquet, one folder a snapshot and file; mode `ignore` skips what exists."""
    if snapshots is not None:
        rows = rows.filter(F.col("SnapNum").isin(snapshots))
    rows.withColumn("snap_num", F.col("SnapNum")).write.mode(mode).partitionBy("snap_num", "file_nr").parquet(path)


def read_catalogue(spark: SparkSession, path: str, snapshots: list[int] | None = None) -> DataFrame:
    """The catalogue, or some snapshots of it: other folders are not read."""
    rows = spark.read.parquet(path)
    return rows if snapshots is None else rows.filter(F.col("snap_num").isin(snapshots))


def tree_headers(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(SnapNum, file_nr, tree_id, n): objects of every tree at every snapshot that occurs; trees without any count 0."""
    counts = rows.groupBy("SnapNum", "file_nr", "tree_id").agg(F.count("*").alias("n"))
    spine = rows.select("SnapNum").distinct().join(trees.select("file_nr", "tree_id").distinct(), how="cross")
    return spine.join(counts, ["SnapNum", "file_nr", "tree_id"], "left").select("SnapNum", "file_nr", "tree_id", F.coalesce("n", F.lit(0)).alias("n"))


def binary_name(folder: str, name: str, redshift: float, file_nr: int) -> str:
    return f"{folder}/{name}_z{redshift:.3f}_{file_nr}"


def write_binary(rows: DataFrame, folder: str, name: str, redshift: dict[int, float], trees: dict[int, int], snapshots: list[int] | None = None) -> None:
    """A record file for each snapshot and tree file, in a folder that all executors share: header, counts, rows.

    rows: (file_nr, tree_id, out_ord) and the catalogue's columns.  trees: their
    number in each tree file; a file without objects at a snapshot has counts of 0.
    """
    kind = np.dtype(output_record(), align=True)
    columns = [f.name for f in output_schema().fields]

    def save(snap: int, file_nr: int, counts: np.ndarray, out: np.ndarray) -> str:
        path = binary_name(folder, name, redshift[snap], file_nr)
        with files.create(path) as f:
            f.write(np.array([len(counts), len(out)], "<i4").tobytes() + counts.astype("<i4").tobytes() + out.tobytes())
        return path

    def write(group: pd.DataFrame) -> pd.DataFrame:
        snap, file_nr = int(group["SnapNum"].iloc[0]), int(group["file_nr"].iloc[0])
        group = group.sort_values(["tree_id", "out_ord"])
        out = np.zeros(len(group), kind)
        for c in columns:
            out[c] = np.stack(group[c].to_list()) if kind[c].shape else group[c].to_numpy()
        path = save(snap, file_nr, np.bincount(group["tree_id"], minlength=trees[file_nr]), out)
        return pd.DataFrame({"path": [path], "snap": [snap], "file_nr": [file_nr]})

    done = {(r["snap"], r["file_nr"]) for r in rows.groupBy("SnapNum", "file_nr").applyInPandas(write, "path string, snap int, file_nr int").collect()}  # one row a file
    for snap in snapshots or []:
        for file_nr, n in trees.items():
            if (snap, file_nr) not in done:
                save(snap, file_nr, np.zeros(n, int), np.zeros(0, kind))


def read_binary(spark: SparkSession, pattern: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """Rows of binary catalogue files, a task for each range of rows; missing and empty files give none."""
    kind = np.dtype(output_record(), align=True)
    names = [f.name for f in output_schema().fields]
    tasks = []
    for path in files.find(pattern):
        head = np.frombuffer(files.read(path, 0, 8), "<i4")
        if len(head) < 2 or not head[1]:
            continue
        trees, total = (int(x) for x in head)
        counts = np.frombuffer(files.read(path, 8, 4 * trees), "<i4")
        if counts.sum() != total or files.size(path) != 8 + 4 * trees + kind.itemsize * total:
            raise ValueError(f"{path}: header and rows differ")
        tasks += [(path, 8 + 4 * trees + kind.itemsize * at, min(rows_per_task, total - at)) for at in range(0, total, rows_per_task)]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, offset, n in zip(frame["path"], frame["offset"], frame["n"], strict=True):
                rows = np.frombuffer(files.read(path, int(offset), kind.itemsize * int(n)), kind)
                yield pd.DataFrame({c: list(rows[c]) if kind[c].shape else rows[c] for c in names})

    return spark.createDataFrame(tasks, "path string, offset long, n long").repartition(max(1, len(tasks))).mapInPandas(load, output_schema())


def write_run_metadata(folder: str, config: dict, scale_factors: list[float]) -> None:
    """The settings and the snapshot list beside the catalogue, and with what and when it was made."""
    made = {"time": datetime.now(UTC).isoformat(), "python": platform.python_version(), "spark": pyspark.__version__, "system": platform.platform(), "settings_md5": hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()}
    with files.create(f"{folder}/run.json") as f:
        f.write(json.dumps({"config": config, "scale_factors": scale_factors, "made": made}, indent=1, default=str).encode())
    with files.create(f"{folder}/snapshots.a_list") as f:
        f.write("".join(f"{a}\n" for a in scale_factors).encode())
