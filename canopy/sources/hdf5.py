"""Hierarchical files: merger trees as a Spark data source, and catalogues with a master file.

They need h5py, which is imported where a file is opened; without it that is a
clear error, and everything else works.  The functions on open files only use
groups, datasets and attributes, as h5py has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from canopy.schema import TREE, numpy_record, output_record, output_schema, tree_schema
from canopy.sources import files
from canopy.sources.trees import TreeRange, record_batch, split_trees

# Names of the header's attributes by tree type, and fields that the files call differently.
HEADER = {"genesis_lhalo_hdf5": {"trees": "Ntrees", "halos": "totNHalos", "counts": "InputTreeNHalos"}}
FIELD_NAMES = {"M_Mean200": "M_mean200", "FileNr": "Filenr", "SubhaloIndex": "SubHaloIndex"}
#: Rows in a chunk of a catalogue's table.
CHUNK = 1000


def open_file(path: str, mode: str = "r") -> Any:
    try:
        import h5py
    except ImportError as e:
        raise ImportError(f"{path}: reading and writing this format needs h5py, which is not installed; use lhalo_binary trees and binary or parquet output") from e
    return h5py.File(files.resolve(path)[1], mode)


def header_names(kind: str) -> dict[str, str]:
    if kind not in HEADER:
        raise ValueError(f"no header names for tree type {kind}; there are {sorted(HEADER)}")
    return HEADER[kind]


def tree_counts(f: Any, kind: str = "genesis_lhalo_hdf5") -> np.ndarray:
    """Halos of each tree, from the header's attributes, which must agree."""
    names, header = header_names(kind), f["Header"].attrs
    counts = np.atleast_1d(np.asarray(header[names["counts"]], np.int64))
    if len(counts) != int(header[names["trees"]]) or counts.sum() != int(header[names["halos"]]):
        raise ValueError("the header's counts differ")
    return counts


def read_tree(f: Any, tree: int, n: int) -> np.ndarray:
    """The records of one tree: each field is a dataset of its own; vectors have three columns."""
    rows = np.zeros(n, numpy_record(TREE))
    group = f[f"tree_{tree:03d}"]
    for name, _ in TREE:
        rows[name] = np.asarray(group[FIELD_NAMES.get(name, name)][:])
    return rows


class Hdf5TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = files.find(options["path"])
        self.kind = options.get("treeType", "genesis_lhalo_hdf5")
        self.most = int(options.get("halosPerPartition", 1_000_000))

    def partitions(self) -> list[TreeRange]:
        out = []
        for path in self.paths:
            with open_file(path) as f:
                counts = tree_counts(f, self.kind)
            number = re.search(r"\.(\d+)(?:\.[a-z0-9]+)?$", path)
            out += split_trees(path, int(number[1]) if number else 0, counts, self.most)
        return out

    def read(self, partition: TreeRange) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            for tree, n in enumerate(partition.counts, partition.first_tree):
                yield record_batch(read_tree(f, tree, n), partition.file_nr, tree)


class LHaloHdf5(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lhalo_hdf5"

    def schema(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tree_schema().fields)

    def reader(self, schema: object) -> Hdf5TreeReader:
        return Hdf5TreeReader(self.options)


def write_rows(f: Any, rows: np.ndarray, snapshot: int, counts: np.ndarray) -> None:
    """One snapshot of one tree file: Snap###/Galaxies with its attributes, and the objects of each tree."""
    group = f.create_group(f"Snap{snapshot:03d}")
    table = group.create_dataset("Galaxies", data=rows, maxshape=(None,), chunks=(CHUNK,))
    table.attrs["Ntrees"] = np.int32(len(counts))
    table.attrs["TotHalosPerSnap"] = np.int32(len(rows))
    group.create_dataset("TreeHalosPerSnap", data=counts.astype(np.int32))


def file_name(folder: str, name: str, file_nr: int | None = None) -> str:
    return f"{folder}/{name}.hdf5" if file_nr is None else f"{folder}/{name}_{file_nr:03d}.hdf5"


def write_catalogue(rows: DataFrame, folder: str, name: str, snapshots: list[int], trees: dict[int, int], redshift: dict[int, float], properties: dict[str, float | int | str] | None = None) -> None:
    """(file_nr, tree_id, out_ord, catalogue columns) -> a file for each tree file, every snapshot a group, and the master file."""
    kind = np.dtype(output_record())
    columns = [f.name for f in output_schema().fields]

    def write(group: pd.DataFrame) -> pd.DataFrame:
        file_nr = int(group["file_nr"].iloc[0])
        group = group.sort_values(["SnapNum", "tree_id", "out_ord"])
        with open_file(file_name(folder, name, file_nr), "w") as f:
            for snap in snapshots:
                own = group[group["SnapNum"] == snap]
                out = np.zeros(len(own), kind)
                for c in columns:
                    out[c] = np.stack(own[c].to_list()) if kind[c].shape and len(own) else own[c].to_numpy() if not kind[c].shape else out[c]
                write_rows(f, out, snap, np.bincount(own["tree_id"], minlength=trees[file_nr]))
        return pd.DataFrame({"file_nr": [file_nr], "n": [len(group)]})

    rows.filter(rows["SnapNum"].isin(snapshots)).groupBy("file_nr").applyInPandas(write, "file_nr int, n long").collect()  # one row a file
    write_master(folder, name, sorted(trees), snapshots, redshift, properties or {})


def write_master(folder: str, name: str, file_nrs: list[int], snapshots: list[int], redshift: dict[int, float], properties: dict[str, float | int | str]) -> None:
    """Links to the tables of the files that exist, the redshift of each snapshot, counts, and the run's settings."""
    import h5py

    with open_file(file_name(folder, name), "w") as f:
        for snap in snapshots:
            group = f.create_group(f"Snap{snap:03d}")
            group.attrs["Redshift"] = np.float32(redshift[snap])
            for nr in file_nrs:
                path = file_name(folder, name, nr)
                if not files.exists(path):
                    continue
                own = group.create_group(f"File{nr:03d}")
                for x in ("Galaxies", "TreeHalosPerSnap"):
                    own[x] = h5py.ExternalLink(path.rsplit("/", 1)[-1], f"Snap{snap:03d}/{x}")
                with open_file(path) as part:
                    own.attrs["TotHalosPerSnap"] = part[f"Snap{snap:03d}"]["Galaxies"].attrs["TotHalosPerSnap"]
        run = f.create_group("RunProperties")
        for key, value in properties.items():
            run.attrs[key] = value


def _tables(f: Any, snapshot: int) -> list[Any]:
    """The tables of a snapshot: of a file itself, or of all files that a master links."""
    group = f.get(f"Snap{snapshot:03d}")
    if group is None:
        return []
    if "Galaxies" in group:
        return [group["Galaxies"]]
    return [group[k]["Galaxies"] for k in sorted(group.keys()) if k.startswith("File") and "Galaxies" in group[k]]


def count_rows(f: Any, snapshot: int) -> int:
    """Objects of a snapshot, from the tables' shapes."""
    return sum(int(t.shape[0]) for t in _tables(f, snapshot))


def snapshot_rows(f: Any, snapshot: int) -> np.ndarray | None:
    """All rows of a snapshot; None where the file doesn't have it."""
    tables = _tables(f, snapshot)
    return np.concatenate([np.asarray(t[:]) for t in tables]) if tables else None


def metadata(f: Any) -> dict[str, Any]:
    """Attributes of the file, and of its snapshots as Snap###_name."""
    out = dict(f.attrs.items())
    for key in f.keys():
        if key.startswith("Snap"):
            out |= {f"{key}_{k}": v for k, v in f[key].attrs.items()}
    return out


def read_catalogue(spark: SparkSession, folder: str, name: str, snapshots: list[int], first_file: int = 0, last_file: int = 0) -> DataFrame:
    """Rows of the snapshots, a task for each file and snapshot: of the files that the master links, or else of those that exist."""
    names = [f.name for f in output_schema().fields]
    paths = [p for p in (file_name(folder, name, k) for k in range(first_file, last_file + 1)) if files.exists(p)]
    if not paths and files.exists(file_name(folder, name)):
        paths = [file_name(folder, name)]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, snap in zip(frame["path"], frame["snap"], strict=True):
                with open_file(path) as f:
                    rows = snapshot_rows(f, int(snap))
                if rows is not None and len(rows):
                    yield pd.DataFrame({n: list(rows[n]) if rows.dtype[n].shape else rows[n] for n in names})

    tasks = spark.createDataFrame([(p, s) for p in paths for s in snapshots], "path string, snap int")
    return tasks.repartition(max(1, len(paths) * len(snapshots))).mapInPandas(load, output_schema())
