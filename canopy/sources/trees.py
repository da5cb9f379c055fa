"""Binary merger-tree files as a Spark data source.

``spark.read.format("lhalo_tree")`` reads headerless files: two int32 (trees,
halos), the halos of each tree, then 104-byte records.  One partition reads a
range of trees of one file, so a large file is split without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from canopy.schema import TREE, numpy_record, tree_schema
from canopy.sources import files


def tree_counts(path: str, order: str = "<") -> np.ndarray:
    """Halos of each tree, checked against the header's total and the file's size."""
    head = files.read(path, 0, 8)
    if len(head) < 8:
        raise ValueError(f"{path}: header and contents differ")
    trees, total = np.frombuffer(head, f"{order}i4")
    if trees < 0 or total < 0:
        raise ValueError(f"{path}: negative counts; is the byte order right?")
    counts = np.frombuffer(files.read(path, 8, 4 * int(trees)), f"{order}i4")
    size = np.dtype(numpy_record(TREE, order)).itemsize
    if len(counts) != trees or counts.sum() != total or files.size(path) != 8 + 4 * int(trees) + size * int(total):
        raise ValueError(f"{path}: header and contents differ")
    return counts


@dataclass
class TreeRange(InputPartition):
    path: str
    file_nr: int
    first_tree: int
    counts: list[int]
    offset: int


def split_trees(path: str, file_nr: int, counts: np.ndarray, most: int, offset: int = 0, size: int = 0) -> list[TreeRange]:
    """Ranges of trees of about ``most`` halos; offset: where the first record begins, size: that of a record."""
    out, first = [], 0
    while first < len(counts):
        last, halos = first, 0
        while last < len(counts) and (last == first or halos + counts[last] <= most):
            halos += int(counts[last])
            last += 1
        out.append(TreeRange(path, file_nr, first, counts[first:last].tolist(), offset))
        offset, first = offset + size * halos, last
    return out


def record_batch(rows: np.ndarray, file_nr: int, tree: int) -> pa.RecordBatch:
    """A tree's records as columns, in this machine's byte order."""
    n = len(rows)
    columns = [pa.array(x) for x in (np.full(n, file_nr, np.int32), np.full(n, tree, np.int32), np.arange(n, dtype=np.int32))]
    for name, what in TREE:
        x = rows[name].astype(rows[name].dtype.newbyteorder("="))
        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 3), pa.array(x.ravel())) if what == "vec3" else pa.array(x))
    return pa.RecordBatch.from_arrays(columns, names=["file_nr", "tree_id", "halo_nr", *[t[0] for t in TREE]])


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = files.find(options["path"])  # files that are missing are not listed
        self.order = ">" if options.get("endianness") == "big" else "<"
        self.most = int(options.get("halosPerPartition", 1_000_000))

    def partitions(self) -> list[TreeRange]:
        out = []
        size = np.dtype(numpy_record(TREE, self.order)).itemsize
        for path in self.paths:
            counts = tree_counts(path, self.order)
            number = re.search(r"(\d+)$", path)
            out += split_trees(path, int(number[1]) if number else 0, counts, self.most, 8 + 4 * len(counts), size)
        return out

    def read(self, partition: TreeRange) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(numpy_record(TREE, self.order))
        at = partition.offset
        for tree, n in enumerate(partition.counts, partition.first_tree):
            yield record_batch(np.frombuffer(files.read(partition.path, at, kind.itemsize * n), kind), partition.file_nr, tree)
            at += kind.itemsize * n


class LHaloTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lhalo_tree"

    def schema(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tree_schema().fields)

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def read_trees(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Halos of the binary tree files that match path."""
    spark.dataSource.register(LHaloTree)
    return spark.read.format("lhalo_tree").options(**options).load(path)


def read_tree_files(spark: SparkSession, kind: str, folder: str, name: str, file_nrs: list[int], **options: str) -> DataFrame:
    """Halos of the files of a tree type: each name.number that exists, read by the source of that type."""
    from canopy.sources import hdf5

    if kind == "lhalo_binary":
        own, ending = LHaloTree, ""
    elif kind == "genesis_lhalo_hdf5":
        own, ending = hdf5.LHaloHdf5, ".hdf5"
        options["treeType"] = kind
    else:
        raise ValueError(f"unknown tree type {kind}; there are lhalo_binary and genesis_lhalo_hdf5")
    spark.dataSource.register(own)
    paths = [p for p in (f"{folder}/{name}.{k}{ending}" for k in file_nrs) if files.exists(p)]
    parts = [spark.read.format(own.name()).options(**options).load(p) for p in paths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], tree_schema())


def tree_numbers(kind: str, folder: str, name: str, file_nrs: list[int]) -> dict[int, int]:
    """How many trees, empty ones too, each file that exists has, from its header."""
    from canopy.sources import hdf5

    out = {}
    for k in file_nrs:
        path = f"{folder}/{name}.{k}" + ("" if kind == "lhalo_binary" else ".hdf5")
        if files.exists(path):
            if kind == "lhalo_binary":
                out[k] = len(tree_counts(path))
            else:
                with hdf5.open_file(path) as f:
                    out[k] = len(hdf5.tree_counts(f, kind))
    return out


def write_tree_file(path: str, trees: list[list[dict]], order: str = "<") -> None:
    """A tree file of given halos, for tests and small forests; a field left out is 0, a link -1."""
    kind = np.dtype(numpy_record(TREE, order))
    rows = np.zeros(sum(map(len, trees)), kind)
    for name in [t[0] for t in TREE[:5]]:
        rows[name] = -1
    for row, halo in zip(rows, [h for t in trees for h in t], strict=True):
        for name, value in halo.items():
            row[name] = value
    with files.create(path) as f:
        f.write(np.array([len(trees), len(rows), *map(len, trees)], f"{order}i4").tobytes() + rows.tobytes())


def tree_table(halos: DataFrame) -> DataFrame:
    """(file_nr, tree_id, n_halos, first_halo): sizes and their exclusive prefix sum within each file."""
    sizes = halos.groupBy("file_nr", "tree_id").agg(F.count("*").alias("n_halos"))
    before = Window.partitionBy("file_nr").orderBy("tree_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first_halo", F.coalesce(F.sum("n_halos").over(before), F.lit(0)))
