"""Catalogue-like views over the star-schema tables, in DataFrame and in SQL form, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

H, VOLUME = 0.73, 62.5**3

#: Columns of the galaxy view as expressions that both engines read.
_GALAXY = {
    "Mvir": "l_extendedprice",
    "StellarMass": "l_quantity",
    "ColdGas": "l_quantity * l_discount",
    "HotGas": "l_extendedprice * l_tax",
    "BulgeMass": "l_quantity * l_tax * 5",
    "MetalsColdGas": "l_quantity * l_discount * l_tax",
    "MetalsHotGas": "l_extendedprice * l_tax * 0.01e0",
    "EjectedMass": "l_extendedprice * l_discount * 0.01e0",
    "MetalsEjectedMass": "l_extendedprice * l_discount * l_tax * 0.01e0",
    "ICS": "l_quantity * l_tax",
    "BlackHoleMass": "l_quantity * l_tax * 0.001e0",
    "SfrDisk": "l_discount * l_tax * 20",
    "SfrBulge": "l_tax",
    "Vmax": "100 + l_extendedprice / 500",
    "Vvir": "80 + l_extendedprice / 400",
    "Rvir": "0.1e0 + l_extendedprice / 100000",
    "dT": "l_discount * 0.01e0 - 0.0001e0",
    "deltaMvir": "l_extendedprice * (l_tax - 0.03e0)",
}

GALAXIES_SQL = (
    "WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS ord FROM lineitem), "
    "g AS (SELECT l_orderkey AS CentralHaloIndex, ord, CASE WHEN ord = 1 THEN 0 ELSE 1 END AS Type, CAST(year(l_shipdate) AS INT) AS SnapNum, CAST(l_quantity AS INT) AS Len, "
    + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _GALAXY.items())
    + ", max(CASE WHEN ord = 1 THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS CentralMvir FROM l)"
)


def galaxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as galaxies of groups: the first line of an order is the central."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ord", F.row_number().over(order))
    return rows.select(
        F.col("l_orderkey").alias("CentralHaloIndex"), "ord", F.when(F.col("ord") == 1, 0).otherwise(1).alias("Type"), F.year("l_shipdate").alias("SnapNum"), F.col("l_quantity").cast("int").alias("Len"),
        *[F.expr(v).cast("double").alias(k) for k, v in _GALAXY.items()],
        F.max(F.when(F.col("ord") == 1, F.col("l_extendedprice"))).over(Window.partitionBy("l_orderkey")).alias("CentralMvir"),
    )


VECTORS_SQL = "WITH v AS (SELECT vec_id, embedding[1:3] AS Pos, [1000e0 * embedding[4], 1000e0 * embedding[5], 1000e0 * embedding[6]] AS Vel, [100e0 * embedding[7], 100e0 * embedding[8], 100e0 * embedding[9]] AS Spin, 1e0 AS Mvir FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as positions, velocities and spins."""

    def part(first: int, scale: float) -> Column:
        return F.array(*[F.lit(scale) * F.element_at("embedding", i).cast("double") for i in range(first, first + 3)])

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.slice("embedding", 1, 3).alias("Pos"), part(4, 1000.0).alias("Vel"), part(7, 100.0).alias("Spin"), F.lit(1.0).alias("Mvir"))


#: A year's redshift: the last year is now.
SNAPS_SQL = "snaps AS (SELECT CAST(y AS INT) AS snap, (2001 - y) * 0.6e0 AS z FROM range(1995, 2002) t(y))"


def snaps(spark: SparkSession) -> DataFrame:
    return spark.range(1995, 2002).select(F.col("id").cast("int").alias("snap"), ((2001 - F.col("id")) * 0.6).alias("z"))


FOREST_SQL = """WITH o AS (
  SELECT o_custkey AS tree_id, o_orderkey AS key, CAST(year(o_orderdate) AS INT) AS SnapNum, o_totalprice AS Mvir, CAST(1 + o_orderkey % 97 AS INT) AS Len, o_orderstatus <> 'P' AS occupied,
         row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) - 1 AS fof_ord,
         first_value(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS root,
         dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS gen
  FROM orders),
e AS (SELECT p.tree_id, p.key AS prog, d.key AS descendant, p.fof_ord AS chain_ord, p.Len AS prog_len, p.occupied, p.SnapNum AS prog_snap, d.SnapNum AS desc_snap
      FROM o p JOIN o d ON p.tree_id = d.tree_id AND d.gen = p.gen + 1 AND d.fof_ord = 0)"""


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as halos: a customer is a tree, its orders of a year a group led by the largest, its next active year the descendants."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = rows.select(F.col("o_custkey").alias("tree_id"), F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("SnapNum"), F.col("o_totalprice").alias("Mvir"), (1 + F.col("o_orderkey") % 97).cast("int").alias("Len"), (F.col("o_orderstatus") != "P").alias("occupied"))
    group = Window.partitionBy("tree_id", "SnapNum").orderBy(F.col("Mvir").desc(), "key")
    return rows.withColumns({"fof_ord": (F.row_number().over(group) - 1).cast("long"), "root": F.first("key").over(group), "gen": F.dense_rank().over(Window.partitionBy("tree_id").orderBy("SnapNum"))})


def progenitors(halos: DataFrame) -> DataFrame:
    """(tree_id, prog, descendant, ...): every halo of a group with the root of the next generation."""
    p = halos.select("tree_id", F.col("key").alias("prog"), (F.col("gen") + 1).alias("gen"), F.col("fof_ord").alias("chain_ord"), F.col("Len").alias("prog_len"), "occupied", F.col("SnapNum").alias("prog_snap"))
    d = halos.filter("fof_ord = 0").select("tree_id", "gen", F.col("key").alias("descendant"), F.col("SnapNum").alias("desc_snap"))
    return p.join(d, ["tree_id", "gen"]).drop("gen")
