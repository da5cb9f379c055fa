"""More registered queries: forest lookups, conditional and normalised histograms, quality counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.forest import write_back
from canopy.operators.histogram import digitize, fixed_histogram, ranged_histogram, volume_density
from canopy.operators.output import host_properties
from canopy.plans.registry import KEYS, ORACLES, QUERIES, c, query
from canopy.plans.standin import FOREST_SQL, GALAXIES_SQL, SNAPS_SQL, VOLUME, forest, galaxies, progenitors, snaps
from canopy.units import Cosmology, Units

__all__ = ["ORACLES", "QUERIES"]

_KEYS = ", ".join(KEYS)

# --- projections, filters and joins over the forest ------------------------------------------------------------------


@query("FLT03", f"{FOREST_SQL} SELECT key, SnapNum FROM o WHERE occupied")
def _flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).filter("occupied").select("key", "SnapNum")


@query("PRJ03", f"{FOREST_SQL} SELECT key, root AS central FROM o")
def _prj03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).select("key", c("root").alias("central"))


@query("PRJ05", f"{FOREST_SQL} SELECT o.key, round(o.Mvir / 1000, 6) AS Rvir, round(o.Mvir / 100, 6) AS Vvir, round(r.Mvir, 6) AS CentralMvir, o.key + 7 AS SimulationHaloIndex FROM o JOIN o r ON r.key = o.root")
def _prj05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose own radius and velocity are out of date get those of their halo."""
    h = forest(spark, sf_dir).withColumns({"file_nr": F.lit(0), "halo_nr": c("key")})
    objects = h.select("file_nr", "tree_id", "halo_nr", "key", c("root").alias("fof_root"), F.lit(-1.0).alias("Rvir"), F.lit(-1.0).alias("Vvir"))
    new = {"Spin": F.array(F.lit(0.0)), "VelDisp": F.lit(0.0), "MostBoundID": c("key") + 7, "r_halo": c("Mvir") / 1000, "v_halo": c("Mvir") / 100, "m_halo": c("Mvir"), "is_root": c("fof_ord") == 0}
    return host_properties(objects, h.withColumns(new)).select("key", "Rvir", "Vvir", "CentralMvir", "SimulationHaloIndex")


@query("JON10", f"{FOREST_SQL} SELECT o.key, CASE WHEN e.prog IS NULL THEN 0 ELSE 1 END AS MergeStatus, coalesce(e.descendant, -1) AS mergeIntoBorn, coalesce(e.desc_snap, -1) AS mergeIntoSnapNum FROM o LEFT JOIN e ON e.prog = o.key AND e.chain_ord > 0")
def _jon10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of halos that aren't their descendant's first progenitor, noted in their own row."""
    h = forest(spark, sf_dir).withColumn("file_nr", F.lit(0))
    none = {"MergeStatus": F.lit(0), "mergeType": F.lit(0), "mergeIntoBorn": F.lit(-1).cast("long"), "mergeIntoSnapNum": F.lit(-1)}
    objects = h.select("file_nr", "tree_id", "key", c("key").alias("born"), "SnapNum").withColumns(none)
    gone = progenitors(h).filter("chain_ord > 0").select(F.lit(0).alias("file_nr"), "tree_id", c("prog").alias("born"), c("prog_snap").alias("prev_snap"), F.lit(1).alias("MergeStatus"), F.lit(1).alias("mergeType"), c("descendant").alias("mergeIntoBorn"), c("desc_snap").alias("mergeIntoSnapNum"))
    return write_back(objects, gone).select("key", "MergeStatus", "mergeIntoBorn", "mergeIntoSnapNum")


@query("JON03", f"{FOREST_SQL} SELECT e.descendant, o.o_orderkey AS prog, l.ord AS place FROM e JOIN orders o ON o.o_orderkey = e.prog JOIN ({GALAXIES_SQL} SELECT CentralHaloIndex, ord FROM g) l ON l.CentralHaloIndex = e.prog")
def _jon03(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = galaxies(spark, sf_dir).select(c("CentralHaloIndex").alias("prog"), c("ord").alias("place"))
    return progenitors(forest(spark, sf_dir)).join(held, "prog").select("descendant", "prog", "place")


@query("JON04", f"{GALAXIES_SQL} SELECT {_KEYS}, round(o_totalprice, 6) AS raw FROM g JOIN orders ON o_orderkey = CentralHaloIndex")
def _jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    halos = spark.read.parquet(f"{sf_dir}/orders.parquet").select(c("o_orderkey").alias("CentralHaloIndex"), c("o_totalprice").alias("raw"))
    return galaxies(spark, sf_dir).join(halos, "CentralHaloIndex").select(*KEYS, "raw")


@query("JON08", f"{GALAXIES_SQL} SELECT {_KEYS}, max(CASE WHEN Type < 1 THEN ord END) OVER (PARTITION BY CentralHaloIndex) AS central, count(*) FILTER (Type < 1) OVER (PARTITION BY CentralHaloIndex) AS centrals FROM g")
def _jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = Window.partitionBy("CentralHaloIndex")
    own = F.when(c("Type") < 1, c("ord"))
    return galaxies(spark, sf_dir).select(*KEYS, F.max(own).over(group).alias("central"), F.count(own).over(group).alias("centrals"))


@query("JON12", f"{GALAXIES_SQL} SELECT {_KEYS} FROM g WHERE Type = 0 AND CentralHaloIndex >= 0 AND CentralHaloIndex IN (SELECT CentralHaloIndex FROM g WHERE Type = 1)")
def _jon12(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = galaxies(spark, sf_dir)
    return g.filter("Type = 0 AND CentralHaloIndex >= 0").join(g.filter("Type = 1").select("CentralHaloIndex"), "CentralHaloIndex", "left_semi").select(*KEYS)


@query("WIN02", f"{FOREST_SQL} SELECT d.key, round(p.Mvir, 6) AS before, round(d.Mvir - p.Mvir, 6) AS grown FROM e JOIN o p ON p.key = e.prog JOIN o d ON d.key = e.descendant WHERE e.chain_ord = 0")
def _win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = forest(spark, sf_dir)
    p = h.select("tree_id", c("key").alias("prog"), c("Mvir").alias("before"))
    d = h.select("tree_id", c("key").alias("descendant"), "Mvir")
    return progenitors(h).filter("chain_ord = 0").join(p, ["tree_id", "prog"]).join(d, ["tree_id", "descendant"]).select(c("descendant").alias("key"), "before", (c("Mvir") - c("before")).alias("grown"))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("AGG02", f"{FOREST_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY descendant ORDER BY prog_len DESC, chain_ord) AS k, count(*) OVER (PARTITION BY descendant) AS held FROM e WHERE occupied) SELECT descendant, prog AS heaviest, prog_len AS largest, held FROM k WHERE k = 1")
def _agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct("prog_len", -c("chain_ord"))
    return progenitors(forest(spark, sf_dir)).filter("occupied").groupBy("descendant").agg(F.max_by("prog", first).alias("heaviest"), F.max("prog_len").alias("largest"), F.count("*").alias("held"))


@query("AGG05", f"{FOREST_SQL}, p AS (SELECT key, CAST(row_number() OVER (PARTITION BY tree_id, SnapNum ORDER BY key) - 1 AS INT) AS place FROM o) SELECT e.prog, p.place AS merged_into FROM e JOIN p ON p.key = e.descendant WHERE e.chain_ord > 0")
def _agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = forest(spark, sf_dir)
    place = h.select("tree_id", c("key").alias("descendant"), (F.row_number().over(Window.partitionBy("tree_id", "SnapNum").orderBy("key")) - 1).alias("merged_into"))
    return progenitors(h).filter("chain_ord > 0").join(place, ["tree_id", "descendant"]).select("prog", "merged_into")


_WIDE = "x AS (SELECT log10(Mvir) AS x FROM g WHERE Mvir > 0), s AS (SELECT floor(min(x)) - 1 AS lo, floor(max(x)) + 1 AS hi FROM x), r AS (SELECT *, CAST(floor((hi - lo) / 0.1e0) AS INT) AS nb FROM s), n AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / nb)) AS INT), nb - 1) AS bin, count(*) AS n FROM x, r WHERE x BETWEEN lo AND hi GROUP BY 1), k AS (SELECT *, unnest(range(nb)) AS kk FROM r)"
_BINS = f"{GALAXIES_SQL}, {_WIDE} SELECT CAST(kk AS INT) AS bin, round(lo + (kk + 0.5e0) * ((hi - lo) / nb), 6) AS center, coalesce(n.n, 0) AS n"
_FROM = "FROM k LEFT JOIN n ON n.bin = kk"


@query("AGG07", f"{_BINS} {_FROM}")
def _agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranged_histogram(galaxies(spark, sf_dir).filter("Mvir > 0"), F.log10("Mvir"), 0.1, 1).select("bin", "center", "n")


@query("AGG08", f"{_BINS}, round(coalesce(n.n, 0) / {VOLUME} / ((hi - lo) / nb), 6) AS phi {_FROM}")
def _agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume_density(ranged_histogram(galaxies(spark, sf_dir).filter("Mvir > 0"), F.log10("Mvir"), 0.1, 1), VOLUME, 1.0)


@query("AGG11", f"{GALAXIES_SQL} SELECT CAST(k AS INT) AS bin, count(g.ord) AS n, round(CASE WHEN count(g.ord) = 0 THEN 0e0 ELSE count(g.ord) FILTER (SfrDisk < 0.05) / count(g.ord) END, 6) AS quiet FROM range(60) t(k) LEFT JOIN g ON CAST(floor(StellarMass) AS INT) = k AND StellarMass < 60 GROUP BY k")
def _agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = galaxies(spark, sf_dir).filter("StellarMass >= 0 AND StellarMass < 60")
    found = g.groupBy(F.floor("StellarMass").cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count(F.when(c("SfrDisk") < 0.05, 1)).alias("_quiet"))
    spine = spark.range(60).select(c("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("_quiet", "n"), F.lit(0.0)).alias("quiet"))


@query("AGG13", f"{GALAXIES_SQL} SELECT CAST(floor(Mvir / 20000) AS INT) AS bin, count(*) AS n, round(avg(StellarMass), 4) AS mean FROM g WHERE Mvir >= 0 AND Mvir < 120000 GROUP BY 1", 4)
def _agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = galaxies(spark, sf_dir).select(digitize(c("Mvir"), [20000.0 * k for k in range(7)]).alias("bin"), "StellarMass").filter("bin is not null")
    return bins.groupBy("bin").agg(F.count("*").alias("n"), F.avg("StellarMass").alias("mean"))


_FIXED = f"{GALAXIES_SQL}, b AS (SELECT k, count(ord) AS n FROM range(25) t(k) LEFT JOIN g ON least(CAST(floor(StellarMass / 2) AS INT), 24) = k AND StellarMass BETWEEN 0 AND 50 GROUP BY k)"


@query("AGG16", f"{_FIXED} SELECT CAST(k AS INT) AS bin, round(n / 2e0 / (SELECT count(*) FROM g), 6) AS share FROM b")
def _agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = galaxies(spark, sf_dir)
    total = F.broadcast(g.agg(F.count("*").alias("_all")))
    return fixed_histogram(g, c("StellarMass"), 0.0, 50.0, 25).crossJoin(total).select("bin", F.try_divide(c("n") / 2.0, "_all").alias("share"))


@query("AGG17", f"{_FIXED} SELECT CAST(k AS INT) AS bin, round(n / (SELECT max(n) FROM b), 6) AS height FROM b")
def _agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = fixed_histogram(galaxies(spark, sf_dir), c("StellarMass"), 0.0, 50.0, 25)
    return bins.crossJoin(F.broadcast(bins.agg(F.max("n").alias("_top")))).select("bin", F.try_divide("n", "_top").alias("height"))


@query("AGG18", f"{GALAXIES_SQL} SELECT count(*) FILTER (ColdGas = 0) AS zeros, count(*) FILTER (isnan(ColdGas)) AS nans, count(*) FILTER (isinf(ColdGas)) AS infinite, count(*) FILTER (ColdGas < 0 OR ColdGas > 4) AS outside FROM g")
def _agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = c("ColdGas")
    tests = {"zeros": x == 0, "nans": F.isnan(x), "infinite": F.abs(x) == float("inf"), "outside": (x < 0) | (x > 4)}
    return galaxies(spark, sf_dir).agg(*[F.count(F.when(t, 1)).alias(k) for k, t in tests.items()])


# --- cosmology -------------------------------------------------------------------------------------------------------

_COSMOLOGY, _UNITS = Cosmology(), Units()


def _age(a: str) -> str:
    """The age at scale factor a of a flat universe, in closed form."""
    c_ = _COSMOLOGY
    return f"2e0 / (3 * {_UNITS.hubble!r}e0 * sqrt({c_.omega_lambda}e0)) * asinh(sqrt({c_.omega_lambda / c_.omega}e0 * pow({a}, 3)))"


@query("SCL09", f"WITH {SNAPS_SQL} SELECT snap, round({_age('1e0')} - {_age('1 / (1 + z)')}, 6) AS lookback FROM snaps")
def _scl09(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = [(s, _COSMOLOGY.lookback((2001 - s) * 0.6)) for s in range(1995, 2002)]
    return snaps(spark).join(F.broadcast(spark.createDataFrame(times, "snap int, lookback double")), "snap").select("snap", "lookback")
