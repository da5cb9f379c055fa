"""The registered queries of the engine, keyed by operator, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions import galaxy as G
from canopy.functions import numeric as N
from canopy.operators import mergers as M
from canopy.operators import physics as P
from canopy.operators import quality
from canopy.operators.forest import first_occupied
from canopy.operators.histogram import edges
from canopy.operators.output import infall_values, time_in_myr
from canopy.plans import analytics as A
from canopy.plans.standin import FOREST_SQL, GALAXIES_SQL, H, SNAPS_SQL, VECTORS_SQL, VOLUME, forest, galaxies, progenitors, snaps, vectors
from canopy.sources.catalogue import decode_index, encode_index
from canopy.units import BOLTZMANN, PROTON_MASS, SEC_PER_MEGAYEAR, Cosmology

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["CentralHaloIndex", "ord"]
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select([F.round(F.col(f.name).cast("double"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None, digits: int = DIGITS) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def over_galaxies(name: str, make: Callable[[], dict[str, Column]], sql: dict[str, str], where: str | None = None, digits: int = DIGITS) -> None:
    """A query of expressions over the galaxy view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = galaxies(spark, sf_dir)
        return (g.filter(where) if where else g).select(*KEYS, *[v.alias(k) for k, v in make().items()])

    body = ", ".join(f"round(CAST({v} AS DOUBLE), {digits}) AS {k}" if not v.startswith("!") else f"{v[1:]} AS {k}" for k, v in sql.items())
    query(name, f"{GALAXIES_SQL} SELECT {', '.join(KEYS)}, {body} FROM g" + (f" WHERE {where}" if where else ""), digits)(run)


def c(name: str) -> Column:
    return F.col(name)


# --- scalar functions ------------------------------------------------------------------------------------------------

_SX = "(deltaMvir * 1e-12)"
over_galaxies("SCL01", lambda: {"a": N.is_zero(c("deltaMvir") * 1e-12)}, {"a": f"!abs({_SX}) < 1e-10"})
over_galaxies("SCL02", lambda: {"a": N.is_equal(c("ColdGas"), c("ICS"))}, {"a": "!ColdGas = ICS OR abs(ColdGas - ICS) < 1e-6"})
over_galaxies(
    "SCL03",
    lambda: {"gt": N.is_greater(c("ColdGas"), c("ICS")), "lt": N.is_less(c("ColdGas"), c("ICS")), "ge": N.is_greater_or_equal(c("ColdGas"), c("ICS")), "le": N.is_less_or_equal(c("ColdGas"), c("ICS"))},
    {"gt": "!ColdGas > ICS + 1e-10", "lt": "!ColdGas < ICS - 1e-10", "ge": "!ColdGas >= ICS - 1e-10", "le": "!ColdGas <= ICS + 1e-10"},
)
over_galaxies("SCL04", lambda: {"a": N.is_within(c("ColdGas"), F.lit(0.5), F.lit(2.0))}, {"a": "!ColdGas >= 0.5e0 - 1e-10 AND ColdGas <= 2e0 + 1e-10"})
over_galaxies("SCL05", lambda: {"a": N.safe_div(c("ColdGas"), c("ICS"), 7.0)}, {"a": "CASE WHEN abs(ICS) < 1e-10 THEN 7e0 ELSE ColdGas / ICS END"})
over_galaxies("SCL06", lambda: {"a": N.clamp(c("Mvir"), 5000.0, 50000.0), "b": N.is_finite(c("Mvir")), "s": N.sign(c("deltaMvir"))}, {"a": "greatest(5000e0, least(50000e0, Mvir))", "b": "!isfinite(Mvir)", "s": "!CAST(sign(deltaMvir) AS INT)"})
over_galaxies("SCL08", lambda: {"z": G.redshift(c("Len") / 50.0)}, {"z": "1 / (Len / 50e0) - 1"})
_RHO = Cosmology().critical_density(0.0)
_G = Cosmology().units.gravity
over_galaxies("SCL11", lambda: {"m": G.virial_mass(A.central(), c("deltaMvir"), c("Len"), 0.1)}, {"m": "CASE WHEN Type = 0 AND deltaMvir >= 0 THEN deltaMvir ELSE Len * 0.1e0 END"})
over_galaxies("SCL12", lambda: {"r": G.virial_radius(c("Mvir"), F.lit(_RHO))}, {"r": f"cbrt(Mvir / ({_RHO!r}e0 * (200 * 4 * pi() / 3)))"})
over_galaxies("SCL13", lambda: {"v": G.virial_velocity(c("Mvir"), c("Rvir"), _G)}, {"v": f"CASE WHEN Rvir > 0 THEN sqrt({_G!r}e0 * Mvir / Rvir) ELSE 0e0 END"})
over_galaxies("SCL14", lambda: {"z": G.metallicity(c("ColdGas"), c("MetalsColdGas"))}, {"z": "CASE WHEN ColdGas <= 1e-10 THEN 0e0 ELSE MetalsColdGas / ColdGas END"})
over_galaxies("SCL15", lambda: {"a": G.spin_parameter(c("StellarMass"), c("Vvir"), c("Rvir")), "r": G.disk_radius(c("StellarMass"), c("Vvir"), c("Rvir"))}, {"a": "StellarMass / (1.414213562e0 * Vvir * Rvir)", "r": "StellarMass / (1.414213562e0 * Vvir * Rvir) / 1.414213562e0 * Rvir"})


def model_tables() -> list[list[float]]:
    """Smooth log rates on the cooling grid, by rule: what the interpolation is tested on."""
    return [[-23.0 + 0.05 * i + 1.5 * math.sin(t / 12.0) - 0.002 * (t - 40) for t in range(G.LOG_T_ROWS)] for i in range(len(G.COOLING_DEX))]


_GRID = [x + math.log10(G.SOLAR_METALLICITY) for x in G.COOLING_DEX]


def rate_sql(log_t: str, log_z: str, source: str) -> str:
    """CTEs that end in ``rated``: the source with log_rate, interpolated in the rule of model_tables."""
    listed = "[" + ", ".join(f"{g!r}e0" for g in _GRID) + "]"

    def table(i: str, k: str) -> str:
        return f"(-23e0 + 0.05e0 * ({i}) + 1.5e0 * sin(({k}) / 12e0) - 0.002e0 * (({k}) - 40))"

    def along(i: str) -> str:
        return f"({table(i, 'k')} + ({table(i, 'k + 1')} - {table(i, 'k')}) * p)"

    return (
        f"r1 AS (SELECT *, greatest(4e0, {log_t}) AS lt, greatest({_GRID[0]!r}e0, least({_GRID[-1]!r}e0, {log_z})) AS lz FROM {source}), "
        f"r2 AS (SELECT *, least(CAST(floor((lt - 4) / 0.05e0) AS INT), {G.LOG_T_ROWS - 2}) AS k, len(list_filter({listed}[2:{len(_GRID) - 1}], lambda g: lz > g)) AS i FROM r1), "
        f"r3 AS (SELECT *, (lt - 4 - 0.05e0 * k) / 0.05e0 AS p, {listed}[i + 1] AS z0, {listed}[i + 2] AS z1 FROM r2), "
        f"rated AS (SELECT *, {along('i')} + ({along('i + 1')} - {along('i')}) / (z1 - z0) * (lz - z0) AS log_rate FROM r3)"
    )


@query("SCL16", f"{GALAXIES_SQL}, {rate_sql('3.5e0 + Mvir / 20000', 'log10(greatest(SfrDisk, 1e-6))', 'g')} SELECT CentralHaloIndex, ord, round(log_rate, 4) AS rate FROM rated", digits=4)
def _scl16(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = galaxies(spark, sf_dir)
    return g.select(*KEYS, F.log10(G.cooling_rate(3.5 + c("Mvir") / 20000, F.log10(F.greatest(c("SfrDisk"), F.lit(1e-6))), model_tables())).alias("rate"))


_ION = G.Reionization(form="corrected").scale_mass(1.0, Cosmology())
over_galaxies("SCL17", lambda: {"f": G.Reionization().modifier(c("StellarMass"), F.lit(_ION))}, {"f": f"1 / pow(1 + 0.26e0 * {_ION!r}e0 / (StellarMass + 1e-10), 3)"})
over_galaxies("SCL18", lambda: {"t": G.merging_time(c("Len") * 10, c("Len"), c("Rvir"), c("Vvir"), c("Mvir"))}, {"t": "2 * 1.17e0 * Rvir * Rvir * Vvir / (ln(Len * 10e0 / Len + 1) * 43.0071e0 * Mvir)"})
over_galaxies("SCL19", lambda: {"m": G.log_mass(c("ColdGas"), H)}, {"m": f"CASE WHEN ColdGas > 0 THEN log10(ColdGas * 1e10 / {H}e0) END"})
over_galaxies("SCL21", lambda: {"z": G.log_metallicity(c("MetalsColdGas"), c("ColdGas"))}, {"z": "log10(MetalsColdGas / ColdGas / 0.02e0) + 9"}, where="MetalsColdGas > 0")
over_galaxies("SCL22", lambda: {"a": G.log_floor(c("ColdGas"))}, {"a": "log10(greatest(ColdGas, 1e0))"})
over_galaxies("SCL23", lambda: {"s": G.specific_sfr(c("SfrDisk"), c("StellarMass"), H)}, {"s": f"CASE WHEN SfrDisk > 0 AND StellarMass > 0 THEN log10(SfrDisk / (StellarMass * 1e10 / {H}e0)) ELSE -15e0 END"})
over_galaxies(
    "SCL24",
    lambda: {"s": G.schechter(F.log10(c("Mvir")) + 6, 10.5, 0.0108, -1.21) * 1e4, "n": G.log_normal(c("StellarMass") / 100, 0.035, 0.5), "q": G.mass_metallicity(F.log10(c("Mvir"))), "t": G.tully_fisher(F.log10(c("Vmax")))},
    {
        "s": "0.0108e0 * ln(10e0) * pow(pow(10e0, log10(Mvir) + 6 - 10.5e0), -0.21e0) * exp(-pow(10e0, log10(Mvir) + 6 - 10.5e0)) * 1e4",
        "n": "exp(-pow(ln(StellarMass / 100 / 0.035e0), 2) / 0.5e0) / (StellarMass / 100 * 0.5e0 * sqrt(2 * pi()))",
        "q": "-1.492e0 + 1.847e0 * log10(Mvir) - 0.08026e0 * log10(Mvir) * log10(Mvir)",
        "t": "3.94e0 * log10(Vmax) + 1.79e0",
    },
)


@query("SCL20", f"{VECTORS_SQL} SELECT vec_id, round(sqrt(list_sum(list_transform(Pos, lambda x: CAST(x AS DOUBLE) * x))), 6) AS r, round((Vel[1] * Pos[1] + Vel[2] * Pos[2] + Vel[3] * Pos[3]) / 100, 6) AS d FROM v")
def _scl20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", G.norm(c("Pos")).alias("r"), (G.dot(c("Vel"), c("Pos")) / 100).alias("d"))


# --- projections and filters -----------------------------------------------------------------------------------------

over_galaxies("PRJ01", lambda: {"infall": infall_values(c("Type"), c("Mvir"))}, {"infall": "CASE WHEN Type <> 0 THEN Mvir ELSE 0e0 END"})
_MYR = Cosmology().units.time_s / SEC_PER_MEGAYEAR
over_galaxies("PRJ04", lambda: {"dT": time_in_myr(F.when(c("dT") < 0, -1.0).otherwise(c("dT")), Cosmology())}, {"dT": f"CASE WHEN dT < 0 THEN -1e0 ELSE dT * {_MYR!r}e0 END"})
over_galaxies("FLT02", lambda: {"m": c("StellarMass")}, {"m": "StellarMass"}, where="Type = 0 AND ColdGas > 0")
over_galaxies("FLT01", lambda: {"s": c("SnapNum")}, {"s": "!SnapNum"}, where="SnapNum IN (1996, 1999)")
over_galaxies("FLT04", lambda: {"s": c("Type")}, {"s": "!Type"}, where="NOT (Type < 2 AND ColdGas = 0)")
_ODD = "CASE WHEN Len % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN Len % 7 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE Mvir END"


@query("FLT06", f"{GALAXIES_SQL}, o AS (SELECT CentralHaloIndex, ord, {_ODD} AS a FROM g) SELECT CentralHaloIndex, ord, round(a, 6) AS a FROM o WHERE isfinite(a)")
def _flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return galaxies(spark, sf_dir).select(*KEYS, F.expr(_ODD).alias("a")).filter(N.is_finite(c("a")))




@query("PRJ02", "SELECT o_orderkey, CAST(o_orderkey % 1000 + (o_custkey % 500) * 1000000000 + (o_orderkey % 7) * 1000000000000000 AS BIGINT) AS idx, CAST(o_orderkey % 7 AS BIGINT) AS f, CAST(o_custkey % 500 AS BIGINT) AS t, CAST(o_orderkey % 1000 AS BIGINT) AS h FROM orders")
def _prj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("idx", encode_index(c("o_orderkey") % 7, c("o_custkey") % 500, c("o_orderkey") % 1000))
    f, t, h = decode_index(c("idx"))
    return o.select("o_orderkey", "idx", f.alias("f"), t.alias("t"), h.alias("h"))


# --- joins and windows over the forest -------------------------------------------------------------------------------


@query("JON01", f"{FOREST_SQL} SELECT tree_id, descendant, prog, CAST(chain_ord AS BIGINT) AS chain_ord FROM e")
def _jon01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progenitors(forest(spark, sf_dir)).select("tree_id", "descendant", "prog", "chain_ord")


@query("JON02", f"{FOREST_SQL} SELECT r.tree_id, r.key AS root, m.key AS member, CAST(m.fof_ord AS BIGINT) AS fof_ord FROM o r JOIN o m ON m.root = r.key AND m.tree_id = r.tree_id WHERE r.fof_ord = 0")
def _jon02(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = forest(spark, sf_dir)
    roots = h.filter("fof_ord = 0").select("tree_id", "root")
    return roots.join(h.select("tree_id", "root", F.col("key").alias("member"), "fof_ord"), ["tree_id", "root"])


@query("JON05", f"{FOREST_SQL} SELECT m.key, round(r.Mvir, 6) AS central FROM o m JOIN o r ON m.root = r.key")
def _jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = forest(spark, sf_dir)
    return h.select("key", "root").join(h.select(c("key").alias("root"), c("Mvir").alias("central")), "root").select("key", "central")


@query("JON06", f"{FOREST_SQL}, {SNAPS_SQL} SELECT key, round(z, 6) AS z FROM o JOIN snaps ON SnapNum = snap")
def _jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).join(F.broadcast(snaps(spark).withColumnRenamed("snap", "SnapNum")), "SnapNum").select("key", "z")


@query("JON07", f"{FOREST_SQL} SELECT tree_id, key FROM o WHERE fof_ord = 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.descendant = o.key AND e.occupied)")
def _jon07(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = forest(spark, sf_dir)
    held = progenitors(h).filter("occupied").select(c("descendant").alias("key"))
    return h.filter("fof_ord = 0").join(held, "key", "left_anti").select("tree_id", "key")


@query("JON11", f"{GALAXIES_SQL} SELECT {', '.join(KEYS)} FROM g WHERE CentralHaloIndex IN (SELECT CentralHaloIndex FROM g WHERE Type = 0 AND Mvir > 80000)")
def _jon11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = galaxies(spark, sf_dir)
    return g.join(g.filter("Type = 0 AND Mvir > 80000").select("CentralHaloIndex"), "CentralHaloIndex", "left_semi").select(*KEYS)


@query("JON13", f"{GALAXIES_SQL} SELECT c.CentralHaloIndex, round(c.Mvir, 6) AS Mvir, round(sum(m.ColdGas), 6) AS cold FROM g c JOIN g m ON c.CentralHaloIndex = m.CentralHaloIndex WHERE c.Type = 0 GROUP BY ALL")
def _jon13(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = galaxies(spark, sf_dir)
    return g.filter("Type = 0").select("CentralHaloIndex", "Mvir").join(g.groupBy("CentralHaloIndex").agg(F.sum("ColdGas").alias("cold")), "CentralHaloIndex")


_NEAREST = f"{SNAPS_SQL}, want AS (SELECT unnest([0e0, 1e0, 2e0, 3e0]) AS target, unnest([0.2e0, 0.5e0, 0.5e0, 0.5e0]) AS tolerance), near AS (SELECT target, tolerance, min(z) AS z FROM snaps JOIN want ON z >= target GROUP BY ALL), chosen AS (SELECT target, snap, snaps.z FROM near JOIN snaps USING (z) WHERE snaps.z - target <= tolerance)"


@query("JON14", f"WITH {_NEAREST} SELECT round(target, 6) AS target, snap, round(z, 6) AS z FROM chosen")
def _jon14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nearest_snapshots(snaps(spark))


@query("JON15", f"WITH {SNAPS_SQL} SELECT snap, printf('_z%.3f', z) AS name FROM snaps")
def _jon15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snaps(spark).select("snap", F.format_string("_z%.3f", c("z")).alias("name"))


@query("WIN01", f"{FOREST_SQL} SELECT tree_id, descendant, prog AS winner FROM (SELECT *, row_number() OVER (PARTITION BY descendant ORDER BY CASE WHEN chain_ord = 0 THEN 0 ELSE 1 END, prog_len DESC, chain_ord) AS k FROM e WHERE occupied) WHERE k = 1")
def _win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = progenitors(forest(spark, sf_dir)).filter("occupied").withColumn("file_nr", F.lit(0))
    return first_occupied(held, "descendant").select("tree_id", "descendant", "winner").distinct()


@query("WIN03", f"{FOREST_SQL}, {SNAPS_SQL} SELECT prog, round(a.z - b.z, 6) AS dt FROM e JOIN snaps a ON a.snap = prog_snap JOIN snaps b ON b.snap = desc_snap")
def _win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snaps(spark)
    e = progenitors(forest(spark, sf_dir))
    return e.join(F.broadcast(s.toDF("prog_snap", "za")), "prog_snap").join(F.broadcast(s.toDF("desc_snap", "zb")), "desc_snap").select("prog", (c("za") - c("zb")).alias("dt"))


@query("WIN04", f"{FOREST_SQL} SELECT key, CAST(row_number() OVER (PARTITION BY tree_id, root ORDER BY fof_ord) - 1 AS INT) AS ordinal FROM o")
def _win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).select("key", (F.row_number().over(Window.partitionBy("tree_id", "root").orderBy("fof_ord")) - 1).alias("ordinal"))


@query("WIN05", f"{GALAXIES_SQL} SELECT {', '.join(KEYS)}, CAST(coalesce(sum(CASE WHEN ColdGas = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY CentralHaloIndex ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier FROM g")
def _win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("CentralHaloIndex").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return galaxies(spark, sf_dir).select(*KEYS, F.coalesce(F.sum(F.when(c("ColdGas") == 0, 1).otherwise(0)).over(before), F.lit(0)).cast("long").alias("earlier"))


@query("WIN06", f"{FOREST_SQL}, s AS (SELECT tree_id, count(*) AS n FROM o GROUP BY 1) SELECT tree_id, n AS n_halos, CAST(coalesce(sum(n) OVER (ORDER BY tree_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_halo FROM s")
def _win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.sources.trees import tree_table

    return tree_table(forest(spark, sf_dir).withColumn("file_nr", F.lit(0))).select("tree_id", "n_halos", c("first_halo").cast("long").alias("first_halo"))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("AGG01", f"{GALAXIES_SQL} SELECT CentralHaloIndex, round(sum(StellarMass), 6) AS stars, round(sum(ColdGas), 6) AS cold, round(sum(HotGas), 6) AS hot, round(sum(CASE WHEN Type <> 0 THEN StellarMass + ColdGas + HotGas ELSE 0 END), 6) AS satellites FROM g GROUP BY 1")
def _agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = c("StellarMass") + c("ColdGas") + c("HotGas")
    return galaxies(spark, sf_dir).groupBy("CentralHaloIndex").agg(F.sum("StellarMass").alias("stars"), F.sum("ColdGas").alias("cold"), F.sum("HotGas").alias("hot"), F.sum(F.when(c("Type") != 0, own).otherwise(0.0)).alias("satellites"))


@query("AGG03", f"{FOREST_SQL} SELECT SnapNum, tree_id, count(*) AS n FROM o GROUP BY ALL")
def _agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).groupBy("SnapNum", "tree_id").agg(F.count("*").alias("n"))


@query("AGG04", f"{FOREST_SQL} SELECT key, CAST(row_number() OVER (PARTITION BY tree_id, SnapNum ORDER BY key) - 1 AS INT) AS place FROM o")
def _agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir).select("key", (F.row_number().over(Window.partitionBy("tree_id", "SnapNum").orderBy("key")) - 1).alias("place"))


@query("AGG06", f"{GALAXIES_SQL} SELECT CAST(k AS INT) AS bin, round((k + 0.5e0) * 1e0, 6) AS center, count(StellarMass) AS n FROM range(50) t(k) LEFT JOIN g ON least(CAST(floor(StellarMass) AS INT), 49) = k AND StellarMass BETWEEN 0 AND 50 GROUP BY k")
def _agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.operators.histogram import fixed_histogram

    return fixed_histogram(galaxies(spark, sf_dir), c("StellarMass"), 0.0, 50.0, 50)


@query("AGG09", f"{GALAXIES_SQL} SELECT Len, round(avg(HotGas), 4) AS mean, round(var_pop(SfrDisk), 4) AS variance FROM g GROUP BY 1", 4)
def _agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return galaxies(spark, sf_dir).groupBy("Len").agg(F.avg("HotGas").alias("mean"), F.var_pop("SfrDisk").alias("variance"))


@query("AGG10", f"{GALAXIES_SQL} SELECT CentralHaloIndex, count(*) AS n, round(avg(ColdGas), 6) AS cold FROM g GROUP BY 1 HAVING count(*) >= 3")
def _agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return galaxies(spark, sf_dir).groupBy("CentralHaloIndex").agg(F.count("*").alias("n"), F.avg("ColdGas").alias("cold")).filter("n >= 3")


@query("AGG12", f"{GALAXIES_SQL} SELECT SnapNum, count(*) AS n, count(DISTINCT CentralHaloIndex) AS groups FROM g GROUP BY 1")
def _agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return galaxies(spark, sf_dir).groupBy("SnapNum").agg(F.count("*").alias("n"), F.countDistinct("CentralHaloIndex").alias("groups"))


@query("AGG14", f"{GALAXIES_SQL} SELECT SnapNum, round(sum(SfrDisk) / {VOLUME}, 6) AS rho FROM g GROUP BY 1")
def _agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return galaxies(spark, sf_dir).groupBy("SnapNum").agg((F.sum("SfrDisk") / VOLUME).alias("rho"))


@query("AGG15", f"{GALAXIES_SQL} SELECT round(min(Mvir), 6) AS lo, round(max(Mvir), 6) AS hi, round(avg(Mvir), 4) AS mean, round(median(StellarMass), 6) AS middle FROM g", 4)
def _agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return galaxies(spark, sf_dir).agg(F.min("Mvir").alias("lo"), F.max("Mvir").alias("hi"), F.avg("Mvir").alias("mean"), F.median("StellarMass").alias("middle"))


@query("AGG19", "SELECT vec_id, round(list_avg(list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE))), 6) AS mean FROM embeddings")
def _agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.slice("embedding", 1, 10)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.aggregate(steps, F.lit(0.0), lambda a, e: a + e.cast("double")) / 10).alias("mean"))


@query("SET01", "SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderkey FROM orders")
def _set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("k")).unionByName(spark.read.parquet(f"{sf_dir}/orders.parquet").select(c("o_orderkey").alias("k")))


@query("SRT01", f"WITH {SNAPS_SQL} SELECT snap, round(z, 6) AS z FROM snaps ORDER BY z")
def _srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snaps(spark).orderBy("z")


@query("LIM02", f"{GALAXIES_SQL} SELECT {', '.join(KEYS)} FROM g WHERE ColdGas = 0 ORDER BY 1, 2 LIMIT 5")
def _lim02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.examples(galaxies(spark, sf_dir), c("ColdGas") == 0, KEYS).select(*KEYS)


@query("LIM03", f"WITH {SNAPS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY z) - 1 AS k, count(*) OVER () AS n FROM snaps) SELECT snap, round(z, 6) AS z FROM r WHERE k % greatest(1, n // 3) = 0 AND k / greatest(1, n // 3) < 3")
def _lim03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.even_snapshots(snaps(spark), 3)


@query("LIM04", f"WITH {SNAPS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY z) - 1 AS k, count(*) OVER () AS n FROM snaps), t AS (SELECT *, greatest(1, (n - 2) // 3) AS step FROM r) SELECT snap, round(z, 6) AS z FROM t WHERE k = 0 OR k = n - 1 OR (k > 0 AND k < n - 1 AND (k - 1) % step = 0 AND (k - 1) / step < 3)")
def _lim04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.diverse_snapshots(snaps(spark), 3)


@query("LIM01")
def _lim01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spatial_distribution(vectors(spark, sf_dir), 100)


# --- catalogue queries -----------------------------------------------------------------------------------------------


def mass_sql(mass: str, where: str, margin: int, clamp: tuple[float, float] | None, by: str | None = None, extra: str = "", source: str = "g") -> str:
    lo, hi = (f"greatest(floor(min(x)) - {margin}, {clamp[0]}e0)", f"least(floor(max(x)) + {margin}, {clamp[1]}e0)") if clamp else (f"floor(min(x)) - {margin}", f"floor(max(x)) + {margin}")
    b = f"{by}, " if by else ""
    on = f" AND r.{by} = n.{by}" if by else ""
    return (
        f"{GALAXIES_SQL}{extra}, x AS (SELECT {b}log10(({mass}) * 1e10 / {H}e0) AS x FROM {source} WHERE {where}), s AS (SELECT {b}CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi FROM x GROUP BY ALL), "
        f"r AS (SELECT *, CAST(floor((hi - lo) / 0.1e0) AS INT) AS nb FROM s), "
        f"n AS (SELECT {('x.' + by + ', ') if by else ''}least(CAST(floor((x - lo) / ((hi - lo) / nb)) AS INT), nb - 1) AS bin, count(*) AS n FROM x JOIN r ON {('x.' + by + ' = r.' + by) if by else 'true'} WHERE x BETWEEN lo AND hi GROUP BY ALL), "
        f"k AS (SELECT *, unnest(range(nb)) AS kk FROM r) "
        f"SELECT {('round(r.' + by + ', 6) AS ' + by + ', ') if by else ''}CAST(kk AS INT) AS bin, round(lo + (kk + 0.5e0) * ((hi - lo) / nb), 6) AS center, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) / {VOLUME} * pow({H}e0, 3) / ((hi - lo) / nb), 6) AS phi FROM k r LEFT JOIN n ON n.bin = kk{on}"
    )


query("QRY01", mass_sql("Mvir", "Type = 0 AND Mvir > 0", 1, (10.0, 16.0)))(lambda s, d: A.halo_mass_function(galaxies(s, d), H, VOLUME))
query("QRY02", mass_sql("StellarMass", "Type = 0 AND StellarMass > 0", 1, (8.0, 12.5)))(lambda s, d: A.stellar_mass_function(galaxies(s, d), H, VOLUME))
query("QRY03", mass_sql("ColdGas", "Type = 0 AND ColdGas > 0", 1, (8.0, 12.5)))(lambda s, d: A.cold_gas_function(galaxies(s, d), H, VOLUME))
query("QRY04", mass_sql("StellarMass + ColdGas", "StellarMass + ColdGas > 0", 2, None))(lambda s, d: A.baryonic_mass_function(galaxies(s, d), H, VOLUME))
query("QRY05", mass_sql("ColdGas", "ColdGas > 0", 2, None))(lambda s, d: A.gas_mass_function(galaxies(s, d), H, VOLUME))
_EVO = f", {_NEAREST}, j AS (SELECT g.*, target FROM g JOIN chosen ON SnapNum = snap)"
query("QRY19", mass_sql("Mvir", "Type = 0 AND Mvir > 0", 1, (10.0, 16.0), "target", _EVO, "j"))(lambda s, d: A.mass_function_evolution(galaxies(s, d), snaps(s), H, VOLUME))
query("QRY20", mass_sql("StellarMass", "Type = 0 AND StellarMass > 0", 1, (8.0, 12.5), "target", _EVO, "j"))(lambda s, d: A.mass_function_evolution(galaxies(s, d), snaps(s), H, VOLUME, True))


def bin_sql(value: str, marks: list[float]) -> str:
    """The left-closed bin of a value between edges."""
    listed = "[" + ", ".join(f"{m!r}e0" if "e" not in repr(m) else repr(m) for m in marks) + "]"
    return f"CASE WHEN {value} >= {marks[0]!r}e0 AND {value} < {marks[-1]!r}e0 THEN CAST(len(list_filter({listed}, lambda e: e <= {value})) - 1 AS INT) END"


def _logm(m: str) -> str:
    return f"log10(({m}) * 1e10 / {H}e0)"


query("QRY06", f"{GALAXIES_SQL}, q AS (SELECT CentralHaloIndex, count(*) AS n_all, sum(CASE WHEN Type <> 0 THEN 1 ELSE 0 END) AS n_sat, max(CASE WHEN Type = 0 THEN Mvir END) AS m FROM g GROUP BY 1), b AS (SELECT *, {bin_sql(_logm('m'), edges(10, 15, 0.2))} AS bin FROM q WHERE m > 0) SELECT bin, count(*) AS groups, round(avg(n_all), 6) AS mean_all, round(avg(n_sat), 6) AS mean_satellites FROM b WHERE bin IS NOT NULL GROUP BY 1")(lambda s, d: A.halo_occupation(galaxies(s, d), H))
_NORM = "sqrt(CAST({0}[1] AS DOUBLE) * {0}[1] + CAST({0}[2] AS DOUBLE) * {0}[2] + CAST({0}[3] AS DOUBLE) * {0}[3])"
query(
    "QRY07",
    f"{VECTORS_SQL}, w AS (SELECT {_NORM.format('Vel')} AS v, {_NORM.format('Pos')} AS r, {_NORM.format('Spin')} AS j FROM v), x AS (SELECT j / (1.414213562e0 * v * r) AS x FROM w WHERE v > 0 AND r > 0 AND j > 0), "
    "h AS (SELECT k, -0.02e0 + (k + 0.5e0) * (0.52e0 / 52) AS center, count(x) AS n FROM range(52) t(k) LEFT JOIN x ON least(CAST(floor((x + 0.02e0) / (0.52e0 / 52)) AS INT), 51) = k AND x > 0 AND x < 1 AND x <= 0.5 GROUP BY k), "
    "u AS (SELECT *, CASE WHEN center > 0 THEN exp(-pow(ln(CASE WHEN center > 0 THEN center ELSE 1 END / 0.035e0), 2) / 0.5e0) / (center * 0.5e0 * sqrt(2 * pi())) ELSE 0e0 END AS c FROM h) "
    "SELECT CAST(k AS INT) AS bin, round(center, 6) AS center, n, round(c / (SELECT max(c) FROM u) * (SELECT max(n) FROM u), 6) AS curve FROM u",
)(lambda s, d: A.spin_distribution(vectors(s, d)))
query(
    "QRY08",
    f"{VECTORS_SQL}, w AS (SELECT *, {_NORM.format('Pos')} AS r FROM v), s AS (SELECT 'los' AS component, (Vel[1] * Pos[1] + Vel[2] * Pos[2] + Vel[3] * Pos[3]) / r / {100 * H}e0 AS x FROM w WHERE r > 0 UNION ALL SELECT 'x', Vel[1] / {100 * H}e0 FROM w WHERE r > 0 UNION ALL SELECT 'y', Vel[2] / {100 * H}e0 FROM w WHERE r > 0 UNION ALL SELECT 'z', Vel[3] / {100 * H}e0 FROM w WHERE r > 0), "
    "t AS (SELECT component, count(*) AS a FROM s GROUP BY 1), c AS (SELECT component, least(CAST(floor((x + 40) / 0.5e0) AS INT), 159) AS bin, count(*) AS n FROM s WHERE x BETWEEN -40 AND 40 GROUP BY ALL) "
    "SELECT t.component, CAST(k AS INT) AS bin, round(-40 + (k + 0.5e0) * 0.5e0, 6) AS center, round(coalesce(n, 0) / 0.5e0 / a, 6) AS density FROM t CROSS JOIN range(160) u(k) LEFT JOIN c ON c.component = t.component AND c.bin = k",
)(lambda s, d: A.velocity_distribution(vectors(s, d), H))
query("QRY09", f"{VECTORS_SQL} SELECT round(Pos[1], 6) AS x, round(Pos[2], 6) AS y, round(Pos[3], 6) AS z FROM v", 6)(lambda s, d: A.spatial_distribution(vectors(s, d).withColumn("Pos", F.transform("Pos", lambda e: e.cast("double"))), None))
ORACLES["QRY09"] = ORACLES["QRY09"].replace("round(Pos[1]", "round(CAST(Pos[1] AS DOUBLE)").replace("round(Pos[2]", "round(CAST(Pos[2] AS DOUBLE)").replace("round(Pos[3]", "round(CAST(Pos[3] AS DOUBLE)")
_PARTS = {"stars": "StellarMass + BulgeMass", "cold": "ColdGas", "hot": "HotGas", "ejected": "EjectedMass", "ics": "ICS", "bh": "BlackHoleMass"}
query(
    "QRY10",
    f"{GALAXIES_SQL}, s AS (SELECT CentralHaloIndex, {', '.join(f'sum({v}) AS {k}' for k, v in _PARTS.items())} FROM g GROUP BY 1), h AS (SELECT CentralHaloIndex, Mvir, {bin_sql(_logm('Mvir'), edges(11, 16, 0.1))} AS bin FROM g WHERE Type = 0 AND Mvir > 0) "
    f"SELECT bin, count(*) AS n, round(avg(({' + '.join(_PARTS)}) / Mvir), 6) AS f_total, {', '.join(f'round(avg({k} / Mvir), 6) AS f_{k}' for k in _PARTS)} FROM h JOIN s USING (CentralHaloIndex) WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 3",
)(lambda s, d: A.baryon_fraction(galaxies(s, d), H))
query("QRY11", f"{GALAXIES_SQL}, b AS (SELECT {bin_sql(_logm('StellarMass'), edges(8.4, 12.2, 0.2))} AS bin, BulgeMass / StellarMass AS f FROM g WHERE StellarMass > 0) SELECT bin, count(*) AS n, round(avg(f), 6) AS bulge, round(avg(1 - f), 6) AS disk, round(var_pop(f), 6) AS variance FROM b WHERE bin IS NOT NULL GROUP BY 1")(lambda s, d: A.bulge_mass_fraction(galaxies(s, d), H))


def _share(top: str, bottom: str, name: str) -> str:
    return f"round(coalesce(sum(CASE WHEN ({top}) AND q THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN {bottom} THEN 1 ELSE 0 END), 0), 0), 6) AS {name}"


_MARKS = edges(9.5, 12, 0.1)
query(
    "QRY12",
    f"{GALAXIES_SQL}, b AS (SELECT {bin_sql(_logm('StellarMass'), _MARKS)} AS bin, (SfrDisk + SfrBulge) / (StellarMass * 1e10 / {H}e0) < 1e-11 AS q, Type = 0 AS c, {_logm('CentralMvir')} > 12.5 AS heavy FROM g WHERE StellarMass > 0) "
    f"SELECT CAST(k AS INT) AS bin, {_share('true', 'b.bin IS NOT NULL', 'all_q')}, {_share('c', 'c', 'central_q')}, {_share('NOT c', 'NOT c', 'satellite_q')}, {_share('NOT c AND NOT heavy', 'NOT c', 'light_q')}, {_share('NOT c AND heavy', 'NOT c', 'heavy_q')} FROM range({len(_MARKS) - 1}) t(k) LEFT JOIN b ON b.bin = k GROUP BY k",
)(lambda s, d: A.quiescent_fraction(galaxies(s, d), H))
_SB = "Type = 0 AND BulgeMass / StellarMass > 0.1 AND BulgeMass / StellarMass < 0.5"
query("QRY13", f"{GALAXIES_SQL} SELECT round(log10(Vmax), 6) AS log_v, round({_logm('StellarMass + ColdGas')}, 6) AS log_m FROM g WHERE {_SB}")(lambda s, d: A.baryonic_tully_fisher(galaxies(s, d), H, None))
query("QRY14", f"{GALAXIES_SQL} SELECT round({_logm('StellarMass')}, 6) AS log_m, round(ColdGas / (StellarMass + ColdGas), 6) AS f FROM g WHERE {_SB}")(lambda s, d: A.gas_fraction(galaxies(s, d), H, None))
query("QRY15", f"{GALAXIES_SQL} SELECT round({_logm('StellarMass')}, 6) AS log_m, round(log10(MetalsColdGas / ColdGas / 0.02e0) + 9, 6) AS z FROM g WHERE Type = 0 AND StellarMass > 0.01 AND ColdGas > 0 AND MetalsColdGas > 0 AND ColdGas / (StellarMass + ColdGas) > 0.05")(
    lambda s, d: A.metallicity_relation(galaxies(s, d), H, None, 0.05)
)
query("QRY16", f"{GALAXIES_SQL}, s AS (SELECT {_logm('StellarMass')} AS m, CASE WHEN SfrDisk + SfrBulge > 0 THEN log10((SfrDisk + SfrBulge) / (StellarMass * 1e10 / {H}e0)) ELSE -15e0 END AS s FROM g WHERE StellarMass > 0.01) SELECT round(m, 6) AS log_m, round(s, 6) AS ssfr, s > -11 AS forming FROM s")(lambda s, d: A.specific_sfr(galaxies(s, d), H, None))
query("QRY17", f"{GALAXIES_SQL} SELECT round({_logm('BulgeMass')}, 6) AS log_bulge, round({_logm('BlackHoleMass')}, 6) AS log_bh FROM g WHERE BulgeMass > 0.01 AND BlackHoleMass > 1e-5")(lambda s, d: A.black_hole_bulge(galaxies(s, d), H, None))
query("QRY18", f"{GALAXIES_SQL} SELECT round(log10(Mvir * 1e10), 6) AS log_m, {', '.join(f'round(log10(greatest({k} * 1e10, 1e0)), 6) AS {a}' for k, a in (('StellarMass', 'stars'), ('ColdGas', 'cold'), ('HotGas', 'hot'), ('EjectedMass', 'ejected'), ('ICS', 'ics')))} FROM g WHERE Type = 0 AND Mvir > 1 AND StellarMass > 0")(lambda s, d: A.mass_reservoirs(galaxies(s, d), None))
query("QRY21", f"{GALAXIES_SQL}, {SNAPS_SQL}, r AS (SELECT SnapNum, sum(SfrDisk + SfrBulge) / {VOLUME} * pow({H}e0, 3) AS rho FROM g GROUP BY 1) SELECT round(z, 6) AS z, round(log10(rho), 6) AS log_rho FROM r JOIN snaps ON snap = SnapNum WHERE rho > 0")(lambda s, d: A.sfr_density(galaxies(s, d), snaps(s), H, VOLUME))
query("QRY22", f"{GALAXIES_SQL}, {SNAPS_SQL}, r AS (SELECT SnapNum, sum(CASE WHEN StellarMass / {H}e0 > 0.01 AND StellarMass / {H}e0 < 1000 THEN StellarMass END) AS m FROM g GROUP BY 1) SELECT round(z, 6) AS z, round(log10(m * 1e10 / {H}e0 / ({VOLUME} / pow({H}e0, 3))), 6) AS log_rho FROM r JOIN snaps ON snap = SnapNum")(lambda s, d: A.stellar_mass_density(galaxies(s, d), snaps(s), H, VOLUME))


# --- quality ---------------------------------------------------------------------------------------------------------


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.schema import Property

    g = galaxies(spark, sf_dir).select("Mvir", "ColdGas", "deltaMvir")
    return quality.profile(g, {"Mvir": Property("Mvir", "float", valid=(1000.0, 90000.0)), "deltaMvir": Property("deltaMvir", "float", valid=(0.0, 1e9), sentinels=(0.0,))})


_Q = "SELECT '{0}' AS \"column\", CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, CAST(sum(CASE WHEN {0} = 0{2} THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, CAST(sum(CASE WHEN {1} THEN 1 ELSE 0 END) AS BIGINT) AS n_out FROM g"
query("QLT03", GALAXIES_SQL + " " + " UNION ALL ".join([_Q.format("Mvir", "Mvir < 1000 OR Mvir > 90000", ""), _Q.format("ColdGas", "false", ""), _Q.format("deltaMvir", "(deltaMvir < 0 OR deltaMvir > 1e9) AND deltaMvir <> 0", " AND false")]))(_quality)


@query("QLT05", "SELECT 'o_totalprice' AS \"column\", (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS n_different, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 1) AS n_missing")
def _qlt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    other = o.filter("o_orderkey % 50 <> 1").withColumn("o_totalprice", F.when(c("o_orderkey") % 10 == 0, c("o_totalprice") * 1.01).otherwise(c("o_totalprice") * (1 + 1e-9)))
    return quality.compare(o, other, ["o_orderkey"])


# --- physics over the galaxy view ------------------------------------------------------------------------------------

_STATE = ["Mvir", "deltaMvir", "Rvir", "Vvir", "Vmax", "dT", "StellarMass", "ColdGas", "HotGas", "MetalsColdGas", "MetalsHotGas", "EjectedMass", "MetalsEjectedMass", "ICS", "BulgeMass", "BlackHoleMass"]
_ZERO = ["MetalsICS", "TotalSatelliteBaryons", "Cooling", "Heating", "r_heat", "MetalsStellarMass", "MetalsBulgeMass", "DiskScaleRadius", "OutflowRate", "TestDummyProperty"]


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The galaxy view as the objects of groups."""
    g = galaxies(spark, sf_dir)
    spin = F.array(c("StellarMass") * 0.1, c("ColdGas"), c("ICS"))
    return g.select(
        F.lit(0).alias("file_nr"), F.lit(0).alias("tree_id"), c("CentralHaloIndex").alias("fof_root"), (c("ord") - 1).alias("group_ord"), *KEYS, "Type", spin.alias("Spin"), *[c(x).cast("float").alias(x) for x in _STATE], *[F.lit(0.0).cast("double" if x in ("Cooling", "Heating") else "float").alias(x) for x in _ZERO]
    )


def physics(name: str, module: Callable[[DataFrame, P.Context], DataFrame], shown: list[str], sql: str | None = None) -> None:
    query(name, sql, 3)(lambda s, d: module(objects(s, d), P.Context(cooling_tables=model_tables())).select(*KEYS, *shown))


def _f(expr: str) -> str:
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)"


_F32 = f"{GALAXIES_SQL}, f AS (SELECT CentralHaloIndex, ord, Type, {', '.join(f'CAST(CAST({x} AS FLOAT) AS DOUBLE) AS {x}' for x in _STATE)} FROM g)"
physics("PHY01", lambda df, x: P.infall(df, x, reionization=False), ["HotGas", "MetalsHotGas", "EjectedMass", "ICS", "TotalSatelliteBaryons"])
_SAFE = "CASE WHEN abs({1}) < 1e-10 THEN 0e0 ELSE {0} / CASE WHEN abs({1}) < 1e-10 THEN 1e0 ELSE {1} END END"
_UNITS = Cosmology().units
_X = f"{PROTON_MASS * BOLTZMANN!r} * temp / pow(10e0, log_rate) / {_UNITS.density_cgs * _UNITS.time_s!r}"
_COOL = (
    f"{_F32}, s1 AS (SELECT *, Type = 0 AND HotGas > 1e-10 AND Vvir > 1e-10 AS active, {_SAFE.format('Rvir', 'Vvir')} AS t, 35.9e0 * Vvir * Vvir AS temp, CASE WHEN dT > 1e-10 THEN dT ELSE 0e0 END AS step FROM f), "
    f"{rate_sql('log10(CASE WHEN active THEN temp ELSE 1e4 END)', 'CASE WHEN MetalsHotGas > 1e-10 THEN log10(CASE WHEN active AND MetalsHotGas > 1e-10 THEN MetalsHotGas / HotGas ELSE 1e0 END) ELSE -10e0 END', 's1')}, "
    f"s2 AS (SELECT *, {_X} AS x FROM rated), s3 AS (SELECT *, {_SAFE.format('HotGas', '(4 * pi() * Rvir)')} AS rho, ({_SAFE.format('x', 't')}) * 0.885e0 AS edge FROM s2), "
    f"s4 AS (SELECT *, CASE WHEN active THEN sqrt({_SAFE.format('rho', 'edge')}) ELSE 0e0 END AS reach FROM s3), "
    f"s5 AS (SELECT *, CASE WHEN reach > Rvir THEN HotGas * ({_SAFE.format('Vvir', 'Rvir')}) * step ELSE ({_SAFE.format('HotGas', 'Rvir')}) * ({_SAFE.format('reach', '(2 * t)')}) * step END AS flow FROM s4), "
    "s6 AS (SELECT *, CASE WHEN active THEN greatest(0e0, least(HotGas, flow)) ELSE 0e0 END AS cool FROM s5), s7 AS (SELECT *, CASE WHEN cool > 1e-10 THEN cool ELSE 0e0 END AS moved FROM s6) "
)


@query("PHY04", f"{_COOL}SELECT CentralHaloIndex, ord, round({_f('ColdGas + moved')}, 3) AS ColdGas, round({_f('HotGas - moved')}, 3) AS HotGas, round(log10(1 + 0.5e0 * moved * Vvir * Vvir), 3) AS cooled FROM s7", 3)
def _phy04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cooling without heating, its time step in code units."""
    return P.cooling(objects(spark, sf_dir), P.Context(cooling_tables=model_tables()), agn=0, dt_units="code").select(*KEYS, "ColdGas", "HotGas", F.log10(1 + c("Cooling")).alias("cooled"))


physics("PHY05", lambda df, x: P.cooling(df, x, agn=2, dt_units="code"), ["BlackHoleMass", "r_heat", "Heating"])
physics("PHY08", P.star_formation, ["StellarMass", "ColdGas", "HotGas", "EjectedMass", "OutflowRate"])
_BACK = "CASE WHEN Type = 0 AND EjectedMass > 1e-10 AND dT > 0 AND Vvir > 133.644e0 THEN least((Vvir / 133.644e0 - 1) * EjectedMass * (Vvir / Rvir) * dT, EjectedMass) ELSE 0 END"
physics("PHY12", lambda df, x: P.reincorporation(df, x, 0.3), ["EjectedMass", "HotGas"], f"{_F32}, b AS (SELECT *, {_BACK.replace('133.644e0', '(445.48e0 * 0.3e0)')} AS back FROM f) SELECT CentralHaloIndex, ord, round({_f('EjectedMass - back')}, 3) AS EjectedMass, round({_f('HotGas + back')}, 3) AS HotGas FROM b")
_DISK = (
    f"{_F32}, d AS (SELECT *, {_f('0.03e0 * Rvir')} AS rd, StellarMass - BulgeMass AS stars, ColdGas + StellarMass - BulgeMass AS mass FROM f), "
    f"m AS (SELECT *, greatest(({_SAFE.format('stars', 'mass')}) * (mass - least(Vmax * Vmax * 3 * rd / {_G!r}e0, mass)), 0e0) AS moved FROM d) "
    f"SELECT CentralHaloIndex, ord, round({_f('CASE WHEN moved > 0 AND BulgeMass + moved > StellarMass * 1.0001e0 THEN StellarMass ELSE BulgeMass + moved END')}, 3) AS BulgeMass, round(rd, 3) AS DiskScaleRadius FROM m"
)
physics("PHY13", P.disk_instability, ["BulgeMass", "DiskScaleRadius"], _DISK)
_DRAIN = (
    f"{_F32}, a AS (SELECT *, Type = 0 AND deltaMvir < 0 AND EjectedMass > 0 AS drains FROM f), "
    "b AS (SELECT *, CASE WHEN drains THEN greatest(EjectedMass + deltaMvir, 0e0) ELSE EjectedMass END AS ej, CASE WHEN Type <> 0 THEN 0e0 WHEN drains THEN least(EjectedMass + deltaMvir, 0e0) ELSE deltaMvir END AS falls FROM a) "
    f"SELECT CentralHaloIndex, ord, round({_f('ej')}, 3) AS EjectedMass, round({_f('greatest(HotGas + falls, 0e0)')}, 3) AS HotGas FROM b"
)
physics("PHY02", lambda df, x: P.add_infall(df, P.d("deltaMvir"), P.central()), ["EjectedMass", "HotGas"], _DRAIN)
_STRIP = (
    f"{_F32}, a AS (SELECT *, CASE WHEN Type = 1 THEN greatest((StellarMass + ColdGas + HotGas + EjectedMass + ICS - 0.01e0 * Mvir) / 10, 0e0) ELSE 0e0 END AS over FROM f), b AS (SELECT *, least(over, HotGas) AS gas FROM a), "
    "c AS (SELECT *, sum(gas) OVER (PARTITION BY CentralHaloIndex) AS everything FROM b) "
    f"SELECT CentralHaloIndex, ord, round({_f('HotGas + CASE WHEN Type = 0 THEN everything ELSE -gas END')}, 2) AS HotGas FROM c"
)


@query("PHY03", _STRIP, 2)
def _phy03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.strip_satellites(objects(spark, sf_dir), 0.01 * P.d("Mvir"), 10.0, F.lit(True)).select(*KEYS, "HotGas")


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Galaxies with a satellite of three tenths of their reservoirs each."""
    own = {f: c(f) if f in _STATE else F.lit(0.0) for f in M.FIELDS}
    a = F.struct(*[x.cast("double").alias(f) for f, x in own.items()])
    b = F.struct(*[(0.3 * x.cast("double")).alias(f) for f, x in own.items()])
    return objects(spark, sf_dir), a, b


def _after(name: str, rule: Callable[[Column, Column], Column], sql: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, a, b = _pairs(spark, sf_dir)
        return df.select(*KEYS, M.let(rule(a, b), lambda x: x).alias("_x")).select(*KEYS, *[c(f"_x.{k}").alias(k) for k in sql])

    query(name, f"{_F32} SELECT CentralHaloIndex, ord, {', '.join(f'round({v}, 4) AS {k}' for k, v in sql.items())} FROM f", 4)(run)


_after("PHY15", M.add_galaxies, {"ColdGas": "ColdGas + 0.3e0 * ColdGas", "StellarMass": "StellarMass + 0.3e0 * StellarMass", "BulgeMass": "BulgeMass + 0.3e0 * StellarMass", "BlackHoleMass": "BlackHoleMass + 0.3e0 * BlackHoleMass", "ICS": "ICS + 0.3e0 * ICS"})
_after("PHY16", lambda a, b: M.make_spheroid(a), {"BulgeMass": "StellarMass", "StellarMass": "StellarMass"})
_after("PHY21", M.disrupt, {"HotGas": "HotGas + 0.3e0 * ColdGas + 0.3e0 * HotGas", "ICS": "ICS + 0.3e0 * ICS + 0.3e0 * StellarMass", "EjectedMass": "EjectedMass + 0.3e0 * EjectedMass", "BlackHoleMass": "BlackHoleMass"})


@query("JON09", f"{GALAXIES_SQL} SELECT CentralHaloIndex, ord, CASE WHEN ord % 4 = 3 THEN 0 ELSE 0 END AS target FROM g WHERE ord > 1")
def _jon09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every satellite merges; each third of four names the one before it, which merges into the central."""
    o = objects(spark, sf_dir)
    events = o.filter("group_ord > 0").select(*P.GROUP, "group_ord", F.when(c("ord") % 4 == 3, c("group_ord") - 1).otherwise(F.lit(0)).alias("target"))
    return M.resolve_targets(o, events, P.GROUP).select(c("fof_root").alias("CentralHaloIndex"), (c("group_ord") + 1).alias("ord"), "target")


_SIMPLE = "ColdGas + CASE WHEN Type = 0 AND deltaMvir > 0 THEN 0.15e0 * deltaMvir ELSE 0 END"
physics("PHY22", P.simple_cooling, ["ColdGas"], f"{_F32} SELECT CentralHaloIndex, ord, round({_f(_SIMPLE)}, 3) AS ColdGas FROM f")
_STARS = "CASE WHEN Type = 0 AND ColdGas > 0 AND dT > 0 THEN least(0.02e0 * ColdGas * (Vvir / Rvir) * dT, ColdGas) ELSE 0 END"
physics("PHY23", P.simple_star_formation, ["ColdGas", "StellarMass"], f"{_F32}, s AS (SELECT *, {_STARS} AS s FROM f) SELECT CentralHaloIndex, ord, round({_f('ColdGas - s')}, 3) AS ColdGas, round({_f('StellarMass + s')}, 3) AS StellarMass FROM s")
physics("PHY24", lambda df, x: P.mark(df, x, 2.5), ["TestDummyProperty"], f"{_F32} SELECT CentralHaloIndex, ord, CASE WHEN Type = 0 THEN 2.5e0 ELSE 0e0 END AS TestDummyProperty FROM f")
_RATIO = "CASE WHEN greatest(ICS, ColdGas) < 1e-10 THEN 1e0 ELSE least(ICS, ColdGas) / greatest(ICS, ColdGas) END"
over_galaxies("PHY17", lambda: {"fed": P.black_hole_growth(P.merger_ratio(c("ICS"), c("ColdGas")), c("ColdGas"), c("Vvir"))}, {"fed": f"CASE WHEN ColdGas > 0 THEN least(0.01e0 * ({_RATIO}) / (1 + pow(280 / Vvir, 2)) * ColdGas, ColdGas) ELSE 0e0 END"})
over_galaxies("PHY18", lambda: dict(zip(("cold_goes", "all_goes"), P.quasar_wind(c("BlackHoleMass") * 1e3, c("ColdGas"), c("HotGas"), c("Vvir")), strict=True)), {"cold_goes": "!0.001e0 * 0.1e0 * (BlackHoleMass * 1e3) * pow(2997.92458e0, 2) > 0.5e0 * ColdGas * Vvir * Vvir", "all_goes": "!0.001e0 * 0.1e0 * (BlackHoleMass * 1e3) * pow(2997.92458e0, 2) > 0.5e0 * ColdGas * Vvir * Vvir + 0.5e0 * HotGas * Vvir * Vvir"})
over_galaxies("PHY19", lambda: {"stars": P.starburst(P.merger_ratio(c("ICS"), c("ColdGas")), c("ColdGas"))}, {"stars": f"greatest(0.56e0 * pow({_RATIO}, 0.7e0) * ColdGas, 0e0)"})
over_galaxies("PHY20", lambda: {"ratio": P.merger_ratio(c("ICS"), c("ColdGas"))}, {"ratio": _RATIO})
