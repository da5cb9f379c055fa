"""Catalogue queries: mass functions, occupations, relations, fractions, evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import galaxy as G
from canopy.functions.numeric import is_finite, safe_div
from canopy.operators.histogram import digitize, edges, fixed_histogram, ranged_histogram, volume_density

#: Target redshifts of evolution queries and how far the nearest snapshot may lie above each.
TARGETS = [(0.0, 0.2), (1.0, 0.5), (2.0, 0.5), (3.0, 0.5)]


def central() -> Column:
    return F.col("Type") == 0


def has_columns(df: DataFrame, names: list[str]) -> bool:
    """Whether a query can run: it is skipped where the schema lacks a column."""
    return set(names) <= set(df.columns)


def mass_function(df: DataFrame, mass: Column, where: Column, h: float, volume: float, margin: int, clamp: tuple[float, float] | None, width: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """(by, bin, center, n, phi) of log10 masses of the chosen rows."""
    return volume_density(ranged_histogram(df.filter(where), G.log_mass(mass, h), width, margin, clamp, by), volume, h, by)


def halo_mass_function(df: DataFrame, h: float, volume: float, by: list[str] | None = None) -> DataFrame:
    return mass_function(df, F.col("Mvir"), central() & (F.col("Mvir") > 0), h, volume, 1, (10.0, 16.0), by=by)


def stellar_mass_function(df: DataFrame, h: float, volume: float, by: list[str] | None = None) -> DataFrame:
    return mass_function(df, F.col("StellarMass"), central() & (F.col("StellarMass") > 0), h, volume, 1, (8.0, 12.5), by=by)


def cold_gas_function(df: DataFrame, h: float, volume: float) -> DataFrame:
    return mass_function(df, F.col("ColdGas"), central() & (F.col("ColdGas") > 0), h, volume, 1, (8.0, 12.5))


def baryonic_mass_function(df: DataFrame, h: float, volume: float) -> DataFrame:
    both = F.col("StellarMass") + F.col("ColdGas")
    return mass_function(df, both, both > 0, h, volume, 2, None)


def gas_mass_function(df: DataFrame, h: float, volume: float) -> DataFrame:
    return mass_function(df, F.col("ColdGas"), F.col("ColdGas") > 0, h, volume, 2, None)


def halo_occupation(df: DataFrame, h: float) -> DataFrame:
    """(bin, groups, mean_all, mean_satellites) of groups by the mass of their central, in 0.2 dex from 10."""
    groups = df.filter(F.col("CentralHaloIndex") >= 0).groupBy("CentralHaloIndex").agg(
        F.count("*").alias("n_all"), F.sum(F.when(~central(), 1).otherwise(0)).alias("n_sat"), F.max(F.when(central(), F.col("Mvir"))).alias("m")
    )
    binned = groups.filter("m > 0").withColumn("bin", digitize(G.log_mass(F.col("m"), h), edges(10, 15, 0.2)))
    return binned.filter("bin is not null").groupBy("bin").agg(F.count("*").alias("groups"), F.avg("n_all").alias("mean_all"), F.avg("n_sat").alias("mean_satellites"))


def spin_distribution(df: DataFrame) -> DataFrame:
    """52 bins of the spin parameter within (0, 1), with the curve of a log-normal of the same peak."""
    v, r, j = (G.norm(F.col(c)) for c in ("Vel", "Pos", "Spin"))
    rows = df.select(v.alias("v"), r.alias("r"), j.alias("j")).filter("v > 0 and r > 0 and j > 0").withColumn("x", F.col("j") / (1.414213562 * F.col("v") * F.col("r")))
    counts = fixed_histogram(rows.filter((F.col("x") > 0) & (F.col("x") < 1) & is_finite(F.col("x"))), F.col("x"), -0.02, 0.5, 52)
    peak = F.max("n").over(Window.partitionBy())  # 52 rows
    curve = F.when(F.col("center") > 0, G.log_normal(F.when(F.col("center") > 0, F.col("center")), 0.035, 0.5)).otherwise(0.0)
    top = F.max(curve).over(Window.partitionBy())
    return counts.withColumns({"curve": curve / top * peak})


def velocity_distribution(df: DataFrame, h: float) -> DataFrame:
    """(component, bin, center, density): line-of-sight and axis velocities over the Hubble constant, 160 bins of [-40, 40]."""
    rows = df.withColumn("_r", G.norm(F.col("Pos"))).filter("_r > 0")
    los = G.dot(F.col("Vel"), F.col("Pos")) / F.col("_r")
    axes = [F.element_at("Vel", i).cast("double") for i in (1, 2, 3)]
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), (x / (100 * h)).alias("x")) for n, x in zip(("los", "x", "y", "z"), [los, *axes], strict=True)])).alias("s")).select("s.*")
    total = stacked.groupBy("component").agg(F.count("*").alias("_all"))
    return fixed_histogram(stacked, F.col("x"), -40.0, 40.0, 160, ["component"]).join(F.broadcast(total), "component").select("component", "bin", "center", (F.col("n") / 0.5 / F.col("_all")).alias("density"))


def spatial_distribution(df: DataFrame, n: int | None = 10_000, seed: int = 0) -> DataFrame:
    """Positions of objects with mass, a seeded sample of at most n."""
    rows = df.filter("Mvir > 0").select(*[F.element_at("Pos", i).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])
    return _sample(rows, n, seed)


def baryon_fraction(df: DataFrame, h: float, least: int = 3, count_bulge: bool = True) -> DataFrame:
    """Mean baryonic components of groups over the central's mass, in 0.1 dex from 11; bins of fewer centrals are left out.

    Stars count the bulge on top of the stellar mass that holds it; ``count_bulge``
    False counts it once.
    """
    stars = F.col("StellarMass") + (F.col("BulgeMass") if count_bulge else F.lit(0.0))
    parts = {"stars": stars, **{k: F.col(c) for k, c in (("cold", "ColdGas"), ("hot", "HotGas"), ("ejected", "EjectedMass"), ("ics", "ICS"), ("bh", "BlackHoleMass"))}}
    sums = df.groupBy("CentralHaloIndex").agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    heads = df.filter(central() & (F.col("Mvir") > 0)).select("CentralHaloIndex", "Mvir", digitize(G.log_mass(F.col("Mvir"), h), edges(11, 16, 0.1)).alias("bin")).filter("bin is not null")
    rows = heads.join(sums, "CentralHaloIndex").withColumn("total", sum((F.col(k) for k in parts), F.lit(0.0)))
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), *[F.avg(F.col(k) / F.col("Mvir")).alias(f"f_{k}") for k in ("total", *parts)])
    return out.filter(F.col("n") >= least)


def bulge_mass_fraction(df: DataFrame, h: float) -> DataFrame:
    """Mean and population variance of the bulge share, in 0.2 dex of stellar mass from 8.4."""
    rows = df.filter("StellarMass > 0").select(digitize(G.log_mass(F.col("StellarMass"), h), edges(8.4, 12.2, 0.2)).alias("bin"), (F.col("BulgeMass") / F.col("StellarMass")).alias("f"))
    return rows.filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("f").alias("bulge"), F.avg(1 - F.col("f")).alias("disk"), F.var_pop("f").alias("variance"))


def quiescent_fraction(df: DataFrame, h: float, cut: float = 1e-11, split: float = 12.5) -> DataFrame:
    """Shares of objects that hardly form stars, by stellar mass: all, centrals, satellites, satellites of light and heavy groups; 0 in empty bins."""
    marks = edges(9.5, 12, 0.1)
    rate = (F.col("SfrDisk") + F.col("SfrBulge")) / (F.col("StellarMass") * 1e10 / h)
    rows = df.filter("StellarMass > 0").select(digitize(G.log_mass(F.col("StellarMass"), h), marks).alias("bin"), (rate < cut).alias("q"), central().alias("c"), (G.log_mass(F.col("CentralMvir"), h) > split).alias("heavy")).filter("bin is not null")

    def share(top: Column, bottom: Column) -> Column:
        return F.sum(F.when(top & F.col("q"), 1).otherwise(0)) / F.nullif(F.sum(F.when(bottom, 1).otherwise(0)), F.lit(0))

    c, s = F.col("c"), ~F.col("c")
    found = rows.groupBy("bin").agg(share(F.lit(True), F.lit(True)).alias("all_q"), share(c, c).alias("central_q"), share(s, s).alias("satellite_q"), share(s & ~F.col("heavy"), s).alias("light_q"), share(s & F.col("heavy"), s).alias("heavy_q"))
    spine = df.sparkSession.range(len(marks) - 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(found, "bin", "left").select("bin", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("all_q", "central_q", "satellite_q", "light_q", "heavy_q")])


def _sample(df: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """At most n rows, the first by a seeded hash of all their columns: the same ones however the rows are partitioned."""
    return df if n is None else df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def _spirals() -> Column:
    share = safe_div(F.col("BulgeMass"), F.col("StellarMass"))
    return central() & (F.col("StellarMass") > 0) & (share > 0.1) & (share < 0.5)


def baryonic_tully_fisher(df: DataFrame, h: float, n: int | None = 7500) -> DataFrame:
    rows = df.filter(_spirals() & (F.col("StellarMass") + F.col("ColdGas") > 0) & (F.col("Vmax") > 0))
    return _sample(rows, n).select(F.log10("Vmax").alias("log_v"), G.log_mass(F.col("StellarMass") + F.col("ColdGas"), h).alias("log_m"))


def gas_fraction(df: DataFrame, h: float, n: int | None = 7500) -> DataFrame:
    rows = df.filter(_spirals() & (F.col("StellarMass") + F.col("ColdGas") > 0))
    return _sample(rows, n).select(G.log_mass(F.col("StellarMass"), h).alias("log_m"), (F.col("ColdGas") / (F.col("StellarMass") + F.col("ColdGas"))).alias("f"))


def metallicity_relation(df: DataFrame, h: float, n: int | None = 7500, least: float = 0.1) -> DataFrame:
    rows = df.filter(central() & (F.col("StellarMass") > 0.01) & (F.col("ColdGas") > 0) & (F.col("MetalsColdGas") > 0)).filter(F.col("ColdGas") / (F.col("StellarMass") + F.col("ColdGas")) > least)
    return _sample(rows, n).select(G.log_mass(F.col("StellarMass"), h).alias("log_m"), G.log_metallicity(F.col("MetalsColdGas"), F.col("ColdGas")).alias("z"))


def specific_sfr(df: DataFrame, h: float, n: int | None = 7500, cut: float = -11.0) -> DataFrame:
    rate = G.specific_sfr(F.col("SfrDisk") + F.col("SfrBulge"), F.col("StellarMass"), h)
    return _sample(df.filter("StellarMass > 0.01"), n).select(G.log_mass(F.col("StellarMass"), h).alias("log_m"), rate.alias("ssfr"), (rate > cut).alias("forming"))


def black_hole_bulge(df: DataFrame, h: float, n: int | None = 7500) -> DataFrame:
    rows = df.filter((F.col("BulgeMass") > 0.01) & (F.col("BlackHoleMass") > 1e-5))
    return _sample(rows, n).select(G.log_mass(F.col("BulgeMass"), h).alias("log_bulge"), G.log_mass(F.col("BlackHoleMass"), h).alias("log_bh"))


def mass_reservoirs(df: DataFrame, n: int | None = 7500) -> DataFrame:
    rows = df.filter(central() & (F.col("Mvir") > 1) & (F.col("StellarMass") > 0))
    return _sample(rows, n).select(F.log10(F.col("Mvir") * 1e10).alias("log_m"), *[G.log_floor(F.col(c) * 1e10).alias(a) for c, a in (("StellarMass", "stars"), ("ColdGas", "cold"), ("HotGas", "hot"), ("EjectedMass", "ejected"), ("ICS", "ics"))])


def nearest_snapshots(snaps: DataFrame, targets: list[tuple[float, float]] = TARGETS) -> DataFrame:
    """(target, snap, z): for each target redshift the nearest snapshot at or above it, unless it lies too far off."""
    want = snaps.sparkSession.createDataFrame(targets, "target double, tolerance double")
    # A few targets against one row a snapshot.
    near = snaps.join(F.broadcast(want), F.col("z") >= F.col("target")).groupBy("target", "tolerance").agg(F.min(F.struct((F.col("z") - F.col("target")).alias("off"), "snap", "z")).alias("x"))
    return near.filter(F.col("x.off") <= F.col("tolerance")).select("target", "x.snap", "x.z")


def mass_function_evolution(df: DataFrame, snaps: DataFrame, h: float, volume: float, stellar: bool = False) -> DataFrame:
    """The mass function at each target redshift, in one aggregate over the chosen snapshots."""
    chosen = F.broadcast(nearest_snapshots(snaps).select("target", F.col("snap").alias("SnapNum")))
    rows = df.join(chosen, "SnapNum")
    return (stellar_mass_function if stellar else halo_mass_function)(rows, h, volume, ["target"])


def sfr_density(df: DataFrame, snaps: DataFrame, h: float, volume: float) -> DataFrame:
    rows = df.groupBy("SnapNum").agg((F.sum(F.col("SfrDisk") + F.col("SfrBulge")) / volume * h**3).alias("rho")).filter("rho > 0")
    return rows.join(F.broadcast(snaps.select(F.col("snap").alias("SnapNum"), "z")), "SnapNum").select("z", F.log10("rho").alias("log_rho")).orderBy("z")


def stellar_mass_density(df: DataFrame, snaps: DataFrame, h: float, volume: float) -> DataFrame:
    ok = (F.col("StellarMass") / h > 0.01) & (F.col("StellarMass") / h < 1000)
    rows = df.groupBy("SnapNum").agg(F.sum(F.when(ok, F.col("StellarMass"))).alias("m"))
    rho = F.when(F.col("m") > 0, F.log10(F.when(F.col("m") > 0, F.col("m") * 1e10 / h / (volume / h**3)))).otherwise(0.0)
    return rows.join(F.broadcast(snaps.select(F.col("snap").alias("SnapNum"), "z")), "SnapNum").select("z", rho.alias("log_rho")).orderBy("z")


def even_snapshots(snaps: DataFrame, most: int = 8, highest: float = 8.0) -> DataFrame:
    """At most ``most`` snapshots below a redshift, evenly spaced from the lowest redshift.

    The step is rounded down, so a step's multiples are never fewer than ``most``
    where there are as many snapshots: none is left to fill up.
    """
    order, every = Window.orderBy("z"), Window.partitionBy()  # one row a snapshot
    rows = snaps.filter(F.col("z") <= highest).withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("*").over(every)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return rows.filter((F.col("_k") % step == 0) & (F.col("_k") / step < most)).select("snap", "z")


def diverse_snapshots(snaps: DataFrame, between: int = 6) -> DataFrame:
    """The lowest and the highest redshift and some evenly spaced between."""
    order, every = Window.orderBy("z"), Window.partitionBy()
    rows = snaps.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("*").over(every)})
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - 2) / between))
    inner = (F.col("_k") > 0) & (F.col("_k") < F.col("_n") - 1) & ((F.col("_k") - 1) % step == 0) & ((F.col("_k") - 1) / step < between)
    return rows.filter((F.col("_k") == 0) | (F.col("_k") == F.col("_n") - 1) | inner).select("snap", "z")

