"""Physics modules: each maps the objects of all groups of a snapshot to the same objects, changed.

A group is (file_nr, tree_id, fof_root); its central has Type 0.  Modules are
column expressions and window sums.  Only the central's reservoirs depend on the
order of objects: they are folded over the group's ordered events.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import galaxy as G
from canopy.functions.numeric import SMALL, safe_div
from canopy.units import BOLTZMANN, PROTON_MASS, SEC_PER_YEAR, SOLAR_MASS, Cosmology

GROUP = ["file_nr", "tree_id", "fof_root"]
_STORED_DOUBLE = {"Cooling", "Heating"}


@dataclass(frozen=True)
class Context:
    """What a module may read: the epoch, the cosmology, its parameters, the cooling tables."""

    redshift: float = 0.0
    cosmology: Cosmology = field(default_factory=Cosmology)
    parameters: dict[str, dict] = field(default_factory=dict)
    cooling_tables: list[list[float]] = field(default_factory=list)
    #: Whether objects are stored after each module, which keeps plans short.
    store_between: bool = False


def set_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Assigns stored properties, all from the row as it was, narrowed to their types."""
    return df.withColumns({k: v.cast("double" if k in _STORED_DOUBLE else "float") for k, v in new.items()})


def d(name: str) -> Column:
    return F.col(name).cast("double")


def group() -> Window:
    return Window.partitionBy(*GROUP)


def central() -> Column:
    return F.col("Type") == 0


def infall(df: DataFrame, ctx: Context, fraction: float = 0.17, reionization: bool = True, z0: float = 8.0, zr: float = 7.0, steps: float = 10.0, form: str = "reference") -> DataFrame:
    """Baryons that the group lacks fall to the central's hot gas; ejected gas and stellar halo of satellites move there; excess of Type 1 objects is stripped."""
    ion = G.Reionization(z0, zr, form=form)
    scale = F.lit(ion.scale_mass(ctx.redshift, ctx.cosmology))

    def modifier() -> Column:
        return ion.modifier(d("Mvir"), scale) if reionization else F.lit(1.0)

    def total(c: str) -> Column:
        return F.sum(d(c)).over(group())

    own = {c: total(c) for c in ("StellarMass", "ColdGas", "HotGas", "EjectedMass", "MetalsEjectedMass", "ICS", "MetalsICS")}
    falling = modifier() * fraction * d("Mvir") - (own["StellarMass"] + own["ColdGas"] + own["HotGas"] + own["EjectedMass"] + own["ICS"])
    satellites = F.sum(F.when(~central(), d("StellarMass") + d("ColdGas") + d("HotGas")).otherwise(0.0)).over(group())
    # A group without a central stays as it is.
    led = F.max(central()).over(group())
    df = df.withColumns({"_fall": falling, "_sats": satellites, "_ej": F.greatest(own["EjectedMass"], F.lit(0.0)), "_ics": F.greatest(own["ICS"], F.lit(0.0)), "_zej": own["MetalsEjectedMass"], "_zics": own["MetalsICS"], "_led": led})
    gathered = {
        "EjectedMass": F.col("_ej"), "ICS": F.col("_ics"), "TotalSatelliteBaryons": F.col("_sats"),
        "MetalsEjectedMass": F.greatest(F.lit(0.0), F.least(F.col("_zej"), F.col("_ej"))), "MetalsICS": F.greatest(F.lit(0.0), F.least(F.col("_zics"), F.col("_ics"))),
    }
    zero = {"EjectedMass", "ICS", "MetalsEjectedMass", "MetalsICS"}
    df = set_columns(df, {c: F.when(central(), v).when(F.col("_led") & F.lit(c in zero), F.lit(0.0)).otherwise(F.col(c)) for c, v in gathered.items()})
    df = add_infall(df, F.when(central(), F.col("_fall")).otherwise(F.lit(0.0)), central())
    return strip_satellites(df, modifier() * fraction * d("Mvir"), steps, F.col("_led")).drop("_fall", "_sats", "_ej", "_ics", "_zej", "_zics", "_led")


def strip_satellites(df: DataFrame, share: Column, steps: float, where: Column) -> DataFrame:
    """What a Type 1 object holds beyond its share of baryons goes to the central's hot gas a step at a time; sums over the group commute."""
    excess = (d("StellarMass") + d("ColdGas") + d("HotGas") + d("EjectedMass") + d("ICS") - share) / steps
    taken = F.when(where & (F.col("Type") == 1) & (excess > 0), excess).otherwise(0.0)
    z = G.metallicity(d("HotGas"), d("MetalsHotGas"))
    df = df.withColumns({"_gas": F.least(taken, d("HotGas")), "_metals": F.least(taken * z, d("MetalsHotGas"))})
    df = df.withColumns({"_all_gas": F.sum("_gas").over(group()), "_all_metals": F.sum("_metals").over(group())})
    df = set_columns(df, {"HotGas": d("HotGas") + F.when(central(), F.col("_all_gas")).otherwise(-F.col("_gas")), "MetalsHotGas": d("MetalsHotGas") + F.when(central(), F.col("_all_metals")).otherwise(-F.col("_metals"))})
    return df.drop("_gas", "_metals", "_all_gas", "_all_metals")


def add_infall(df: DataFrame, falling: Column, where: Column) -> DataFrame:
    """Adds infall to hot gas; a negative one first drains the ejected gas, then the hot gas, with their metals."""
    df = df.withColumn("_in", falling)
    drains = where & (F.col("_in") < 0) & (d("EjectedMass") > 0)
    left = d("EjectedMass") + F.col("_in")
    z = G.metallicity(d("EjectedMass"), d("MetalsEjectedMass"))
    df = df.withColumns({"_ej2": F.when(drains, F.greatest(left, F.lit(0.0))).otherwise(d("EjectedMass")), "_zej2": F.when(drains & (left < 0), F.lit(0.0)).when(drains, F.greatest(d("MetalsEjectedMass") + F.col("_in") * z, F.lit(0.0))).otherwise(d("MetalsEjectedMass")), "_in": F.when(drains, F.least(left, F.lit(0.0))).otherwise(F.col("_in"))})
    z = G.metallicity(d("HotGas"), d("MetalsHotGas"))
    metals = F.when(where & (F.col("_in") < 0) & (d("MetalsHotGas") > 0), F.greatest(d("MetalsHotGas") + F.col("_in") * z, F.lit(0.0))).otherwise(d("MetalsHotGas"))
    hot = d("HotGas") + F.when(where, F.col("_in")).otherwise(0.0)
    df = set_columns(df, {"EjectedMass": F.col("_ej2"), "MetalsEjectedMass": F.col("_zej2"), "MetalsHotGas": F.when(hot < 0, 0.0).otherwise(metals), "HotGas": F.greatest(hot, F.lit(0.0))})
    return df.drop("_in", "_ej2", "_zej2")


def cooling(df: DataFrame, ctx: Context, efficiency: float = 0.01, agn: int = 1, dt_units: str = "reference") -> DataFrame:
    """Hot gas of centrals cools within the cooling radius, less what the central black hole heats.

    ``dt_units`` 'reference' divides the time step, already in code units, by the
    unit of time in megayears; 'code' takes it as it is.
    """
    u, h = ctx.cosmology.units, ctx.cosmology.hubble_h
    scale = 1 / u.time_myr if dt_units == "reference" else 1.0
    dt = F.when(d("dT") > SMALL, d("dT") * scale).otherwise(0.0)
    hot, vvir, rvir = d("HotGas"), d("Vvir"), d("Rvir")
    active = central() & (hot > SMALL) & (vvir > SMALL)
    t = safe_div(rvir, vvir)
    temperature = 35.9 * vvir * vvir
    log_z = F.when(d("MetalsHotGas") > SMALL, F.log10(F.when(active & (d("MetalsHotGas") > SMALL), d("MetalsHotGas") / hot).otherwise(1.0))).otherwise(-10.0)
    rate = G.cooling_rate(F.log10(F.when(active, temperature).otherwise(1e4)), log_z, ctx.cooling_tables)
    df = df.withColumns({"_dt": dt, "_active": active, "_x": PROTON_MASS * BOLTZMANN * temperature / rate / (u.density_cgs * u.time_s), "_t": t})
    inner = F.sqrt(safe_div(safe_div(hot, 4 * math.pi * rvir), safe_div(F.col("_x"), F.col("_t")) * 0.885))
    df = df.withColumn("_rcool", F.when(F.col("_active"), inner).otherwise(0.0))
    free = hot * safe_div(vvir, rvir) * F.col("_dt")
    slow = safe_div(hot, rvir) * safe_div(F.col("_rcool"), 2 * F.col("_t")) * F.col("_dt")
    flow = F.when(F.col("_rcool") > rvir, free).otherwise(slow)
    df = df.withColumn("_cool", F.when(F.col("_active"), F.greatest(F.lit(0.0), F.least(hot, flow))).otherwise(0.0))
    if agn:
        df = _heat(df, ctx, efficiency, agn, u, h)
    flow = F.least(F.col("_cool"), d("HotGas"))
    flow = F.when(F.col("_cool") > SMALL, flow).otherwise(0.0)
    z = G.metallicity(d("HotGas"), d("MetalsHotGas"))
    df = df.withColumns({"_flow": flow, "_zflow": flow * z})
    df = set_columns(df, {"HotGas": d("HotGas") - F.col("_flow"), "ColdGas": d("ColdGas") + F.col("_flow"), "MetalsHotGas": d("MetalsHotGas") - F.col("_zflow"), "MetalsColdGas": d("MetalsColdGas") + F.col("_zflow"), "Cooling": d("Cooling") + 0.5 * F.col("_flow") * d("Vvir") * d("Vvir")})
    return df.drop("_dt", "_active", "_x", "_t", "_rcool", "_cool", "_flow", "_zflow")


def _heat(df: DataFrame, ctx: Context, efficiency: float, mode: int, u: object, h: float) -> DataFrame:
    """Radio-mode heating: suppresses cooling inside the heating radius, feeds the black hole, moves the radius out."""
    on = F.col("_cool") > SMALL
    hot, vvir, mvir, bh = d("HotGas"), d("Vvir"), d("Mvir"), d("BlackHoleMass")
    kept = F.when(d("r_heat") < F.col("_rcool"), (1 - safe_div(d("r_heat"), F.col("_rcool"))) * F.col("_cool")).otherwise(0.0)
    df = df.withColumn("_left", F.when(on, kept).otherwise(F.col("_cool")))
    if mode == 1:
        unit = u.mass_g / u.time_s * SEC_PER_YEAR / SOLAR_MASS
        base = efficiency / unit * (bh / 0.01) * F.pow(vvir / 200.0, F.lit(3.0))
        rate = F.when(mvir > SMALL, base * (safe_div(hot, mvir) / 0.1)).otherwise(base)
    elif mode == 2:
        rate = (2.5 * math.pi * u.gravity) * (0.375 * 0.6 * F.col("_x")) * bh * efficiency
    elif mode == 3:
        rate = F.when(bh > 1e-4 * mvir * F.pow(safe_div(F.col("_rcool"), d("Rvir")), F.lit(3.0)), 1e-4 * safe_div(F.col("_left"), F.col("_dt"))).otherwise(0.0)
    else:
        raise ValueError(f"unknown AGN recipe {mode}")
    limit = 1.3e38 * bh * 1e10 / h / (u.energy_cgs / u.time_s) / (0.1 * 9e20)
    strength = F.pow(safe_div(F.lit(1.34e5), vvir, 1.0), F.lit(2.0))
    fed = F.least(F.least(rate, limit) * F.col("_dt"), hot)
    df = df.withColumns({"_strength": strength, "_fed": F.when(on & (hot > SMALL), fed).otherwise(0.0)})
    over = F.col("_strength") * F.col("_fed") > F.col("_left")
    df = df.withColumns({"_heat": F.least(F.col("_strength") * F.col("_fed"), F.col("_left")), "_fed": F.when(over, safe_div(F.col("_left"), F.col("_strength"))).otherwise(F.col("_fed"))})
    moved = safe_div(F.col("_heat"), F.col("_left")) * F.col("_rcool")
    z = G.metallicity(hot, d("MetalsHotGas"))
    radius = F.when(on & (d("r_heat") < F.col("_rcool")) & (F.col("_left") > SMALL), F.greatest(d("r_heat"), moved)).otherwise(d("r_heat"))
    df = set_columns(df, {"BlackHoleMass": bh + F.col("_fed"), "MetalsHotGas": d("MetalsHotGas") - z * F.col("_fed"), "HotGas": hot - F.col("_fed"), "r_heat": radius, "Heating": d("Heating") + F.when(F.col("_heat") > SMALL, 0.5 * F.col("_heat") * vvir * vvir).otherwise(0.0)})
    return df.withColumn("_cool", F.col("_left")).drop("_left", "_strength", "_fed", "_heat")


def star_formation(df: DataFrame, ctx: Context, efficiency: float = 0.02, supernovae: bool = True, reheating: float = 3.0, ejection: float = 0.3, energy: float = 1.0, eta: float = 0.5, recycled: float = 0.43, metal_yield: float = 0.03, leave: float = 0.3, prescription: int = 0, instability: bool = False) -> DataFrame:
    """Cold gas above a threshold forms stars; supernovae reheat gas to the central's hot gas and eject some of that.

    An object's own gas and stars depend on no other object.  The central's
    reservoirs take every object's share in the group's order, since what can be
    ejected is capped by the hot gas at that moment: they are a fold over events,
    one for each group, whose rows meet in one array.  ``Spin`` is the halo's spin
    vector.  A group without a central stays as it is.
    """
    lead = {c: F.max(F.when(central(), d(c))).over(group()) for c in ("Vvir", "Mvir")}
    df = df.withColumns({"_cv": lead["Vvir"], "_cm": lead["Mvir"]})
    df = set_columns(df, {"DiskScaleRadius": F.when(F.col("_cv").isNotNull(), G.disk_radius(G.norm(F.col("Spin")), d("Vvir"), d("Rvir"))).otherwise(d("DiskScaleRadius"))})
    reach = 3.0 * d("DiskScaleRadius")
    threshold = 0.19 * d("Vvir") * reach
    cold, dt = d("ColdGas"), d("dT")
    rate = F.when(cold > threshold, efficiency * safe_div(cold - threshold, safe_div(reach, d("Vvir")))).otherwise(0.0)
    stars = F.when((dt > 0) & F.col("_cv").isNotNull(), F.greatest(rate * dt, F.lit(0.0))).otherwise(0.0)
    df = df.withColumns({"_stars": stars, "_heat": stars * (reheating if supernovae else 0.0)})
    scale = F.when(F.col("_stars") + F.col("_heat") > cold, safe_div(cold, F.col("_stars") + F.col("_heat"), 1.0)).otherwise(1.0)
    df = df.withColumns({"_stars": F.col("_stars") * scale, "_heat": F.col("_heat") * scale})
    out = (ejection * safe_div(F.lit(eta * energy), F.col("_cv") * F.col("_cv")) - reheating) * F.col("_stars") if supernovae else F.lit(0.0)
    kept = (1 - recycled) * F.col("_stars")
    z = G.metallicity(cold, d("MetalsColdGas"))
    df = df.withColumns({"_out": F.greatest(out, F.lit(0.0)), "_kept": kept, "_z": z})
    df = df.withColumns({"_cold1": cold - F.col("_kept"), "_zcold1": d("MetalsColdGas") - F.col("_z") * F.col("_kept")})
    df = df.withColumn("_z2", G.metallicity(F.col("_cold1"), F.col("_zcold1")))
    df = df.withColumns({"_cold2": F.col("_cold1") - F.col("_heat"), "_zcold2": F.col("_zcold1") - F.col("_z2") * F.col("_heat"), "_leave": leave * F.exp(-F.coalesce("_cm", F.lit(0.0)) / 30.0)})
    disk = F.col("_cold2") > 1e-8
    made = metal_yield * F.col("_stars")
    event = F.struct("group_ord", F.col("_heat").alias("gas"), (F.col("_z2") * F.col("_heat")).alias("metals"), F.col("_out").alias("out"), F.when(disk, made * F.col("_leave")).otherwise(made).alias("yields"))
    start = F.struct(d("HotGas").alias("hot"), d("MetalsHotGas").alias("zhot"), d("EjectedMass").alias("out"), d("MetalsEjectedMass").alias("zout"))

    def take(a: Column, e: Column) -> Column:
        hot, zhot = a["hot"] + e["gas"], a["zhot"] + e["metals"]
        gone = F.least(e["out"], hot)
        zgone = G.metallicity(hot, zhot) * gone
        return F.struct((hot - gone).alias("hot"), (zhot - zgone + e["yields"]).alias("zhot"), (a["out"] + gone).alias("out"), (a["zout"] + zgone).alias("zout"))

    # One row a group, whose events are sorted and folded once; then the group's rows again.
    whole = df.groupBy(*GROUP).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"), F.array_sort(F.collect_list(F.when(F.col("_stars") > 0, event))).alias("_events"), F.max(F.when(central(), start)).alias("_start"))
    after = F.when(F.col("_start").isNotNull(), F.aggregate("_events", F.col("_start"), take))
    df = whole.select("_rows", after.alias("_led")).select(F.explode("_rows").alias("_row"), "_led").select("_row.*", "_led")
    df = df.withColumn("_after", F.when(central(), F.col("_led")).otherwise(start)).drop("_led")
    df = set_columns(df, {
        "ColdGas": F.col("_cold2"), "MetalsColdGas": F.col("_zcold2") + F.when(disk, made * (1 - F.col("_leave"))).otherwise(0.0),
        "StellarMass": d("StellarMass") + F.col("_kept"), "MetalsStellarMass": d("MetalsStellarMass") + F.col("_z") * F.col("_kept"), "OutflowRate": d("OutflowRate") + F.col("_heat"),
        "HotGas": F.col("_after.hot"), "MetalsHotGas": F.col("_after.zhot"), "EjectedMass": F.col("_after.out"), "MetalsEjectedMass": F.col("_after.zout"),
    })
    return df.drop("_cv", "_cm", "_stars", "_heat", "_out", "_kept", "_z", "_cold1", "_zcold1", "_z2", "_cold2", "_zcold2", "_leave", "_after")


def reincorporation(df: DataFrame, ctx: Context, factor: float = 1.0) -> DataFrame:
    """Ejected gas of centrals returns to the hot gas above a critical velocity."""
    critical = 445.48 * factor
    ok = central() & (d("EjectedMass") > SMALL) & (d("dT") > 0) & (d("Vvir") > critical)
    back = F.least((d("Vvir") / critical - 1) * d("EjectedMass") * safe_div(d("Vvir"), d("Rvir")) * d("dT"), d("EjectedMass"))
    df = df.withColumn("_back", F.when(ok, back).otherwise(0.0)).withColumn("_zback", F.col("_back") * G.metallicity(d("EjectedMass"), d("MetalsEjectedMass")))
    return set_columns(df, {"EjectedMass": d("EjectedMass") - F.col("_back"), "MetalsEjectedMass": d("MetalsEjectedMass") - F.col("_zback"), "HotGas": d("HotGas") + F.col("_back"), "MetalsHotGas": d("MetalsHotGas") + F.col("_zback")}).drop("_back", "_zback")


def disk_instability(df: DataFrame, ctx: Context, factor: float = 3.0, enabled: bool = True) -> DataFrame:
    """Stars of a disk heavier than its rotation supports move to the bulge."""
    if not enabled:
        return df
    df = set_columns(df, {"DiskScaleRadius": F.when(d("DiskScaleRadius") <= 0, 0.03 * d("Rvir")).otherwise(d("DiskScaleRadius"))})
    stars = d("StellarMass") - d("BulgeMass")
    mass = d("ColdGas") + stars
    stable = F.least(safe_div(d("Vmax") * d("Vmax") * factor * d("DiskScaleRadius"), F.lit(ctx.cosmology.units.gravity)), mass)
    moved = F.greatest(safe_div(stars, mass) * (mass - stable), F.lit(0.0))
    z = G.metallicity(stars, d("MetalsStellarMass") - d("MetalsBulgeMass"))
    df = df.withColumns({"_moved": moved, "_zmoved": moved * z})
    new, znew = d("BulgeMass") + F.col("_moved"), d("MetalsBulgeMass") + F.col("_zmoved")
    bulge = F.when((F.col("_moved") > 0) & (new > d("StellarMass") * 1.0001), d("StellarMass")).otherwise(new)
    zbulge = F.when((F.col("_moved") > 0) & (znew > d("MetalsStellarMass") * 1.0001), d("MetalsStellarMass")).otherwise(znew)
    return set_columns(df, {"BulgeMass": bulge, "MetalsBulgeMass": zbulge}).drop("_moved", "_zmoved")


def black_hole_growth(ratio: Column, cold: Column, vvir: Column, rate: float = 0.01) -> Column:
    """Cold gas that a merger of this mass ratio feeds to the black hole."""
    return F.when(cold > 0, F.least(rate * ratio / (1 + F.pow(safe_div(F.lit(280.0), vvir, 1e10), F.lit(2.0))) * cold, cold)).otherwise(0.0)


def quasar_wind(fed: Column, cold: Column, hot: Column, vvir: Column, efficiency: float = 0.001) -> tuple[Column, Column]:
    """Whether a quasar's energy unbinds the cold gas, and the hot gas too."""
    energy = efficiency * 0.1 * fed * (2.99792458e5 / 100.0) ** 2
    of_cold, of_hot = 0.5 * cold * vvir * vvir, 0.5 * hot * vvir * vvir
    return energy > of_cold, energy > of_cold + of_hot


def starburst(ratio: Column, cold: Column) -> Column:
    """Stars that a merger of this mass ratio makes of the cold gas."""
    return F.greatest(0.56 * F.pow(ratio, F.lit(0.7)) * cold, F.lit(0.0))


def merger_ratio(a: Column, b: Column) -> Column:
    """Minor over major baryonic mass; 1 where both vanish."""
    return safe_div(F.least(a, b), F.greatest(a, b), 1.0)


def simple_cooling(df: DataFrame, ctx: Context, fraction: float = 0.15) -> DataFrame:
    """A share of a central's mass growth becomes cold gas."""
    return set_columns(df, {"ColdGas": d("ColdGas") + F.when(central() & (d("deltaMvir") > 0), fraction * d("deltaMvir")).otherwise(0.0)})


def simple_star_formation(df: DataFrame, ctx: Context, efficiency: float = 0.02) -> DataFrame:
    """Cold gas of centrals turns to stars on the dynamical time."""
    ok = central() & (d("ColdGas") > 0) & (d("dT") > 0)
    stars = F.when(ok, F.least(efficiency * d("ColdGas") * F.when(d("Rvir") > 0, d("Vvir") / F.when(d("Rvir") > 0, d("Rvir")).otherwise(1.0)).otherwise(0.0) * d("dT"), d("ColdGas"))).otherwise(0.0)
    df = df.withColumn("_stars", stars)
    return set_columns(df, {"ColdGas": d("ColdGas") - F.col("_stars"), "StellarMass": d("StellarMass") + F.col("_stars")}).drop("_stars")


def mergers(df: DataFrame, ctx: Context, **parameters: float) -> DataFrame:
    """Nothing triggers a merger in the default model: its parameters are read and checked, its rules are in operators.mergers."""
    return df


def mark(df: DataFrame, ctx: Context, value: float = 1.0) -> DataFrame:
    """Sets a test property of centrals."""
    return set_columns(df, {"TestDummyProperty": F.when(central(), F.lit(value)).otherwise(F.col("TestDummyProperty"))})
