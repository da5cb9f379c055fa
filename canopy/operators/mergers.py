"""Mergers of galaxies: what happens to two galaxies' reservoirs, as functions of structs, and events folded over a group.

A galaxy is a struct of its reservoirs (``galaxy``).  Each rule takes and returns
structs, with intermediate results bound once, so rules compose without their
expressions growing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import galaxy as G
from canopy.functions.numeric import safe_div
from canopy.operators import physics as P

# The speed of light in km/s, the unit of velocity of the wind's energy in km/s, and what kinds of mergers are called.
LIGHT_KM_S, WIND_VELOCITY_UNIT = 2.99792458e5, 100.0
MINOR, MAJOR, DISRUPTED = 1, 2, 4

#: Reservoirs with metals of their own.
GASES = ["ColdGas", "HotGas", "EjectedMass", "StellarMass", "ICS", "BulgeMass"]
METALS = {g: f"Metals{g.removesuffix('Gas') + 'Gas' if g.endswith('Gas') else g}" for g in GASES}
OTHERS = ["BlackHoleMass", "QuasarModeBHaccretionMass", "TimeOfLastMajorMerger", "TimeOfLastMinorMerger", "OutflowRate"]
FIELDS = [*GASES, *METALS.values(), *OTHERS]


@dataclass(frozen=True)
class MergerConfig:
    """Parameters of mergers."""

    growth: float = 0.01
    wind: float = 0.001
    major: float = 0.3
    recycled: float = 0.43
    metal_yield: float = 0.03
    leave: float = 0.3
    reheating: float = 3.0
    ejection: float = 0.3
    agn: bool = True
    supernovae: bool = True
    eta: float = 8e-3
    energy: float = 1.0


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def galaxy(prefix: str = "") -> Column:
    """The struct of a row's reservoirs."""
    return F.struct(*[F.col(prefix + c).cast("double").alias(c) for c in FIELDS])


def changed(g: Column, **new: Column) -> Column:
    """g with some reservoirs replaced."""
    return F.struct(*[new.get(c, g[c]).alias(c) for c in FIELDS])


def add_galaxies(central: Column, satellite: Column) -> Column:
    """All reservoirs of the satellite go to the central; its stars to the central's bulge too."""
    both = {c: central[c] + satellite[c] for g in ("ColdGas", "HotGas", "EjectedMass", "StellarMass", "ICS") for c in (g, METALS[g])}
    both |= {"BlackHoleMass": central["BlackHoleMass"] + satellite["BlackHoleMass"], "BulgeMass": central["BulgeMass"] + satellite["StellarMass"], "MetalsBulgeMass": central["MetalsBulgeMass"] + satellite["MetalsStellarMass"]}
    return changed(central, **both)


def make_spheroid(g: Column) -> Column:
    """All stars become bulge."""
    return changed(g, BulgeMass=g["StellarMass"], MetalsBulgeMass=g["MetalsStellarMass"])


def feed_black_hole(g: Column, ratio: Column, vvir: Column, c: MergerConfig) -> Column:
    """Cold gas, with its metals, goes to the black hole."""

    def feed(fed: Column) -> Column:
        z = G.metallicity(g["ColdGas"], g["MetalsColdGas"])
        return changed(g, BlackHoleMass=g["BlackHoleMass"] + fed, ColdGas=g["ColdGas"] - fed, MetalsColdGas=g["MetalsColdGas"] - z * fed, QuasarModeBHaccretionMass=g["QuasarModeBHaccretionMass"] + fed)

    return let(P.black_hole_growth(ratio, g["ColdGas"], vvir, c.growth), feed)


def blow_wind(g: Column, fed: Column, vvir: Column, c: MergerConfig) -> Column:
    """A quasar that ate ``fed`` ejects the cold gas, and the hot gas too, where its energy unbinds them."""
    energy = c.wind * 0.1 * fed * (LIGHT_KM_S / WIND_VELOCITY_UNIT) ** 2
    cold, hot = (0.5 * g[x] * vvir * vvir for x in ("ColdGas", "HotGas"))
    no = F.lit(0.0)

    def blow(gone: Column) -> Column:
        lost = {x: F.when(gone[k], g[x]).otherwise(no) for k, x in ((0, "ColdGas"), (1, "HotGas"))}
        metals = {x: F.when(gone[k], g[METALS[x]]).otherwise(no) for k, x in ((0, "ColdGas"), (1, "HotGas"))}
        new = {x: F.when(gone[k], no).otherwise(g[x]) for k, x in ((0, "ColdGas"), (1, "HotGas"))}
        new |= {METALS[x]: F.when(gone[k], no).otherwise(g[METALS[x]]) for k, x in ((0, "ColdGas"), (1, "HotGas"))}
        return changed(g, EjectedMass=g["EjectedMass"] + lost["ColdGas"] + lost["HotGas"], MetalsEjectedMass=g["MetalsEjectedMass"] + metals["ColdGas"] + metals["HotGas"], **new)

    return let(F.array(energy > cold, energy > cold + hot), blow)


def burst(g: Column, ratio: Column, vvir: Column, mvir: Column, c: MergerConfig) -> Column:
    """A starburst of the cold gas: stars to the bulge, gas reheated and ejected, new metals."""
    stars = P.starburst(ratio, g["ColdGas"])
    heated = c.reheating * stars if c.supernovae else F.lit(0.0)
    out = (c.ejection * safe_div(F.lit(c.eta * c.energy), vvir * vvir) - c.reheating) if c.supernovae else F.lit(0.0)

    def form(s: Column) -> Column:
        kept = (1 - c.recycled) * s["stars"]
        z = G.metallicity(g["ColdGas"], g["MetalsColdGas"])
        new = changed(
            g, ColdGas=g["ColdGas"] - kept, MetalsColdGas=g["MetalsColdGas"] - z * kept, StellarMass=g["StellarMass"] + kept, MetalsStellarMass=g["MetalsStellarMass"] + z * kept,
            BulgeMass=g["BulgeMass"] + kept, MetalsBulgeMass=g["MetalsBulgeMass"] + z * kept, OutflowRate=g["OutflowRate"] + s["heated"],
        )
        return let(new, lambda x: feedback(x, s))

    def feedback(x: Column, s: Column) -> Column:
        z = G.metallicity(x["ColdGas"], x["MetalsColdGas"])
        warm = changed(x, ColdGas=x["ColdGas"] - s["heated"], MetalsColdGas=x["MetalsColdGas"] - z * s["heated"], HotGas=x["HotGas"] + s["heated"], MetalsHotGas=x["MetalsHotGas"] + z * s["heated"])
        return let(warm, lambda w: eject(w, s))

    def eject(w: Column, s: Column) -> Column:
        gone = F.least(F.greatest(out * s["stars"], F.lit(0.0)), w["HotGas"])
        z = G.metallicity(w["HotGas"], w["MetalsHotGas"])
        made, stays = c.metal_yield * s["stars"], (w["ColdGas"] > 1e-8) & (ratio < c.major)
        leave = c.leave * F.exp(-mvir / 30.0)
        return changed(
            w, HotGas=w["HotGas"] - gone, EjectedMass=w["EjectedMass"] + gone, MetalsEjectedMass=w["MetalsEjectedMass"] + z * gone,
            MetalsColdGas=w["MetalsColdGas"] + F.when(stays, made * (1 - leave)).otherwise(0.0), MetalsHotGas=w["MetalsHotGas"] - z * gone + F.when(stays, made * leave).otherwise(made),
        )

    def limited(s: Column) -> Column:
        scale = F.when(s["stars"] + s["heated"] > g["ColdGas"], safe_div(g["ColdGas"], s["stars"] + s["heated"], 1.0)).otherwise(1.0)
        return let(F.struct((s["stars"] * scale).alias("stars"), (s["heated"] * scale).alias("heated")), form)

    return let(F.struct(stars.alias("stars"), heated.alias("heated")), limited)


def merge(central: Column, satellite: Column, vvir: Column, mvir: Column, time: Column, c: MergerConfig) -> Column:
    """(galaxy, kind): the central after the satellite has merged into it, and whether that was a minor or a major merger."""

    def baryons(g: Column) -> Column:
        return g["StellarMass"] + g["ColdGas"]

    def quasar(ratio: Column) -> Column:
        def grown(both: Column) -> Column:
            if not c.agn:
                return let(both, lambda g: starburst(g, ratio))
            fed = let(feed_black_hole(both, ratio, vvir, c), lambda g: blow_wind(g, g["BlackHoleMass"] - both["BlackHoleMass"], vvir, c))
            return let(fed, lambda g: starburst(g, ratio))

        return let(add_galaxies(central, satellite), grown)

    def starburst(g: Column, ratio: Column) -> Column:
        return let(burst(g, ratio, vvir, mvir, c), lambda x: finish(x, ratio))

    def finish(g: Column, ratio: Column) -> Column:
        def stamp(x: Column) -> Column:
            times = {"TimeOfLastMinorMerger": F.when(ratio > 0.1, time).otherwise(x["TimeOfLastMinorMerger"]), "TimeOfLastMajorMerger": F.when(ratio > c.major, time).otherwise(x["TimeOfLastMajorMerger"])}
            return changed(x, **times)

        after = F.when(ratio > c.major, stamp(make_spheroid(g))).otherwise(stamp(g))
        return F.struct(after.alias("galaxy"), F.when(ratio > c.major, MAJOR).otherwise(MINOR).alias("kind"))

    return let(P.merger_ratio(baryons(central), baryons(satellite)), quasar)


def disrupt(central: Column, satellite: Column) -> Column:
    """The satellite's gas becomes the central's hot gas, its stars intracluster stars; its black hole is lost."""
    new = {
        "HotGas": central["HotGas"] + satellite["ColdGas"] + satellite["HotGas"],
        "MetalsHotGas": central["MetalsHotGas"] + satellite["MetalsColdGas"] + satellite["MetalsHotGas"],
        "EjectedMass": central["EjectedMass"] + satellite["EjectedMass"],
        "MetalsEjectedMass": central["MetalsEjectedMass"] + satellite["MetalsEjectedMass"],
        "ICS": central["ICS"] + satellite["ICS"] + satellite["StellarMass"],
        "MetalsICS": central["MetalsICS"] + satellite["MetalsICS"] + satellite["MetalsStellarMass"],
    }
    return changed(central, **new)


def resolve_targets(objects: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """events (key, group_ord, target) with targets that stay: one that merges or is disrupted itself passes on to its own target.

    Two steps, as the target's target is looked up once; a target that goes twice over is an error.
    """
    going = events.select(*key, F.col("group_ord").alias("target"), F.col("target").alias("_next"))
    once = events.join(going, [*key, "target"], "left").withColumn("target", F.coalesce("_next", "target")).drop("_next")
    left = once.join(going, [*key, "target"], "left").withColumn("_bad", F.when(F.col("_next").isNotNull(), F.raise_error(F.lit("a merger target merges away twice over")).cast("int")))
    return left.filter(F.col("_bad").isNull()).drop("_next", "_bad").join(objects.select(*key, F.col("group_ord").alias("target")), [*key, "target"], "left_semi")


def apply_events(objects: DataFrame, events: DataFrame, time: float, config: MergerConfig | None = None) -> DataFrame:
    """objects (one snapshot) after events (file_nr, tree_id, fof_root, group_ord, target, disrupts), in the order of group_ord.

    The targets' reservoirs are folded over their events.  Who merged is marked:
    MergeStatus 1, mergeType, mergeIntoBorn and mergeIntoSnapNum, and keeps its row
    for the step that stores the snapshot.
    """
    c, key = config or MergerConfig(), P.GROUP
    final = resolve_targets(objects, events, key)
    taken = objects.select(*key, "group_ord", galaxy().alias("_sat"), "born").join(final, [*key, "group_ord"])
    target = objects.select(*key, F.col("group_ord").alias("target"), galaxy().alias("_start"), P.d("Vvir").alias("_v"), P.d("Mvir").alias("_m"), F.col("born").alias("_into"))
    lists = taken.groupBy(*key, "target").agg(F.array_sort(F.collect_list(F.struct("group_ord", "disrupts", "_sat"))).alias("_events")).join(target, [*key, "target"])

    def step(state: Column, e: Column) -> Column:
        def merged(x: Column) -> Column:
            return F.struct(x["galaxy"].alias("galaxy"), F.array_append(state["kinds"], x["kind"]).alias("kinds"))

        gone = F.struct(disrupt(state["galaxy"], e["_sat"]).alias("galaxy"), F.array_append(state["kinds"], F.lit(DISRUPTED)).alias("kinds"))
        joined = let(merge(state["galaxy"], e["_sat"], F.col("_v"), F.col("_m"), F.lit(float(time)), c), merged)
        return F.when(e["disrupts"], gone).otherwise(joined)

    start = F.struct(F.col("_start").alias("galaxy"), F.array().cast("array<int>").alias("kinds"))
    folded = lists.select(*key, "target", "_into", F.aggregate("_events", start, step).alias("_end"), F.transform("_events", lambda e: e["group_ord"]).alias("_who"))
    new = folded.select(*key, F.col("target").alias("group_ord"), F.col("_end.galaxy").alias("_new"))
    marks = folded.select(*key, "_into", F.explode(F.arrays_zip(F.col("_who").alias("w"), F.col("_end.kinds").alias("k"))).alias("_x")).select(*key, F.col("_x.w").alias("group_ord"), F.col("_x.k").alias("_kind"), "_into")
    out = objects.join(new, [*key, "group_ord"], "left").join(marks, [*key, "group_ord"], "left")
    kinds = {f.name: f.dataType for f in objects.schema.fields}
    values = {f: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)).cast(kinds[f]) for f in FIELDS}
    values |= {
        "MergeStatus": F.when(F.col("_kind").isNotNull(), 1).otherwise(F.col("MergeStatus")),
        "mergeType": F.coalesce("_kind", "mergeType"),
        "mergeIntoBorn": F.coalesce("_into", "mergeIntoBorn"),
        "mergeIntoSnapNum": F.when(F.col("_kind").isNotNull(), F.col("SnapNum")).otherwise(F.col("mergeIntoSnapNum")),
    }
    return out.withColumns(values).select(objects.columns)
