"""Evolving tracked objects through a merger forest, snapshot by snapshot.

A group is evolved once all progenitors of its members are done.  Progenitors
lie at earlier snapshots, so ascending snapshots are such an order, and all
trees of a snapshot advance in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import galaxy as G
from canopy.functions.numeric import SMALL
from canopy.schema import GALAXY
from canopy.storage import store
from canopy.units import Cosmology

TREE = ["file_nr", "tree_id"]
#: What physics does to the objects of one snapshot, of this redshift.
Pipeline = Callable[[DataFrame, float], DataFrame]
_GALAXY = [*[p.name for p in GALAXY], "TotalSatelliteBaryons", "TestDummyProperty"]


def link(halos: DataFrame) -> DataFrame:
    """halos with chain_ord (place among its descendant's progenitors) and fof_ord (place in its group).

    Both follow linked lists within a tree, so a tree is one group here, as it is
    one unit of the input.  Links that leave the tree, cycles, descendants that
    are not later and groups across snapshots are errors.
    """

    def follow(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("halo_nr", ignore_index=True)
        chain, place = [-1] * len(tree), [-1] * len(tree)
        heads = (("FirstProgenitor", "NextProgenitor", chain), ("FirstHaloInFOFgroup", "NextHaloInFOFgroup", place))
        for first, following, out in heads:
            nxt = tree[following].to_numpy()
            for start in sorted({int(x) for x in tree[first] if x >= 0}):
                at, k = start, 0
                while at >= 0:
                    if at >= len(tree) or out[at] >= 0:
                        raise ValueError(f"broken list of {first} at halo {at}")
                    out[at], at, k = k, int(nxt[at]), k + 1
        snap, desc = tree["SnapNum"].to_numpy(), tree["Descendant"].to_numpy()
        ok = desc >= 0
        if (snap[desc[ok]] <= snap[ok]).any() or (snap[tree["FirstHaloInFOFgroup"].to_numpy()] != snap).any():
            raise ValueError("a descendant is not later, or a group spans snapshots")
        return pd.DataFrame({"file_nr": tree["file_nr"], "tree_id": tree["tree_id"], "halo_nr": tree["halo_nr"], "chain_ord": chain, "fof_ord": place})

    keys = [*TREE, "halo_nr"]
    need = halos.select(*keys, "Descendant", "FirstProgenitor", "NextProgenitor", "FirstHaloInFOFgroup", "NextHaloInFOFgroup", "SnapNum")
    order = need.groupBy(*TREE).applyInPandas(follow, "file_nr int, tree_id int, halo_nr int, chain_ord int, fof_ord int")
    return halos.join(order, keys)


def first_occupied(objects: DataFrame, target: str = "Descendant") -> DataFrame:
    """objects (with prog, chain_ord, prog_len) and the progenitor that hands its objects' identity to the target.

    The first progenitor wins where it holds objects; else the occupied one with
    the most particles, the earlier of equals.
    """
    best = Window.partitionBy(*TREE, target).orderBy(F.when(F.col("chain_ord") == 0, 0).otherwise(1), F.col("prog_len").desc(), "chain_ord")
    return objects.withColumn("winner", F.first("prog").over(best))


def with_virial(halos: DataFrame, snaps: DataFrame, particle_mass: float, c: Cosmology) -> DataFrame:
    """halos with is_root and the virial mass, radius and velocity of each."""
    z = F.col("z")
    h2 = c.units.hubble**2 * (c.omega * (1 + z) ** 3 + (1 - c.omega - c.omega_lambda) * (1 + z) ** 2 + c.omega_lambda)
    rho = 3 * h2 / (8 * 3.141592653589793 * c.units.gravity)
    root = F.col("FirstHaloInFOFgroup") == F.col("halo_nr")
    mass = G.virial_mass(root, F.col("Mvir"), F.col("Len"), particle_mass)
    out = halos.join(F.broadcast(snaps.select(F.col("snap").alias("SnapNum"), "z", "age")), "SnapNum")
    out = out.withColumn("is_root", root).withColumn("m_halo", mass.cast("float"))
    out = out.withColumn("r_halo", G.virial_radius(F.col("m_halo").cast("double"), rho).cast("float"))
    return out.withColumn("v_halo", G.virial_velocity(F.col("m_halo").cast("double"), F.col("r_halo").cast("double"), c.units.gravity).cast("float"))


def inherit(objects: DataFrame, halos: DataFrame) -> DataFrame:
    """Objects of the progenitors, moved to their descendants among halos (one snapshot).

    Central and satellite objects of the winning progenitor follow the halo; those
    of others become orphans; orphans stay as they are.  Merged objects go.
    """
    here = halos.select(
        *TREE, F.col("halo_nr").alias("Descendant"), "is_root", "m_halo", "r_halo", "v_halo", "fof_ord", F.col("FirstHaloInFOFgroup").alias("fof_root"), F.col("age").alias("age_now"), F.col("SnapNum").alias("snap_now"),
        *[F.col(c).alias(f"h_{c}") for c in ("MostBoundID", "Pos", "Vel", "Len", "Vmax", "Spin")],
    )
    o = first_occupied(objects).join(here, [*TREE, "Descendant"])
    o = o.filter(~((F.col("Type") < 2) & (F.col("MergeStatus") != 0)))
    own = (F.col("Type") < 2) & (F.col("prog") == F.col("winner"))
    lost = (F.col("Type") < 2) & (F.col("prog") != F.col("winner"))
    grown = F.col("m_halo").cast("double") > F.col("Mvir").cast("double") + SMALL
    falls = (own & ~F.col("is_root") & (F.col("Type") == 0)) | (lost & ((F.col("MergTime") > 999.0) | (F.col("Type") == 0)))

    def pick(condition: Column, new: Column, old: str) -> Column:
        return F.when(condition, new).otherwise(F.col(old))

    return o.select(
        *TREE, F.col("Descendant").alias("halo_nr"), "fof_root", "fof_ord", "chain_ord", "object_ord",
        F.col("snap_now").alias("SnapNum"), F.when(own & F.col("is_root"), 0).when(own, 1).when(lost, 2).otherwise(F.col("Type")).alias("Type"),
        *[pick(own, F.col(f"h_{c}"), c).alias(c) for c in ("MostBoundID", "Pos", "Vel", "Len", "Vmax")],
        F.when(own, F.col("m_halo") - F.col("Mvir")).when(lost, -F.col("Mvir")).otherwise(F.col("deltaMvir")).cast("float").alias("deltaMvir"),
        F.when(own, F.col("m_halo")).when(lost, F.lit(0.0)).otherwise(F.col("Mvir")).cast("float").alias("Mvir"),
        pick(own & grown, F.col("r_halo"), "Rvir").alias("Rvir"), pick(own & grown, F.col("v_halo"), "Vvir").alias("Vvir"),
        F.when(own, F.lit(999.9)).when(falls, F.lit(0.0)).otherwise(F.col("MergTime")).cast("float").alias("MergTime"),
        pick(falls, F.col("Mvir"), "infallMvir").alias("infallMvir"), pick(falls, F.col("Vvir"), "infallVvir").alias("infallVvir"), pick(falls, F.col("Vmax"), "infallVmax").alias("infallVmax"),
        (F.col("age_prog") - F.col("age_now")).cast("float").alias("dT"), "MergeStatus", "mergeType", "mergeIntoID", "mergeIntoSnapNum", *_GALAXY,
        F.col("h_Spin").alias("Spin"), "born", "mergeIntoBorn", F.col("SnapNum").alias("prev_snap"),
    )


def create(halos: DataFrame, inherited: DataFrame) -> DataFrame:
    """A fresh object for each group root that inherits none; ``born``, its first halo, tells it from all others of the tree."""
    held = inherited.select(*TREE, "halo_nr").distinct()
    new = halos.filter("is_root").join(held, [*TREE, "halo_nr"], "left_anti")

    def real(x: float) -> Column:
        return F.lit(x).cast("float")

    zeros = [F.lit(0.0).cast("double" if c in ("Cooling", "Heating") else "float").alias(c) for c in _GALAXY]
    return new.select(
        *TREE, "halo_nr", F.col("FirstHaloInFOFgroup").alias("fof_root"), "fof_ord", F.lit(0).alias("chain_ord"), F.lit(0).alias("object_ord"),
        "SnapNum", F.lit(0).alias("Type"), "MostBoundID", "Pos", "Vel", "Len", "Vmax", real(0.0).alias("deltaMvir"), F.col("m_halo").alias("Mvir"),
        F.col("r_halo").alias("Rvir"), F.col("v_halo").alias("Vvir"), real(999.9).alias("MergTime"),
        *[real(-1.0).alias(c) for c in ("infallMvir", "infallVvir", "infallVmax")], real(-1.0).alias("dT"),
        F.lit(0).alias("MergeStatus"), F.lit(0).alias("mergeType"), F.lit(-1).alias("mergeIntoID"), F.lit(-1).alias("mergeIntoSnapNum"), *zeros,
        "Spin", F.col("halo_nr").alias("born"), F.lit(-1).alias("mergeIntoBorn"), F.lit(-1).alias("prev_snap"),
    )


def advance(objects: DataFrame, halos: DataFrame, pipeline: Pipeline | None = None, redshift: float = 0.0) -> DataFrame:
    """One snapshot: inherit, create, number within halo and group, run the physics.  Merged objects keep their rows here."""
    moved = inherit(objects, halos)
    both = moved.unionByName(create(halos, moved))
    in_halo = Window.partitionBy(*TREE, "halo_nr").orderBy("chain_ord", "object_ord")
    in_group = Window.partitionBy(*TREE, "fof_root").orderBy("fof_ord", "chain_ord", "object_ord")
    centrals = F.sum(F.when((F.col("Type") == 0) & (F.col("halo_nr") == F.col("fof_root")), 1).otherwise(0)).over(Window.partitionBy(*TREE, "fof_root"))
    both = both.withColumns({"group_ord": F.row_number().over(in_group) - 1, "_next_ord": F.row_number().over(in_halo) - 1, "_centrals": centrals})
    both = both.filter(F.when(F.col("_centrals") == 1, True).otherwise(F.raise_error(F.lit("a group needs one central object")).cast("boolean")))
    both = both.drop("object_ord", "_centrals").withColumnRenamed("_next_ord", "object_ord")
    return pipeline(both, redshift) if pipeline else both


def write_back(objects: DataFrame, events: DataFrame) -> DataFrame:
    """objects of all snapshots, with what became of those that merged later noted in their last row.

    events: rows of merged objects as physics left them, with prev_snap, the
    snapshot where the object was stored last.
    """
    marks = ["MergeStatus", "mergeType", "mergeIntoBorn", "mergeIntoSnapNum"]
    known = events.select(*TREE, "born", F.col("prev_snap").alias("SnapNum"), *[F.col(c).alias(f"_{c}") for c in marks])
    out = objects.join(known, [*TREE, "born", "SnapNum"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in marks})
    return out.select(objects.columns)


def evolve(halos: DataFrame, snaps: DataFrame, particle_mass: float, cosmology: Cosmology | None = None, pipeline: Pipeline | None = None) -> DataFrame:
    """All objects of all snapshots.

    Each snapshot's objects are stored, which keeps plans short and survives lost
    executors; a snapshot reads only those stored ones that hold progenitors of
    its halos.  Objects that merged are dropped where that happens, and noted in
    their last row.
    """
    spark = halos.sparkSession
    halos = store(with_virial(link(halos), snaps, particle_mass, cosmology or Cosmology()), "halos")
    step = halos.select(*TREE, F.col("halo_nr").alias("prog"), "Descendant", "chain_ord", F.col("Len").alias("prog_len"), F.col("age").alias("age_prog"), F.col("SnapNum").alias("prog_snap"))
    later = halos.select(*TREE, F.col("halo_nr").alias("Descendant"), F.col("SnapNum").alias("desc_snap"))
    step = store(step.filter("Descendant >= 0").join(later, [*TREE, "Descendant"]), "steps")
    # One row a snapshot, and one a pair of snapshots: at most hundreds, and some thousands.
    redshifts = {r["SnapNum"]: r["z"] for r in halos.groupBy("SnapNum").agg(F.max("z").alias("z")).collect()}
    sources: dict[int, list[int]] = {}
    for r in step.select("prog_snap", "desc_snap").distinct().collect():
        sources.setdefault(r["desc_snap"], []).append(r["prog_snap"])
    if not redshifts:
        raise ValueError("there are no halos")
    done: dict[int, DataFrame] = {}
    seed = create(halos, halos.select(*TREE, "halo_nr").limit(0)).limit(0).withColumn("group_ord", F.lit(0))
    for snap in sorted(redshifts):
        here = halos.filter(F.col("SnapNum") == snap)
        moving = step.filter(F.col("desc_snap") == snap).drop("desc_snap", "prog_snap")
        # Progenitors may lie several snapshots back; each has one descendant.
        stored = [done[s].filter("MergeStatus = 0") for s in sorted(sources.get(snap, ()))]
        held = reduce(DataFrame.unionByName, stored) if stored else seed
        objects = held.drop("chain_ord", "fof_root", "fof_ord").withColumnRenamed("halo_nr", "prog").join(moving, [*TREE, "prog"])
        done[snap] = store(advance(objects, here, pipeline, redshifts[snap]), f"snapshot{snap}")
    first = next(iter(done.values()))
    everything = spark.read.schema(first.schema).parquet(*[x._stored_at for x in done.values()])
    events = everything.filter("MergeStatus > 0")
    kept = everything.filter("MergeStatus = 0")
    return kept if events.isEmpty() else write_back(kept, events)
