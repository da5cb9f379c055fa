"""From tracked objects to catalogue rows: ids, quantities of the current halo, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.schema import output_schema
from canopy.sources.catalogue import FILE_FACTOR, FILE_FACTOR_MANY, TREE_FACTOR, encode_index
from canopy.units import SEC_PER_MEGAYEAR, Cosmology

TREE = ["file_nr", "tree_id"]
_INFALL = ("infallMvir", "infallVvir", "infallVmax")


def time_in_myr(dt: Column, c: Cosmology) -> Column:
    """A time step in megayears; -1, which stands for no progenitor, stays."""
    return F.when(dt == -1.0, dt.cast("double")).otherwise(dt.cast("double") * (c.units.time_s / SEC_PER_MEGAYEAR))


def infall_values(kind: Column, value: Column) -> Column:
    """What an object had at infall; a central never fell in."""
    return F.when(kind != 0, value).otherwise(F.lit(0.0))


def host_properties(objects: DataFrame, halos: DataFrame) -> DataFrame:
    """objects (with halo_nr and fof_root) with what the catalogue takes from their halo and not from their own past.

    halos: raw halos with their virial mass, radius and velocity (forest.with_virial).
    Rvir and Vvir are the halo's now, not the largest so far; CentralMvir is the
    virial mass of the group's root.
    """
    own = halos.select(*TREE, "halo_nr", F.col("Spin").alias("_spin"), F.col("VelDisp").alias("_disp"), F.col("MostBoundID").alias("_bound"), F.col("r_halo").alias("_r"), F.col("v_halo").alias("_v"))
    root = halos.filter("is_root").select(*TREE, F.col("halo_nr").alias("fof_root"), F.col("m_halo").alias("_central"))
    out = objects.join(own, [*TREE, "halo_nr"]).join(root, [*TREE, "fof_root"], "left")
    new = {"Spin": "_spin", "VelDisp": "_disp", "SimulationHaloIndex": "_bound", "Rvir": "_r", "Vvir": "_v", "CentralMvir": "_central"}
    return out.withColumns({k: F.col(v) for k, v in new.items()}).drop(*new.values())


def checked_index(file_nr: Column, tree_id: Column, halo_nr: Column, last_file: int) -> Column:
    """encode_index, which fails where a part doesn't fit its digits."""
    trees = (FILE_FACTOR_MANY if last_file >= 10_000 else FILE_FACTOR) // TREE_FACTOR
    fits = (halo_nr >= 0) & (halo_nr < TREE_FACTOR) & (tree_id >= 0) & (tree_id < trees)
    return F.when(fits, encode_index(file_nr, tree_id, halo_nr, last_file)).otherwise(F.raise_error(F.lit("a halo or tree number is too large for the index")).cast("long"))


def output_order(objects: DataFrame) -> DataFrame:
    """objects with out_ord: the place among those of a tree and snapshot, in the order of groups, halos and objects."""
    order = Window.partitionBy(*TREE, "SnapNum").orderBy("fof_root", "group_ord")
    return objects.withColumn("out_ord", F.row_number().over(order) - 1)


def merger_targets(objects: DataFrame) -> DataFrame:
    """objects (output_order, all snapshots) with mergeIntoID: the place of the object merged into, in its snapshot's output; -1 without."""
    places = objects.select(*TREE, F.col("SnapNum").alias("mergeIntoSnapNum"), F.col("born").alias("mergeIntoBorn"), F.col("out_ord").alias("_place"))
    return objects.drop("mergeIntoID").join(places, [*TREE, "mergeIntoSnapNum", "mergeIntoBorn"], "left").withColumn("mergeIntoID", F.coalesce("_place", F.lit(-1))).drop("_place")


def catalogue_rows(objects: DataFrame, halos: DataFrame, cosmology: Cosmology | None = None, last_file: int = 0) -> DataFrame:
    """Evolved objects -> (file_nr, tree_id, out_ord) and the catalogue's columns, in their order and types."""
    c = cosmology or Cosmology()
    rows = host_properties(merger_targets(output_order(objects)), halos)
    made = {
        "HaloIndex": checked_index(F.col("file_nr"), F.col("tree_id"), F.col("halo_nr"), last_file),
        "CentralHaloIndex": checked_index(F.col("file_nr"), F.col("tree_id"), F.col("fof_root"), last_file),
        "ModelHaloIndex": F.col("halo_nr"),
        "ModelTreeIndex": F.col("tree_id"),
        "dT": time_in_myr(F.col("dT"), c),
        **{k: infall_values(F.col("Type"), F.col(k)) for k in _INFALL},
    }

    def column(f: T.StructField) -> Column:
        value = made.get(f.name, F.col(f.name))
        return (value if isinstance(f.dataType, T.ArrayType) else value.cast(f.dataType)).alias(f.name, metadata=f.metadata)

    return rows.select(*TREE, "out_ord", *map(column, output_schema().fields))
