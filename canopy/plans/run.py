"""A run of the model from its settings: trees, snapshots, modules, evolution, catalogue."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators import forest
from canopy.operators.output import catalogue_rows
from canopy.operators.physics import Context
from canopy.plans.modules import registered, running
from canopy.schema import output_schema
from canopy.sources import catalogue, files, hdf5
from canopy.sources.tables import RunConfig, parse_config, read_cooling_tables, read_scale_factors, snapshots
from canopy.sources.trees import read_tree_files, tree_numbers
from canopy.storage import scratch, store

FORMATS = ("binary", "parquet", "hdf5")


def context(config: RunConfig, cooling_tables: list[list[float]] | None = None, store_between: bool = False) -> Context:
    """What the modules may read.  Sections of modules that aren't enabled are left out, as they have no effect."""
    used = {registered()[m].section for m in config.modules if m in registered()}
    parameters = {k: v for k, v in config.parameters.items() if k in used}
    folder = parameters.get("SageCooling", {}).get("CoolFunctionsDir")
    tables = cooling_tables if cooling_tables is not None else read_cooling_tables(str(folder)) if folder else []
    return Context(cosmology=config.cosmology, parameters=parameters, cooling_tables=tables, store_between=store_between)


def unused_sections(config: RunConfig) -> list[str]:
    """Sections of parameters that no enabled module reads."""
    return sorted(set(config.parameters) - {registered()[m].section for m in config.modules if m in registered()})


def evolved_catalogue(halos: DataFrame, scale_factors: list[float], config: RunConfig, cooling_tables: list[list[float]] | None = None, store_between: bool = False) -> DataFrame:
    """Raw halos -> (file_nr, tree_id, out_ord) and the catalogue's columns, of all snapshots."""
    snaps = snapshots(halos.sparkSession, scale_factors, config.cosmology)
    with running(list(config.modules), context(config, cooling_tables, store_between)) as physics:
        objects = forest.evolve(halos, snaps, config.particle_mass, config.cosmology, physics if config.modules else None)
        virial = forest.with_virial(halos, snaps, config.particle_mass, config.cosmology)
        return catalogue_rows(objects, virial, config.cosmology, config.last_file)


def run_model(spark: SparkSession, config: RunConfig | str, cooling_tables: list[list[float]] | None = None, skip_existing: bool = False) -> DataFrame:
    """Runs the model and writes the catalogue of the output snapshots; returns its rows.

    config: settings, or the YAML text that has them.  Tree files that are missing
    are skipped, and with ``skip_existing`` those whose catalogue exists already;
    where none is left nothing is written.
    """
    config = parse_config(config) if isinstance(config, str) else config
    if config.output_format not in FORMATS:
        raise ValueError(f"unknown output format {config.output_format}")
    scale_factors = read_scale_factors(config.snapshot_list_file)[: config.last_snapshot + 1]
    redshift = {k: 1 / a - 1 for k, a in enumerate(scale_factors)}
    wanted = list(config.output_snapshots) or sorted(redshift)
    skip = [k for k in range(config.first_file, config.last_file + 1) if skip_existing and _written(config, wanted, redshift, k)]
    file_nrs = [k for k in range(config.first_file, config.last_file + 1) if k not in skip]
    halos = read_tree_files(spark, config.tree_type, config.input_directory, config.tree_name, file_nrs)
    if halos.isEmpty():
        return spark.createDataFrame([], T.StructType([T.StructField("file_nr", T.IntegerType()), T.StructField("tree_id", T.IntegerType()), T.StructField("out_ord", T.IntegerType()), *output_schema().fields]))
    with scratch(spark) as own:
        rows = own.keep(store(evolved_catalogue(halos, scale_factors, config, cooling_tables).filter(F.col("SnapNum").isin(wanted)), "catalogue"))
    trees = tree_numbers(config.tree_type, config.input_directory, config.tree_name, file_nrs)
    if config.output_format == "parquet":
        catalogue.write_catalogue(rows, f"{config.directory}/{config.name}", mode="append" if skip_existing else "overwrite")
    elif config.output_format == "binary":
        catalogue.write_binary(rows, config.directory, config.name, redshift, trees, wanted)
    else:
        properties = {k: v for k, v in asdict(config).items() if isinstance(v, (int, float, str))}
        hdf5.write_catalogue(rows, config.directory, config.name, wanted, trees, redshift, properties)
    catalogue.write_run_metadata(f"{config.directory}/metadata", asdict(config), scale_factors)
    return rows


def _written(config: RunConfig, snaps: list[int], redshift: dict[int, float], file_nr: int) -> bool:
    """Whether the catalogue of a tree file exists."""
    if config.output_format == "binary":
        return all(files.exists(catalogue.binary_name(config.directory, config.name, redshift[s], file_nr)) for s in snaps)
    if config.output_format == "hdf5":
        return files.exists(hdf5.file_name(config.directory, config.name, file_nr))
    return all(files.find(f"{config.directory}/{config.name}/snap_num={s}/file_nr={file_nr}/*.parquet") for s in snaps)
