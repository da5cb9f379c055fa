"""Small side tables and settings: snapshot lists, cooling tables, run parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

import yaml
from pyspark.sql import DataFrame, SparkSession

from canopy.functions.galaxy import LOG_T_ROWS
from canopy.sources import files
from canopy.units import Cosmology, Units, snapshot_table

# Names of the cooling tables, from primordial to super-solar.
COOLING_FILES = ["stripped_mzero.cie", "stripped_m-30.cie", "stripped_m-20.cie", "stripped_m-15.cie", "stripped_m-10.cie", "stripped_m-05.cie", "stripped_m-00.cie", "stripped_m+05.cie"]
#: Column of the normalised cooling rate.
RATE_COLUMN = 5


def read_scale_factors(path: str) -> list[float]:
    """One scale factor a line; line i belongs to snapshot i."""
    return [float(x) for x in files.read(path).decode().split()]


def snapshots(spark: SparkSession, scale_factors: list[float], cosmology: Cosmology | None = None) -> DataFrame:
    """(snap, a, z, age): one row a snapshot, so it may be broadcast."""
    return spark.createDataFrame(snapshot_table(scale_factors, cosmology), "snap int, a double, z double, age double")


def read_cooling_tables(folder: str) -> list[list[float]]:
    """Log rates on the temperature grid, one list a metallicity."""
    out = []
    for name in COOLING_FILES:
        numbers = [line.split() for line in files.read(f"{folder}/{name}").decode().splitlines() if line.strip()]
        out.append([float(n[RATE_COLUMN]) for n in numbers[:LOG_T_ROWS]])
        if len(out[-1]) != LOG_T_ROWS:
            raise ValueError(f"{name}: {LOG_T_ROWS} rows expected")
    return out


@dataclass(frozen=True)
class RunConfig:
    """A run's settings, validated."""

    name: str
    directory: str
    output_snapshots: tuple[int, ...]
    output_format: str
    first_file: int
    last_file: int
    tree_name: str
    tree_type: str
    input_directory: str
    snapshot_list_file: str
    last_snapshot: int
    box_size: float
    particle_mass: float
    cosmology: Cosmology
    modules: tuple[str, ...] = ()
    parameters: dict[str, dict[str, float | int | str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        problems = [
            (self.output_format not in ("binary", "hdf5", "parquet"), f"unknown output format {self.output_format}"),
            (self.tree_type not in ("lhalo_binary", "genesis_lhalo_hdf5"), f"unknown tree type {self.tree_type}"),
            (self.first_file > self.last_file, "first_file lies after last_file"),
            (not 0 < self.cosmology.hubble_h <= 2, "hubble_h out of range"),
            (self.box_size <= 0 or self.particle_mass <= 0, "box_size and particle_mass must be positive"),
            (any(not 0 <= s <= self.last_snapshot for s in self.output_snapshots), "an output snapshot lies outside the simulation"),
            (len(self.modules) > 32 or len(set(self.modules)) != len(self.modules), "modules must be distinct and 32 at most"),
        ]
        for bad, what in problems:
            if bad:
                raise ValueError(what)


def parse_config(text: str) -> RunConfig:
    """A YAML document with sections output, input, simulation, units and modules."""
    doc = yaml.safe_load(text)
    missing = {"output", "input", "simulation", "units"} - set(doc or {})
    if missing:
        raise ValueError(f"sections missing: {sorted(missing)}")
    out, src, sim, unit = doc["output"], doc["input"], doc["simulation"], doc["units"]
    modules = doc.get("modules") or {}
    snaps = tuple(int(s) for s in out.get("snapshot_list", []))
    if out.get("snapshot_count") not in (None, -1, len(snaps)):
        raise ValueError("snapshot_count and snapshot_list differ")
    cosmos = sim["cosmology"]
    units = Units(float(unit["length_in_cm"]), float(unit["mass_in_g"]), float(unit["velocity_in_cm_per_s"]))
    return RunConfig(
        out["file_base_name"], out["directory"], snaps, out.get("format", "binary"), int(src["first_file"]), int(src["last_file"]), src["tree_name"], src["tree_type"],
        src["simulation_dir"], src["snapshot_list_file"], int(src["last_snapshot"]), float(sim["box_size"]), float(sim["particle_mass"]),
        Cosmology(float(cosmos["omega_matter"]), float(cosmos["omega_lambda"]), float(cosmos["hubble_h"]), units), tuple(modules.get("enabled") or ()), modules.get("parameters") or {},
    )


def parse_key_values(text: str) -> dict[str, str | list[int]]:
    """The older key/value form: comments after %, # or ;, and a list of snapshots after ->."""
    out: dict[str, str | list[int]] = {}
    for line in text.splitlines():
        line = re.split(r"[%#;]", line, maxsplit=1)[0].strip()
        if line.startswith("->"):
            out["snapshots"] = [int(x) for x in line[2:].split()]
        elif line:
            key, _, value = line.partition(" ")
            out[key] = value.strip()
    return out


def module_order(requires: dict[str, set[str]]) -> list[str]:
    """Modules so that each comes after those it needs; a cycle or an unknown module is an error."""
    unknown = set().union(*requires.values(), set()) - set(requires)
    if unknown:
        raise ValueError(f"unknown modules: {sorted(unknown)}; there are {sorted(requires)}")
    try:
        return list(TopologicalSorter({k: sorted(v) for k, v in sorted(requires.items())}).static_order())
    except CycleError as e:
        raise ValueError(f"modules need each other: {e.args[1]}") from e
