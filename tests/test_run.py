"""Whole runs: from tree files and settings to catalogues, and hierarchical files through a stand-in for their library."""

import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import forest, physics
from canopy.operators.mergers import apply_events
from canopy.operators.output import catalogue_rows
from canopy.plans import run
from canopy.plans.modules import _REGISTRY, Module, Parameter, pipeline, register, running
from canopy.plans.registry import model_tables
from canopy.schema import TREE, numpy_record, output_record, output_schema
from canopy.sources import catalogue, files, hdf5
from canopy.sources.tables import parse_config, snapshots
from canopy.sources.trees import read_trees, write_tree_file
from canopy.units import SEC_PER_MEGAYEAR, Cosmology

from test_forest import A_LIST, CONFIG, M1, halo

C = Cosmology()


def spun(tree):
    return [h | {"Spin": (0.01 * i, 0.02, 0.03), "VelDisp": 10.0 + i, "Pos": (i, 1, 2), "Vel": (3, 4, i)} for i, h in enumerate(tree)]


def settings(tmp_path, modules="", form="binary", snaps="[3, 4, 5]"):
    (tmp_path / "a_list").write_text("".join(f"{a}\n" for a in A_LIST))
    return f"""
output: {{file_base_name: model, directory: {tmp_path}/out, format: {form}, snapshot_list: {snaps}}}
input: {{first_file: 0, last_file: 2, tree_name: trees, tree_type: lhalo_binary, simulation_dir: {tmp_path}, snapshot_list_file: {tmp_path}/a_list, last_snapshot: 5}}
simulation: {{cosmology: {{omega_matter: 0.25, omega_lambda: 0.75, hubble_h: 0.73}}, box_size: 62.5, particle_mass: 0.1}}
units: {{length_in_cm: 3.08568e+24, mass_in_g: 1.989e+43, velocity_in_cm_per_s: 100000}}
modules: {{enabled: [{modules}], parameters: {{SageInfall: {{ReionizationOn: 0}}, Unused: {{X: 1}}}}}}
"""


def test_a_binary_run_gives_every_output_field(spark, tmp_path):
    """The central, satellite and orphan of FIXTURES 2.1: all 46 fields, without physics; file 1 is missing."""
    write_tree_file(str(tmp_path / "trees.0"), [spun(M1), [], spun([halo(5, 0, 40, 4)])])
    write_tree_file(str(tmp_path / "trees.2"), [spun([halo(3, 0, 50, 5)])])
    run.run_model(spark, settings(tmp_path))
    names = {s: f"model_z{1 / A_LIST[s] - 1:.3f}" for s in (3, 4, 5)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_file()) == sorted(f"{n}_{k}" for n in names.values() for k in (0, 2))
    assert files.read(f"{tmp_path}/out/{names[5]}_2") == np.array([1, 0, 0], "<i4").tobytes()
    assert np.frombuffer(files.read(f"{tmp_path}/out/{names[5]}_0", 0, 20), "<i4").tolist() == [3, 4, 3, 0, 1]
    back = catalogue.read_binary(spark, f"{tmp_path}/out/{names[5]}_*", rows_per_task=2).collect()
    assert len(back) == 4 and len(back[0]) == 46
    # The central, the orphan, the satellite.
    a, c, b = sorted((r for r in back if r.ModelTreeIndex == 0), key=lambda r: (r.ModelHaloIndex, r.Type))
    times = dict((s, t) for s, _, _, t in [tuple(r) for r in snapshots(spark, A_LIST, C).collect()])
    rho = C.critical_density(1 / A_LIST[5] - 1)
    for r, i, kind, mass, fell in ((a, 0, 0, 90.0, 0.0), (c, 0, 2, 0.0, 9.0), (b, 1, 1, 20.0, 20.0)):
        host = spun(M1)[i]
        m = 90.0 if i == 0 else 20.0
        radius = (m / (200 * 4 * np.pi / 3 * rho)) ** (1 / 3)
        assert (r.SnapNum, r.Type, r.HaloIndex, r.CentralHaloIndex, r.ModelHaloIndex, r.ModelTreeIndex) == (5, kind, i, 0, i, 0)
        assert (r.MergeStatus, r.mergeType, r.mergeIntoID, r.mergeIntoSnapNum) == (0, 0, -1, -1)
        assert r.SimulationHaloIndex == host["MostBoundID"] and r.Spin == pytest.approx(host["Spin"]) and r.VelDisp == pytest.approx(host["VelDisp"])
        assert r.Mvir == pytest.approx(mass) and r.infallMvir == pytest.approx(fell) and r.CentralMvir == pytest.approx(90)
        assert r.Rvir == pytest.approx(radius, rel=1e-5) and r.Vvir == pytest.approx((C.units.gravity * m / radius) ** 0.5, rel=1e-5)
        assert r.dT == pytest.approx((times[4] - times[5]) * C.units.time_s / SEC_PER_MEGAYEAR, rel=1e-4)
        # An orphan keeps what it had where it was last seen.
        seen = spun(M1)[4] if kind == 2 else host
        assert r.Pos == pytest.approx(seen["Pos"]) and r.Vel == pytest.approx(seen["Vel"]) and r.Len == seen["Len"] and r.Vmax == 100
        assert (r.infallVmax > 0) == (r.infallVvir > 0) == (kind != 0)
        assert all(r[f.name] == 0 for f in output_schema().fields[25:])
    other = next(r for r in back if r.ModelTreeIndex == 2)
    assert (other.HaloIndex, other.CentralHaloIndex, other.dT, other.infallMvir) == (2 * 10**9, 2 * 10**9, -1.0, 0.0)
    assert (tmp_path / "out/metadata/run.json").exists()
    before = (tmp_path / f"out/{names[5]}_2").stat().st_mtime_ns
    run.run_model(spark, settings(tmp_path), skip_existing=True)
    assert (tmp_path / f"out/{names[5]}_2").stat().st_mtime_ns == before


SIX = "sage_infall, sage_cooling, sage_starformation_feedback, sage_reincorporation, sage_disk_instability, sage_mergers"


def test_the_default_modules_run_from_trees_to_a_catalogue(spark, tmp_path):
    """All six modules over three snapshots: baryons of a group stay at the baryon fraction of its central."""
    write_tree_file(str(tmp_path / "trees.0"), [spun(M1), spun([halo(5, 0, 400, 40, first=1), halo(4, 1, 300, 30, 0)])])
    config = parse_config(settings(tmp_path, SIX, "parquet"))
    assert run.unused_sections(config) == ["Unused"]
    rows = run.run_model(spark, config, model_tables())
    stored = catalogue.read_catalogue(spark, f"{tmp_path}/out/model", [5])
    assert stored.count() == 4 and set(f.name for f in output_schema().fields) <= set(stored.columns)
    total = sum((F.col(c) for c in ("StellarMass", "ColdGas", "HotGas", "EjectedMass", "ICS", "BlackHoleMass")), F.lit(0.0))
    sums = {(r.tree_id, r.SnapNum, r.CentralHaloIndex % 10**9): (r.b, r.m) for r in rows.groupBy("tree_id", "SnapNum", "CentralHaloIndex").agg(F.sum(total).alias("b"), F.max("CentralMvir").alias("m")).collect()}
    assert len(sums) == 7
    for b, m in sums.values():
        assert b == pytest.approx(0.17 * m, rel=1e-3)
    with pytest.raises(ValueError, match="CoolFunctionsDir"):
        run.run_model(spark, config)


def test_modules_see_their_snapshots_redshift(spark, tmp_path):
    seen = []

    def note(df, ctx):
        seen.append(round(ctx.redshift, 6))
        return df.withColumn("TestDummyProperty", F.lit(ctx.redshift).cast("float"))

    calls = []
    register(Module("note", "Note", note, init=lambda _: calls.append("init"), cleanup=lambda _: calls.append("cleanup")))
    try:
        path = str(tmp_path / "trees_0.0")
        write_tree_file(path, [M1])
        with running(["note"], physics.Context()) as one:
            out = forest.evolve(read_trees(spark, path), snapshots(spark, A_LIST), 0.1, pipeline=one)
        got = {r.SnapNum: r.z for r in out.groupBy("SnapNum").agg(F.max("TestDummyProperty").alias("z")).collect()}
        assert got == {s: pytest.approx(1 / A_LIST[s] - 1, abs=1e-6) for s in (3, 4, 5)} and seen == [round(1 / A_LIST[s] - 1, 6) for s in (3, 4, 5)]
        with pytest.raises(RuntimeError, match="stop"), running(["note"], physics.Context()):
            raise RuntimeError("stop")
        assert calls == ["init", "cleanup"] * 2
    finally:
        del _REGISTRY["note"]


def test_switches_of_the_modules_are_read():
    good = {"SageStarformationFeedback": {"SFprescription": 0, "DiskInstabilityOn": 1}, "SageDiskInstability": {"DiskInstabilityOn": 0}, "SageMergers": {"ThreshMajorMerger": 0.4, "AGNrecipeOn": 0}, "SageCooling": {"CoolFunctionsDir": "x"}}
    names = ["sage_starformation_feedback", "sage_disk_instability", "sage_mergers", "sage_cooling"]
    pipeline(names, physics.Context(parameters=good, cooling_tables=model_tables()))
    for section, bad in (("SageStarformationFeedback", {"SFprescription": 1}), ("SageMergers", {"ThreshMajorMerger": 1.5})):
        with pytest.raises(ValueError, match="outside"):
            pipeline(names, physics.Context(parameters={section: bad}, cooling_tables=model_tables()))
    assert Parameter("x", "").read("a/b") == "a/b"


def test_merged_objects_are_noted_in_their_last_row(spark, tmp_path):
    """The satellite of snapshot 5 merges there: its row goes, and the one of snapshot 4 says where to."""
    path = str(tmp_path / "trees_0.0")
    write_tree_file(path, [M1])

    def merging(df, redshift):
        if round(redshift, 6) != 0:
            return df
        events = df.filter("Type = 1").select(*physics.GROUP, "group_ord", F.lit(0).alias("target"), F.lit(False).alias("disrupts"))
        return apply_events(df, events, 0.0)

    trees, snaps = read_trees(spark, path), snapshots(spark, A_LIST)
    out = forest.evolve(trees, snaps, 0.1, pipeline=merging)
    assert out.filter("SnapNum = 5").count() == 2
    rows = catalogue_rows(out, forest.with_virial(trees, snaps, 0.1, C)).filter("MergeStatus = 1").collect()
    assert [(r.SnapNum, r.ModelHaloIndex, r.mergeType, r.mergeIntoID, r.mergeIntoSnapNum) for r in rows] == [(4, 3, 2, 0, 5)]


def test_evolution_of_many_halos(spark, tmp_path):
    """Objects are neither lost nor made: every group has one central, every root an object, and each object a past."""
    rng, trees = np.random.RandomState(1), []
    for _ in range(40):
        rows, last = [], []
        for snap in range(6):
            here = list(range(len(rows), len(rows) + max(1, 6 - snap)))
            rows += [halo(snap, i, int(rng.randint(20, 500)), float(rng.uniform(1, 50))) for i in here]
            heirs = {i: [] for i in here}
            for k, p in enumerate(last):
                d = here[min(k, len(here) - 1)]
                rows[p]["Descendant"] = d
                heirs[d].append(p)
            for d, ps in heirs.items():
                if ps:
                    rows[d]["FirstProgenitor"] = ps[0]
                    for a, b in zip(ps, ps[1:]):
                        rows[a]["NextProgenitor"] = b
            last = here
        trees.append(rows)
    path = str(tmp_path / "trees_0.0")
    write_tree_file(path, trees)
    out = forest.evolve(read_trees(spark, path), snapshots(spark, A_LIST), 0.1)
    counts = {r.SnapNum: (r.n, r.c) for r in out.groupBy("SnapNum").agg(F.count("*").alias("n"), F.count(F.when(F.col("Type") == 0, 1)).alias("c")).collect()}
    assert counts == {s: (40 * 6, 40 * max(1, 6 - s)) for s in range(6)}
    assert out.select("file_nr", "tree_id", "SnapNum", "born").distinct().count() == out.count()


# --- hierarchical files ----------------------------------------------------------------------------------------------


class Node(dict):
    """A group or dataset that holds what the library's would."""

    def __init__(self, data=None):
        super().__init__()
        self.attrs, self.data = {}, data

    def create_group(self, name):
        self[name] = Node()
        return self[name]

    def create_dataset(self, name, data, **_):
        self[name] = Node(np.asarray(data))
        return self[name]

    def __getitem__(self, key):
        if isinstance(key, slice):
            return self.data[key]
        node = self
        for part in key.split("/"):
            node = dict.__getitem__(node, part)
            if isinstance(node, tuple):
                node = STORE[node[0]][node[1]]
        return node

    @property
    def shape(self):
        return self.data.shape

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


STORE: dict[str, Node] = {}


@pytest.fixture()
def library(monkeypatch):
    """A stand-in for h5py that keeps files in memory, by their last name."""
    STORE.clear()
    h5py = types.ModuleType("h5py")

    def open_(path, mode):
        name = path.rsplit("/", 1)[-1]
        if mode == "w":
            STORE[name] = Node()
        return STORE[name]

    h5py.File, h5py.ExternalLink = open_, lambda name, inside: (name, inside)
    monkeypatch.setitem(sys.modules, "h5py", h5py)
    monkeypatch.setattr(files, "exists", lambda path: path.rsplit("/", 1)[-1] in STORE)
    return h5py


def test_hierarchical_trees_are_read_by_fields(library):
    f = hdf5.open_file("trees.0.hdf5", "w")
    header = f.create_group("Header")
    header.attrs |= {"Ntrees": 2, "totNHalos": 8, "InputTreeNHalos": [7, 1]}
    for t, tree in enumerate([spun(M1), spun([halo(5, 0, 40, 4)])]):
        rows = np.zeros(len(tree), numpy_record(TREE))
        for row, h in zip(rows, tree, strict=True):
            for k, v in h.items():
                row[k] = v
        group = f.create_group(f"tree_{t:03d}")
        for name, _ in TREE:
            group.create_dataset(hdf5.FIELD_NAMES.get(name, name), rows[name])
    assert hdf5.tree_counts(f).tolist() == [7, 1]
    reader = hdf5.Hdf5TreeReader({"path": "x", "halosPerPartition": "7"})
    reader.paths = ["a/trees.0.hdf5"]
    parts = reader.partitions()
    assert [(p.file_nr, p.first_tree, p.counts) for p in parts] == [(0, 0, [7]), (0, 1, [1])]
    batch = next(reader.read(parts[0])).to_pydict()
    assert batch["Mvir"] == pytest.approx([h["Mvir"] for h in M1]) and batch["Spin"][2] == pytest.approx([0.02, 0.02, 0.03]) and batch["halo_nr"] == list(range(7))
    header.attrs["totNHalos"] = 9
    with pytest.raises(ValueError, match="differ"):
        hdf5.tree_counts(f)
    with pytest.raises(ValueError, match="no header names"):
        hdf5.tree_counts(f, "lhalo_binary")


def test_hierarchical_catalogues_and_their_master(library):
    rng = np.random.RandomState(0)
    for nr, n in ((0, 3), (2, 2)):
        f = hdf5.open_file(f"out/model_{nr:03d}.hdf5", "w")
        for snap in (4, 5):
            rows = np.zeros(n, output_record())
            rows["Mvir"], rows["SnapNum"] = rng.uniform(1, 9, n), snap
            hdf5.write_rows(f, rows, snap, np.array([1, n - 1]))
    hdf5.write_master("out", "model", [0, 1, 2], [4, 5], {4: 0.5, 5: 0.0}, {"BoxSize": 62.5})
    master = hdf5.open_file("out/model.hdf5")
    assert hdf5.count_rows(master, 5) == 5 and hdf5.count_rows(master, 7) == 0 and hdf5.snapshot_rows(master, 7) is None
    own = np.concatenate([STORE[f"model_{k:03d}.hdf5"]["Snap005"]["Galaxies"][:]["Mvir"] for k in (0, 2)])
    assert np.array_equal(hdf5.snapshot_rows(master, 5)["Mvir"], own)
    assert hdf5.metadata(master)["Snap004_Redshift"] == 0.5 and master["RunProperties"].attrs == {"BoxSize": 62.5}
    assert STORE["model_000.hdf5"]["Snap005"]["TreeHalosPerSnap"][:].tolist() == [1, 2]
    assert STORE["model_000.hdf5"]["Snap005/Galaxies"].attrs == {"Ntrees": 2, "TotHalosPerSnap": 3}


def test_without_the_library_there_is_a_clear_error(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ImportError, match="needs h5py"):
        hdf5.open_file("x.hdf5")
    text = CONFIG.replace("lhalo_binary", "other")
    with pytest.raises(ValueError, match="unknown tree type"):
        parse_config(text)


def test_files_are_found_by_path_and_uri(tmp_path):
    for name in ("a_1", "a_2", "b_1"):
        with files.create(f"{tmp_path}/deep/{name}") as f:
            f.write(b"0123456789")
    assert [p.rsplit("/", 1)[-1] for p in files.find(f"{tmp_path}/deep/a_*")] == ["a_1", "a_2"]
    uri = (tmp_path / "deep" / "b_1").as_uri()
    assert files.find(f"{tmp_path}/none/*") == [] and files.exists(uri) and files.size(uri) == 10 and files.read(uri, 2, 3) == b"234"
