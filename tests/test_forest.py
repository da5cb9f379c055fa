import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators.forest import evolve, link
from canopy.operators.physics import Context
from canopy.plans.modules import build_order, pipeline, registered
from canopy.sources.catalogue import decode_index, encode_index, read_catalogue, tree_headers, write_catalogue
from canopy.sources.tables import module_order, parse_config, parse_key_values, snapshots
from canopy.sources.trees import read_trees, tree_counts, tree_table, write_tree_file

A_LIST = [0.9, 0.92, 0.94, 0.96, 0.98, 1.0]  # snapshots 0 to 5; 3, 4 and 5 are used


def halo(snap, root, length, mvir, desc=-1, first=-1, following=-1, next_fof=-1):
    return {"SnapNum": snap, "FirstHaloInFOFgroup": root, "Len": length, "Mvir": mvir, "Descendant": desc, "FirstProgenitor": first, "NextProgenitor": following, "NextHaloInFOFgroup": next_fof, "Vmax": 100.0, "MostBoundID": length}


# A central, a satellite and an orphan; halo 6 is no root and gets nothing.
M1 = [halo(5, 0, 1000, 90, first=2, next_fof=1), halo(5, 0, 200, -1, first=3), halo(4, 2, 800, 70, 0, 5, 4, 6), halo(4, 3, 220, 20, 1), halo(4, 4, 100, 9, 0), halo(3, 5, 700, 60, 2), halo(4, 2, 50, -1)]


def test_tree_files_round_trip_in_ranges_and_both_byte_orders(spark, tmp_path):
    trees = [M1, [], [halo(5, 0, 30, 3)]]
    for order, name in (("<", "little"), (">", "big")):
        path = str(tmp_path / f"{name}_0.7")
        write_tree_file(path, trees, order)
        assert tree_counts(path, order).tolist() == [7, 0, 1]
        rows = read_trees(spark, path, endianness=name, halosPerPartition="2").orderBy("tree_id", "halo_nr").collect()
        assert [(r.file_nr, r.tree_id, r.halo_nr, r.Len) for r in rows] == [(7, 0, i, h["Len"]) for i, h in enumerate(M1)] + [(7, 2, 0, 30)]
        assert rows[0].Pos == [0, 0, 0]
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="differ"):
        tree_counts(path, ">")


def evolved(spark, tmp_path, trees, **more):
    path = str(tmp_path / "trees_0.0")
    write_tree_file(path, trees)
    return evolve(read_trees(spark, path), snapshots(spark, A_LIST), 0.1, **more)


def test_central_satellite_and_orphan(spark, tmp_path):
    out = evolved(spark, tmp_path, [M1, [halo(5, 0, 40, 4)]])
    got = [(r.SnapNum, r.halo_nr, r.Type, round(r.Mvir, 3), round(r.deltaMvir, 3), round(r.infallMvir, 3), round(r.MergTime, 1), r.dT > 0) for r in out.filter("tree_id = 0").orderBy("SnapNum", "group_ord", "halo_nr").collect()]
    assert got == [
        (3, 5, 0, 60.0, 0.0, -1.0, 999.9, False),
        (4, 2, 0, 70.0, 10.0, -1.0, 999.9, True),
        (4, 3, 0, 20.0, 0.0, -1.0, 999.9, False),
        (4, 4, 0, 9.0, 0.0, -1.0, 999.9, False),
        (5, 0, 0, 90.0, 20.0, -1.0, 999.9, True),
        (5, 0, 2, 0.0, -9.0, 9.0, 0.0, True),
        (5, 1, 1, 20.0, 0.0, 20.0, 999.9, True),
    ]
    assert out.filter("tree_id = 1").count() == 1


def test_first_occupied_rule_and_skipped_snapshots(spark, tmp_path):
    # p0 holds nothing (no root); of equal p2 and p3 the earlier one wins; p1 skips a snapshot.
    tree = [halo(5, 0, 100, 50, first=1), halo(4, 3, 90, -1, 0, following=2), halo(3, 2, 30, 3, 0, following=3), halo(4, 3, 40, 4, 0, following=4, next_fof=1), halo(4, 4, 40, 5, 0)]
    rows = {(r.halo_nr, r.Type): r for r in evolved(spark, tmp_path, [tree]).filter("SnapNum = 5").collect()}
    assert rows[(0, 0)].deltaMvir == 50 - 4
    orphans = evolved(spark, tmp_path, [tree]).filter("SnapNum = 5 and Type = 2").select("infallMvir").collect()
    assert sorted(r[0] for r in orphans) == [3.0, 5.0]


def test_broken_trees_are_errors(spark, tmp_path):
    path = str(tmp_path / "bad_0.0")
    write_tree_file(path, [[halo(4, 0, 10, 1, first=1), halo(5, 1, 10, 1, 0)]])
    with pytest.raises(Exception, match="not later"):
        link(read_trees(spark, path)).collect()


def test_modules_run_in_order_and_conserve_mass(spark, tmp_path):
    ctx = Context(parameters={"SimpleCooling": {"BaryonFraction": "0.2"}, "SimpleSFR": {"Efficiency": 0.02}})
    out = evolved(spark, tmp_path, [M1], pipeline=pipeline(["simple_cooling", "simple_sfr"], ctx)).filter("SnapNum = 5 and Type = 0").collect()[0]
    assert out.ColdGas + out.StellarMass == pytest.approx(0.2 * (10 + 20), rel=1e-5)
    full = evolved(spark, tmp_path, [M1], pipeline=pipeline(["sage_infall"], Context(parameters={"SageInfall": {"ReionizationOn": 0}})))
    hot = full.filter("SnapNum = 5").agg(F.sum(F.col("HotGas") + F.col("ColdGas") + F.col("StellarMass") + F.col("EjectedMass"))).first()[0]
    assert hot == pytest.approx(0.17 * 90, rel=1e-4)


def test_module_registry_checks():
    order = build_order()
    assert order.index("sage_infall") < order.index("sage_cooling") < order.index("sage_starformation_feedback")
    assert set(order) == set(registered())
    with pytest.raises(ValueError, match="unknown modules"):
        pipeline(["no_such"], Context())
    with pytest.raises(ValueError, match="unknown parameters"):
        pipeline(["simple_sfr"], Context(parameters={"SimpleSFR": {"x": 1}}))
    with pytest.raises(ValueError, match="outside"):
        pipeline(["simple_sfr"], Context(parameters={"SimpleSFR": {"Efficiency": "2"}}))
    with pytest.raises(ValueError, match="need each other"):
        module_order({"a": {"b"}, "b": {"a"}})


def test_catalogue_round_trip_and_headers(spark, tmp_path):
    out = evolved(spark, tmp_path, [M1, [], [halo(5, 0, 40, 4)]])
    write_catalogue(out, str(tmp_path / "cat"), [4, 5])
    back = read_catalogue(spark, str(tmp_path / "cat"), [5])
    assert back.count() == 4
    trees = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "file_nr int, tree_id int")
    assert sorted((r.tree_id, r.n) for r in tree_headers(back, trees).collect()) == [(0, 3), (1, 0), (2, 1)]


def test_index_encoding(spark):
    row = spark.range(1).select(encode_index(F.lit(2), F.lit(3), F.lit(4)).alias("i"), encode_index(F.lit(2), F.lit(3), F.lit(4), 10_000).alias("j"))
    assert tuple(row.first()) == (2000003000000004, 200003000000004)
    assert tuple(row.select(*decode_index(F.col("i"))).first()) == (2, 3, 4)


def test_tree_table_prefix_sum(spark):
    halos = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] * 2 + [(1, 0)], "file_nr int, tree_id int")
    assert sorted(tuple(r) for r in tree_table(halos).collect()) == [(0, 0, 3, 0), (0, 1, 2, 3), (1, 0, 1, 0)]


CONFIG = """
output: {file_base_name: model, directory: out, snapshot_count: 1, format: binary, snapshot_list: [5]}
input: {first_file: 0, last_file: 0, tree_name: trees, tree_type: lhalo_binary, simulation_dir: in, snapshot_list_file: a, last_snapshot: 5}
simulation: {cosmology: {omega_matter: 0.25, omega_lambda: 0.75, hubble_h: 0.73}, box_size: 62.5, particle_mass: 0.08}
units: {length_in_cm: 3.08568e+24, mass_in_g: 1.989e+43, velocity_in_cm_per_s: 100000}
modules: {enabled: [simple_sfr], parameters: {SimpleSFR: {Efficiency: 0.03}}}
"""


def test_settings_are_parsed_and_checked():
    c = parse_config(CONFIG)
    assert (c.output_snapshots, c.modules, c.parameters["SimpleSFR"]["Efficiency"]) == ((5,), ("simple_sfr",), 0.03)
    for old, new in (("snapshot_count: 1", "snapshot_count: 3"), ("[5]", "[7]"), ("last_file: 0", "last_file: -1"), ("box_size: 62.5", "box_size: 0")):
        with pytest.raises(ValueError):
            parse_config(CONFIG.replace(old, new))
    assert parse_key_values("A 1 % x\n# no\n-> 3 4\n") == {"A": "1", "snapshots": [3, 4]}
    assert np.isclose(c.cosmology.units.time_myr, 978028.526)
