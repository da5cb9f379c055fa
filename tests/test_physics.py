"""Physics modules against plain loops over each group's objects, written from the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from canopy.functions import galaxy as G
from canopy.operators import mergers as M
from canopy.operators import physics as P
from canopy.plans.registry import model_tables
from canopy.units import BOLTZMANN, PROTON_MASS, SEC_PER_YEAR, SOLAR_MASS, Cosmology

TINY = 1e-10
MASSES = ["StellarMass", "ColdGas", "HotGas", "MetalsColdGas", "MetalsHotGas", "MetalsStellarMass", "EjectedMass", "MetalsEjectedMass", "ICS", "MetalsICS", "BulgeMass", "MetalsBulgeMass", "BlackHoleMass"]
HALO = ["Mvir", "deltaMvir", "Rvir", "Vvir", "Vmax", "dT"]
OTHER = ["Cooling", "Heating", "r_heat", "DiskScaleRadius", "OutflowRate", "TotalSatelliteBaryons", "TestDummyProperty", "QuasarModeBHaccretionMass", "TimeOfLastMajorMerger", "TimeOfLastMinorMerger"]
COSMOLOGY = Cosmology()


def z_of(gas, metals):
    return metals / gas if gas > TINY else 0.0


def ratio(a, b, default=0.0):
    return default if abs(b) < TINY else a / b


def make(seed, n=60):
    """Groups of centrals, satellites and orphans; some have no central, no gas, or no time step."""
    rng, rows = random.Random(seed), []
    for g in range(n):
        members = [0] * (g % 7 != 3) + rng.choices([1, 2], k=rng.randint(0 if g % 7 != 3 else 1, 4))
        for k, kind in enumerate(members):
            r = {"file_nr": 0, "tree_id": g // 10, "fof_root": g, "group_ord": k, "Type": kind, "born": 100 * g + k}
            for c in MASSES:
                r[c] = 0.0 if rng.random() < 0.15 else rng.uniform(0.01, 5) * (0.02 if c.startswith("Metals") else 0.01 if c == "BlackHoleMass" else 1)
            r["BulgeMass"], r["MetalsBulgeMass"] = 0.3 * r["StellarMass"], 0.2 * r["MetalsStellarMass"]
            r |= {"Mvir": 0.0 if kind == 2 else rng.uniform(1, 300), "deltaMvir": rng.uniform(-5, 5), "Rvir": rng.uniform(0.05, 0.4), "Vvir": 0.0 if rng.random() < 0.05 else rng.uniform(50, 900), "Vmax": rng.uniform(50, 300), "dT": rng.choice([-1.0, 0.0, 2e-4, 3e-3])}
            r |= dict.fromkeys(OTHER, 0.0) | {"r_heat": rng.choice([0.0, 0.01, 1.0]), "Spin": [rng.uniform(-5, 5) for _ in range(3)]}
            r |= {"SnapNum": 5, "MergeStatus": 0, "mergeType": 0, "mergeIntoBorn": -1, "mergeIntoSnapNum": -1}
            rows.append(r)
    return rows


def frame(spark, rows):
    kinds = {"Spin": "array<float>", "Cooling": "double", "Heating": "double"}
    names = list(rows[0])
    schema = ", ".join(f"{c} {kinds.get(c) or ('float' if isinstance(rows[0][c], float) else 'int')}" for c in names)
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["fof_root"], []).append(dict(r))
    return out.values()


def compare(spark, module, loop, shown, rows, rel=2e-4):
    want = {}
    for members in groups(rows):
        lead = next((r for r in members if r["Type"] == 0), None)
        loop(members, lead)
        want |= {(r["fof_root"], r["group_ord"]): r for r in members}
    got = module(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[(r["fof_root"], r["group_ord"])]
        for c in shown:
            assert r[c] == pytest.approx(w[c], rel=rel, abs=2e-6), (c, r["Type"], r["fof_root"], r["group_ord"])


def infall(fraction, modifier, steps):
    def run(members, lead):
        if lead is None:
            return
        total = {c: sum(r[c] for r in members) for c in MASSES}
        lead["TotalSatelliteBaryons"] = sum(r["StellarMass"] + r["ColdGas"] + r["HotGas"] for r in members if r is not lead)
        fall = modifier(lead["Mvir"]) * fraction * lead["Mvir"] - sum(total[c] for c in ("StellarMass", "ColdGas", "HotGas", "EjectedMass", "ICS"))
        for r in members:
            if r is not lead:
                r["EjectedMass"] = r["MetalsEjectedMass"] = r["ICS"] = r["MetalsICS"] = 0.0
        for gas in ("EjectedMass", "ICS"):
            lead[gas], lead["Metals" + gas] = total[gas], min(total["Metals" + gas], total[gas])
        if fall < 0 < lead["EjectedMass"]:
            lead["MetalsEjectedMass"] = max(0.0, lead["MetalsEjectedMass"] + fall * z_of(lead["EjectedMass"], lead["MetalsEjectedMass"]))
            lead["EjectedMass"] += fall
            fall = min(0.0, lead["EjectedMass"])
            if lead["EjectedMass"] < 0:
                lead["EjectedMass"] = lead["MetalsEjectedMass"] = 0.0
        if fall < 0 < lead["MetalsHotGas"]:
            lead["MetalsHotGas"] = max(0.0, lead["MetalsHotGas"] + fall * z_of(lead["HotGas"], lead["MetalsHotGas"]))
        lead["HotGas"] += fall
        if lead["HotGas"] < 0:
            lead["HotGas"] = lead["MetalsHotGas"] = 0.0
        for r in members:
            over = (sum(r[c] for c in ("StellarMass", "ColdGas", "HotGas", "EjectedMass", "ICS")) - modifier(r["Mvir"]) * fraction * r["Mvir"]) / steps
            if r["Type"] == 1 and over > 0:
                gas, metals = min(over, r["HotGas"]), min(over * z_of(r["HotGas"], r["MetalsHotGas"]), r["MetalsHotGas"])
                r["HotGas"] -= gas
                r["MetalsHotGas"] -= metals
                lead["HotGas"] += gas
                lead["MetalsHotGas"] += metals

    return run


@pytest.mark.parametrize("redshift", [None, 0.0, 3.0])
def test_infall_strips_and_moves(spark, redshift):
    """PHY01, PHY02, PHY03: without and with reionisation, at two redshifts."""
    ion = G.Reionization(form="corrected")

    def modifier(m):
        return 1.0 if redshift is None else (1 + 0.26 * ion.scale_mass(redshift, COSMOLOGY) / (m + TINY)) ** -3

    ctx = P.Context(redshift=redshift or 0.0)
    shown = ["HotGas", "MetalsHotGas", "EjectedMass", "MetalsEjectedMass", "ICS", "MetalsICS", "TotalSatelliteBaryons"]
    compare(spark, lambda df: P.infall(df, ctx, reionization=redshift is not None, form="corrected", steps=4.0), infall(0.17, modifier, 4.0), shown, make(1))


def cooling_rate(log_t, log_z, tables):
    grid = [d + math.log10(G.SOLAR_METALLICITY) for d in G.COOLING_DEX]
    z = min(max(log_z, grid[0]), grid[-1])
    i = next((k for k in range(len(grid) - 1) if z <= grid[k + 1]), len(grid) - 2)
    t = max(log_t, 4.0)
    k = min(int((t - 4.0) / 0.05), G.LOG_T_ROWS - 2)
    at = (t - 4.0 - 0.05 * k) / 0.05
    a, b = (tables[i + j][k] + (tables[i + j][k + 1] - tables[i + j][k]) * at for j in (0, 1))
    return 10 ** (a + (b - a) / (grid[i + 1] - grid[i]) * (z - grid[i]))


def cooling(agn, scale, tables):
    u, h = COSMOLOGY.units, COSMOLOGY.hubble_h

    def run(members, lead):
        r = lead
        if r is None or r["HotGas"] <= TINY or r["Vvir"] <= TINY:
            return
        dt = r["dT"] * scale if r["dT"] > TINY else 0.0
        t, temperature = ratio(r["Rvir"], r["Vvir"]), 35.9 * r["Vvir"] ** 2
        log_z = math.log10(r["MetalsHotGas"] / r["HotGas"]) if r["MetalsHotGas"] > TINY else -10.0
        x = PROTON_MASS * BOLTZMANN * temperature / cooling_rate(math.log10(temperature), log_z, tables) / (u.density_cgs * u.time_s)
        radius = math.sqrt(ratio(ratio(r["HotGas"], 4 * math.pi * r["Rvir"]), ratio(x, t) * 0.885))
        cool = r["HotGas"] * ratio(r["Vvir"], r["Rvir"]) * dt if radius > r["Rvir"] else ratio(r["HotGas"], r["Rvir"]) * ratio(radius, 2 * t) * dt
        cool = min(max(cool, 0.0), r["HotGas"])
        if agn and cool > TINY:
            cool = (1 - ratio(r["r_heat"], radius)) * cool if r["r_heat"] < radius else 0.0
            base = 0.01 / (u.mass_g / u.time_s * SEC_PER_YEAR / SOLAR_MASS) * (r["BlackHoleMass"] / 0.01) * (r["Vvir"] / 200) ** 3
            rate = {
                1: base * (ratio(r["HotGas"], r["Mvir"]) / 0.1 if r["Mvir"] > TINY else 1),
                2: 2.5 * math.pi * u.gravity * 0.375 * 0.6 * x * r["BlackHoleMass"] * 0.01,
                3: 1e-4 * ratio(cool, dt) if r["BlackHoleMass"] > 1e-4 * r["Mvir"] * ratio(radius, r["Rvir"]) ** 3 else 0.0,
            }[agn]
            rate = min(rate, 1.3e38 * r["BlackHoleMass"] * 1e10 / h / (u.energy_cgs / u.time_s) / (0.1 * 9e20))
            fed = min(rate * dt, r["HotGas"])
            strength = ratio(1.34e5, r["Vvir"], 1.0) ** 2
            heat = strength * fed
            if heat > cool:
                fed, heat = ratio(cool, strength), cool
            z = z_of(r["HotGas"], r["MetalsHotGas"])
            r["BlackHoleMass"] += fed
            r["HotGas"] -= fed
            r["MetalsHotGas"] -= z * fed
            if r["r_heat"] < radius and cool > TINY:
                r["r_heat"] = max(r["r_heat"], ratio(heat, cool) * radius)
            if heat > TINY:
                r["Heating"] += 0.5 * heat * r["Vvir"] ** 2
        if cool > TINY:
            cool = min(cool, r["HotGas"])
            z = z_of(r["HotGas"], r["MetalsHotGas"])
            for a, b, m in (("HotGas", "ColdGas", cool), ("MetalsHotGas", "MetalsColdGas", z * cool)):
                r[a] -= m
                r[b] += m
            r["Cooling"] += 0.5 * cool * r["Vvir"] ** 2

    return run


@pytest.mark.parametrize("agn", [0, 1, 2, 3])
def test_cooling_and_heating(spark, agn):
    """PHY04 to PHY07, each accretion recipe; the time step in code units, so that much cools."""
    tables = model_tables()
    ctx = P.Context(cooling_tables=tables)
    shown = ["HotGas", "ColdGas", "MetalsHotGas", "MetalsColdGas", "BlackHoleMass", "r_heat", "Cooling", "Heating"]
    compare(spark, lambda df: P.cooling(df, ctx, agn=agn, dt_units="code"), cooling(agn, 1.0, tables), shown, make(2), rel=5e-4)
    if agn == 1:
        compare(spark, lambda df: P.cooling(df, ctx), cooling(1, 1 / COSMOLOGY.units.time_myr, tables), shown, make(2))


def star_formation(ejection, eta):
    def run(members, lead):
        if lead is None:
            return
        for r in members:
            size = math.sqrt(sum(x * x for x in r["Spin"]))
            r["DiskScaleRadius"] = size / (1.414213562 * r["Vvir"] * r["Rvir"]) / 1.414213562 * r["Rvir"] if r["Vvir"] > TINY and r["Rvir"] > TINY else 0.1 * r["Rvir"]
            if r["dT"] <= 0:
                continue
            reach = 3 * r["DiskScaleRadius"]
            over = r["ColdGas"] - 0.19 * r["Vvir"] * reach
            stars = max(0.0, 0.02 * ratio(over, ratio(reach, r["Vvir"])) * r["dT"]) if over > 0 else 0.0
            heat = 3.0 * stars
            if stars + heat > r["ColdGas"]:
                scale = ratio(r["ColdGas"], stars + heat, 1.0)
                stars, heat = stars * scale, heat * scale
            out = max(0.0, (ejection * ratio(eta, lead["Vvir"] ** 2) - 3.0) * stars)
            z = z_of(r["ColdGas"], r["MetalsColdGas"])
            kept = 0.57 * stars
            for c, m in (("ColdGas", -kept), ("MetalsColdGas", -z * kept), ("StellarMass", kept), ("MetalsStellarMass", z * kept)):
                r[c] += m
            z = z_of(r["ColdGas"], r["MetalsColdGas"])
            for c, m in (("ColdGas", -heat), ("MetalsColdGas", -z * heat)):
                r[c] += m
            lead["HotGas"] += heat
            lead["MetalsHotGas"] += z * heat
            gone, z_hot = min(out, lead["HotGas"]), z_of(lead["HotGas"], lead["MetalsHotGas"])
            lead["HotGas"] -= gone
            lead["MetalsHotGas"] -= z_hot * gone
            lead["EjectedMass"] += gone
            lead["MetalsEjectedMass"] += z_hot * gone
            r["OutflowRate"] += heat
            made = 0.03 * stars
            if r["ColdGas"] > 1e-8:
                leave = 0.3 * math.exp(-lead["Mvir"] / 30)
                r["MetalsColdGas"] += made * (1 - leave)
                lead["MetalsHotGas"] += made * leave
            else:
                lead["MetalsHotGas"] += made

    return run


def test_star_formation_folds_over_the_group(spark):
    """PHY08 to PHY11: small spins, so that gas lies above the threshold, and feedback strong enough to eject."""
    rows = make(3)
    for r in rows:
        r["Spin"] = [x * 1e-3 for x in r["Spin"]]
    shown = ["ColdGas", "MetalsColdGas", "StellarMass", "MetalsStellarMass", "HotGas", "MetalsHotGas", "EjectedMass", "MetalsEjectedMass", "OutflowRate", "DiskScaleRadius"]
    compare(spark, lambda df: P.star_formation(df, P.Context(), ejection=2.0, eta=4e5), star_formation(2.0, 4e5), shown, rows, rel=1e-3)
    compare(spark, lambda df: P.star_formation(df, P.Context()), star_formation(0.3, 0.5), shown, make(4), rel=1e-3)


def test_reincorporation_and_disk_instability(spark):
    """PHY12 and PHY13."""

    def back(members, r):
        if r and r["EjectedMass"] > TINY and r["dT"] > 0 and r["Vvir"] > 445.48:
            m = min((r["Vvir"] / 445.48 - 1) * r["EjectedMass"] * r["Vvir"] / r["Rvir"] * r["dT"], r["EjectedMass"])
            z = z_of(r["EjectedMass"], r["MetalsEjectedMass"])
            for c, x in (("EjectedMass", -m), ("MetalsEjectedMass", -z * m), ("HotGas", m), ("MetalsHotGas", z * m)):
                r[c] += x

    compare(spark, lambda df: P.reincorporation(df, P.Context()), back, ["EjectedMass", "MetalsEjectedMass", "HotGas", "MetalsHotGas"], make(5))

    def unstable(members, lead):
        for r in members:
            if r["DiskScaleRadius"] <= 0:
                r["DiskScaleRadius"] = 0.03 * r["Rvir"]
            stars = r["StellarMass"] - r["BulgeMass"]
            mass = r["ColdGas"] + stars
            stable = min(r["Vmax"] ** 2 * 3 * r["DiskScaleRadius"] / COSMOLOGY.units.gravity, mass)
            moved = ratio(stars, mass) * (mass - stable)
            if moved > 0:
                r["MetalsBulgeMass"] += z_of(stars, r["MetalsStellarMass"] - r["MetalsBulgeMass"]) * moved
                r["BulgeMass"] += moved
                for c, top in (("BulgeMass", "StellarMass"), ("MetalsBulgeMass", "MetalsStellarMass")):
                    if r[c] > r[top] * 1.0001:
                        r[c] = r[top]

    rows = make(6)
    for r in rows:
        r["Vmax"] /= 8
    compare(spark, lambda df: P.disk_instability(df, P.Context()), unstable, ["BulgeMass", "MetalsBulgeMass", "DiskScaleRadius"], rows)
    assert P.disk_instability(frame(spark, rows), P.Context(), enabled=False).select(F.max("DiskScaleRadius")).first()[0] == 0


def merged(a, b, v, m, time, c):
    """The central a after b has merged into it, and the kind."""
    sizes = [g["StellarMass"] + g["ColdGas"] for g in (a, b)]
    share = ratio(min(sizes), max(sizes), 1.0)
    for x in ("ColdGas", "HotGas", "EjectedMass", "StellarMass", "ICS"):
        a[x] += b[x]
        a["Metals" + x] += b["Metals" + x]
    a["BlackHoleMass"] += b["BlackHoleMass"]
    a["BulgeMass"] += b["StellarMass"]
    a["MetalsBulgeMass"] += b["MetalsStellarMass"]
    before = a["BlackHoleMass"]
    if a["ColdGas"] > 0:
        fed = min(c.growth * share / (1 + ratio(280.0, v, 1e10) ** 2) * a["ColdGas"], a["ColdGas"])
        z = z_of(a["ColdGas"], a["MetalsColdGas"])
        a["BlackHoleMass"] += fed
        a["QuasarModeBHaccretionMass"] += fed
        a["ColdGas"] -= fed
        a["MetalsColdGas"] -= z * fed
    energy = c.wind * 0.1 * (a["BlackHoleMass"] - before) * (2.99792458e5 / 100) ** 2
    cold, hot = (0.5 * a[x] * v * v for x in ("ColdGas", "HotGas"))
    for x, goes in (("ColdGas", energy > cold), ("HotGas", energy > cold + hot)):
        if goes:
            for p in ("", "Metals"):
                a[p + "EjectedMass"] += a[p + x]
                a[p + x] = 0.0
    stars = max(0.0, 0.56 * share**0.7 * a["ColdGas"])
    heat = c.reheating * stars
    if stars + heat > a["ColdGas"]:
        scale = ratio(a["ColdGas"], stars + heat, 1.0)
        stars, heat = stars * scale, heat * scale
    out = max(0.0, (c.ejection * ratio(c.eta * c.energy, v * v) - c.reheating) * stars)
    z, kept = z_of(a["ColdGas"], a["MetalsColdGas"]), (1 - c.recycled) * stars
    for x, y in (("ColdGas", -kept), ("MetalsColdGas", -z * kept), ("StellarMass", kept), ("MetalsStellarMass", z * kept), ("BulgeMass", kept), ("MetalsBulgeMass", z * kept)):
        a[x] += y
    z = z_of(a["ColdGas"], a["MetalsColdGas"])
    for x, y in (("ColdGas", -heat), ("MetalsColdGas", -z * heat), ("HotGas", heat), ("MetalsHotGas", z * heat)):
        a[x] += y
    gone, z = min(out, a["HotGas"]), z_of(a["HotGas"], a["MetalsHotGas"])
    for x, y in (("HotGas", -gone), ("MetalsHotGas", -z * gone), ("EjectedMass", gone), ("MetalsEjectedMass", z * gone)):
        a[x] += y
    a["OutflowRate"] += heat
    made, leave = c.metal_yield * stars, c.leave * math.exp(-m / 30)
    if a["ColdGas"] > 1e-8 and share < c.major:
        a["MetalsColdGas"] += made * (1 - leave)
        a["MetalsHotGas"] += made * leave
    else:
        a["MetalsHotGas"] += made
    if share > 0.1:
        a["TimeOfLastMinorMerger"] = time
    if share > c.major:
        a["TimeOfLastMajorMerger"], a["BulgeMass"], a["MetalsBulgeMass"] = time, a["StellarMass"], a["MetalsStellarMass"]
    return M.MAJOR if share > c.major else M.MINOR


def test_merger_events_fold_in_order(spark):
    """PHY15 to PHY21, JON09: mergers and disruptions in the order of objects; a target that merges itself passes on to its own."""
    rows = [r for r in make(7) if r["fof_root"] % 7 != 3]
    config = M.MergerConfig(wind=5.0, eta=5e6)
    events, want, kinds, into = [], {}, {}, {}
    for members in groups(rows):
        lead = members[0]
        chosen = members[1:-1] if lead["fof_root"] % 2 else members[1:]
        goes = {r["group_ord"] for r in chosen}
        for r in chosen:
            # Every other one names the one after it, if that goes too.
            follower = r["group_ord"] + 1
            target = follower if follower in goes and r["group_ord"] % 2 else 0
            events.append((0, r["tree_id"], r["fof_root"], r["group_ord"], target, r["group_ord"] % 3 == 2))
            key = (r["fof_root"], r["group_ord"])
            into[key] = lead["born"]
            if r["group_ord"] % 3 == 2:
                for x in ("ColdGas", "HotGas"):
                    lead["HotGas"] += r[x]
                    lead["MetalsHotGas"] += r["Metals" + x]
                for x in ("EjectedMass", "ICS"):
                    lead[x] += r[x]
                    lead["Metals" + x] += r["Metals" + x]
                lead["ICS"] += r["StellarMass"]
                lead["MetalsICS"] += r["MetalsStellarMass"]
                kinds[key] = M.DISRUPTED
            else:
                kinds[key] = merged(lead, r, lead["Vvir"], lead["Mvir"], 0.25, config)
        want |= {(r["fof_root"], r["group_ord"]): r for r in members}
    table = spark.createDataFrame(events, "file_nr int, tree_id int, fof_root int, group_ord int, target int, disrupts boolean")
    got = M.apply_events(frame(spark, rows), table, 0.25, config).collect()
    assert len(got) == len(rows) and set(kinds.values()) == {M.MINOR, M.MAJOR, M.DISRUPTED}
    for r in got:
        key = (r["fof_root"], r["group_ord"])
        for c in M.FIELDS:
            assert r[c] == pytest.approx(want[key][c], rel=1e-4, abs=1e-6), (c, key)
        assert (r["MergeStatus"], r["mergeType"], r["mergeIntoBorn"], r["mergeIntoSnapNum"]) == ((1, kinds[key], into[key], 5) if key in kinds else (0, 0, -1, -1))
