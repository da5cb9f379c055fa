import math

import pytest
from pyspark.sql import functions as F

from canopy.functions import galaxy as G
from canopy.functions import numeric as N
from canopy.operators.histogram import edges
from canopy.units import Cosmology


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_units_and_lookback_times():
    c = Cosmology()
    u = c.units
    assert u.time_myr == pytest.approx(978028.526149)
    assert (u.gravity, u.hubble, u.critical_density) == pytest.approx((43.0070778564, 100.000066362, 27.7550514229))
    assert c.lookback(1 / 0.0078125 - 1) == pytest.approx(0.0101287327784)
    assert c.lookback(1 / 0.980457 - 1) == pytest.approx(1.96625365879e-4, rel=1e-8)


def test_guarded_division_and_slack(spark):
    nan = F.lit(float("nan"))
    assert value(spark, N.safe_div(F.lit(1.0), F.lit(1e-11), 7)) == 7
    assert value(spark, N.safe_div(nan, F.lit(1.0), 7)) == 7
    assert value(spark, N.safe_div(F.lit(6.0), F.lit(3.0))) == 2
    assert not value(spark, N.is_equal(nan, nan)) and not value(spark, N.is_zero(nan)) and not value(spark, N.is_greater(nan, F.lit(1.0)))
    assert value(spark, N.is_equal(F.lit(float("inf")), F.lit(float("inf"))))


def test_halo_formulas(spark):
    c = Cosmology()
    r = value(spark, G.virial_radius(F.lit(100.0), F.lit(c.critical_density(0))))
    assert r == pytest.approx(0.162622182855)
    assert value(spark, G.virial_velocity(F.lit(100.0), F.lit(r), c.units.gravity)) == pytest.approx(162.622290774)
    assert value(spark, G.virial_mass(F.lit(False), F.lit(3.0), F.lit(500), 0.1)) == pytest.approx(50)
    spin = F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0))
    assert value(spark, G.norm(spin)) == 5
    assert value(spark, G.spin_parameter(F.lit(10.0), F.lit(100.0), F.lit(0.2))) == pytest.approx(0.353553, abs=1e-6)
    assert [value(spark, G.disk_radius(G.norm(spin), F.lit(v), F.lit(r))) for v, r in ((100.0, 0.2), (0.0, 0.2), (100.0, 0.0))] == pytest.approx([0.025, 0.02, 0])
    assert [value(spark, G.metallicity(F.lit(g), F.lit(m))) for g, m in ((100.0, 2.0), (100.0, 0.2), (1e-12, 1.0), (-1.0, 1.0))] == pytest.approx([0.02, 0.002, 0, 0])


def test_reionization_in_both_forms(spark):
    c = Cosmology()
    right = G.Reionization(form="corrected")
    got = [value(spark, right.modifier(F.lit(m), F.lit(right.scale_mass(z, c)))) for m, z in ((100.0, 0), (1.0, 0), (1.0, 3), (1.0, 7.5), (1.0, 10))]
    assert got == pytest.approx([0.9749581, 0.1582084, 0.54971297, 0.98333559, 0.99513486], rel=1e-6)
    kept = G.Reionization()
    assert value(spark, kept.modifier(F.lit(100.0), F.lit(kept.scale_mass(0, c)))) == pytest.approx(5.7337824e-34)


def test_cooling_rate_interpolates_clamps_and_extrapolates(spark):
    tables = [[-24.0 + i + t / 10 for t in range(G.LOG_T_ROWS)] for i in range(8)]
    solar = math.log10(0.02)
    grid = [d + solar for d in G.COOLING_DEX]

    def rate(t, z):
        return math.log10(value(spark, G.cooling_rate(F.lit(t), F.lit(z), tables)))

    assert rate(4.0, grid[0]) == pytest.approx(-24)
    assert rate(4.025, (grid[1] + grid[2]) / 2) == pytest.approx(-24 + 1.5 + 0.05)
    assert rate(3.0, -99.0) == pytest.approx(-24)
    assert rate(9.0, 99.0) == pytest.approx(-24 + 7 + 10)


def test_edges_are_those_of_arange():
    assert [len(edges(*a)) for a in ((10, 15, 0.2), (9.5, 12, 0.1), (11, 16, 0.1))] == [25, 25, 50]
