"""Galaxy and halo formulas as column expressions: double arithmetic, narrowed where a property is stored."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions.numeric import SMALL, safe_div
from canopy.units import CM_PER_MPC, GRAVITY, SOLAR_MASS, Cosmology

# The metallicity grid of the cooling tables, in dex relative to solar, and the solar value.
COOLING_DEX = [-5.0, -3.0, -2.0, -1.5, -1.0, -0.5, 0.0, 0.5]
SOLAR_METALLICITY = 0.02
LOG_T_FIRST, LOG_T_STEP, LOG_T_ROWS = 4.0, 0.05, 91


def redshift(a: Column) -> Column:
    return 1 / a - 1


def virial_mass(is_root: Column, mvir: Column, length: Column, particle_mass: float) -> Column:
    """The catalogued mass of a group's root where it is not negative, else particles times their mass."""
    return F.when(is_root & (mvir >= 0), mvir.cast("double")).otherwise(length * F.lit(particle_mass))


def virial_radius(mass: Column, critical_density: Column) -> Column:
    """The radius in which the mean density is 200 times critical."""
    return F.cbrt(mass / (critical_density * (200 * 4 * math.pi / 3)))


def virial_velocity(mass: Column, radius: Column, gravity: float) -> Column:
    return F.when(radius > 0, F.sqrt(F.lit(gravity) * mass / radius)).otherwise(F.lit(0.0))


def metallicity(gas: Column, metals: Column) -> Column:
    """metals / gas, 0 where there is hardly any gas; not clamped."""
    return F.when(gas <= SMALL, F.lit(0.0)).otherwise(metals / F.when(gas <= SMALL, F.lit(1.0)).otherwise(gas))


def norm(v: Column, size: int = 3) -> Column:
    return F.sqrt(sum((F.element_at(v, i + 1).cast("double") ** 2 for i in range(size)), F.lit(0.0)))


def dot(v: Column, w: Column, size: int = 3) -> Column:
    return sum((F.element_at(v, i + 1).cast("double") * F.element_at(w, i + 1).cast("double") for i in range(size)), F.lit(0.0))


def spin_parameter(magnitude: Column, vvir: Column, rvir: Column) -> Column:
    degenerate = (vvir <= SMALL) | (rvir <= SMALL)
    return F.when(degenerate, F.lit(0.0)).otherwise(magnitude / F.when(degenerate, F.lit(1.0)).otherwise(1.414213562 * vvir * rvir))


def disk_radius(magnitude: Column, vvir: Column, rvir: Column) -> Column:
    """Scale radius of a disk from the halo's spin; a tenth of the radius where there is no velocity."""
    return F.when((vvir > SMALL) & (rvir > SMALL), spin_parameter(magnitude, vvir, rvir) / 1.414213562 * rvir).otherwise(0.1 * rvir)


def cooling_rate(log_t: Column, log_z: Column, tables: list[list[float]]) -> Column:
    """Bilinear in log temperature and log metallicity over the tables (one a grid metallicity), as a rate.

    Temperatures below the grid are clamped; above it the last interval goes on.
    Metallicities are clamped at both ends.
    """
    grid = [d + math.log10(SOLAR_METALLICITY) for d in COOLING_DEX]
    # The tables one after the other: the rate of metallicity i at temperature k is number i * LOG_T_ROWS + k.
    flat = F.array(*[F.lit(float(x)) for row in tables for x in row])
    zs = F.array(*[F.lit(g) for g in grid])
    z = F.greatest(F.lit(grid[0]), F.least(F.lit(grid[-1]), log_z))
    t = F.greatest(F.lit(LOG_T_FIRST), log_t)

    def place(x: Column) -> Column:
        """The interval of each coordinate."""
        k = F.least(F.floor((x["t"] - LOG_T_FIRST) / LOG_T_STEP), F.lit(LOG_T_ROWS - 2)).cast("int")
        i = sum((F.when(x["z"] > g, 1).otherwise(0) for g in grid[1:-1]), F.lit(0))
        return _once(F.struct(x["t"].alias("t"), x["z"].alias("z"), k.alias("k"), i.alias("i"), (i * LOG_T_ROWS + k + 1).alias("at")), blend)

    def blend(x: Column) -> Column:
        part = (x["t"] - LOG_T_FIRST - LOG_T_STEP * x["k"]) / LOG_T_STEP
        first, second = (F.element_at(flat, x["at"] + j) * (1 - part) + F.element_at(flat, x["at"] + j + 1) * part for j in (0, LOG_T_ROWS))
        z0, z1 = F.element_at(zs, x["i"] + 1), F.element_at(zs, x["i"] + 2)
        return F.pow(F.lit(10.0), first + (second - first) / (z1 - z0) * (x["z"] - z0))

    return _once(F.struct(t.alias("t"), z.alias("z")), place)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@dataclass(frozen=True)
class Reionization:
    """Suppression of infall by a photo-ionising background that rises between redshifts z0 and zr.

    ``form`` 'reference' keeps an inverted unit conversion of the characteristic
    mass, which suppresses infall almost wholly; 'corrected' converts as meant.
    """

    z0: float = 8.0
    zr: float = 7.0
    alpha: float = 6.0
    temperature: float = 1e4
    form: str = "reference"

    def filter_function(self, a: float) -> float:
        """The filtering mass's dependence on the scale factor, in three regimes."""
        a0, ar, k = 1 / (1 + self.z0), 1 / (1 + self.zr), self.alpha
        early = 1 / (2 + k)
        if a <= a0:
            return 3 * a * early / (5 + 2 * k) * (a / a0) ** k
        r0 = math.sqrt(a0 / a)
        onset = a0 * a0 * (early - 2 * r0 / (5 + 2 * k))
        risen = a0 * a0 / 10 * (5 - 4 * r0)
        if a < ar:
            return 3 / a * onset + a * a / 10 - risen
        rr = math.sqrt(ar / a)
        return 3 / a * (onset + ar * ar / 10 * (5 - 4 * rr) - risen + a * ar / 3 - ar * ar / 3 * (3 - 2 * rr))

    def scale_mass(self, z: float, c: Cosmology) -> float:
        """The larger of the filtering and the characteristic mass at z: a driver-side number for each snapshot."""
        jeans = 25.0 * c.omega**-0.5 * 2.21
        filtering = jeans * self.filter_function(1 / (1 + z)) ** 1.5
        v = math.sqrt(self.temperature / 36)
        matter = c.omega * (1 + z) ** 3
        x = matter / (matter + c.omega_lambda + (SMALL if self.form == "reference" else 0)) - 1
        overdensity = math.sqrt(0.5 * (18 * math.pi**2 + 82 * x - 39 * x * x))
        if self.form == "reference":
            g, h = GRAVITY * 1e-6 * CM_PER_MPC / SOLAR_MASS * 1e-10, 100 * c.hubble_h
            characteristic = v**3 / (g * h * math.sqrt(matter + c.omega_lambda) * overdensity + SMALL)
        else:
            characteristic = v**3 / (c.units.gravity * c.units.hubble * math.sqrt(matter + c.omega_lambda) * overdensity)
        return max(filtering, characteristic)

    def modifier(self, mvir: Column, scale_mass: Column) -> Column:
        return 1 / F.pow(1 + 0.26 * scale_mass / (mvir + SMALL), F.lit(3.0))


def merging_time(central_len: Column, sat_len: Column, radius: Column, velocity: Column, mass: Column, gravity: float = 43.0071) -> Column:
    """Dynamical friction time; -1 where it is undefined."""
    coulomb = F.log(safe_div(central_len.cast("double"), sat_len.cast("double"), 1.0) + 1)
    return safe_div(2 * 1.17 * radius * radius * velocity, coulomb * gravity * mass, -1.0)


def log_mass(mass: Column, h: float) -> Column:
    """log10 of a mass in solar masses; null where it is not positive."""
    return F.when(mass > 0, F.log10(mass * 1e10 / h))


def log_floor(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1.0)))


def log_metallicity(metals: Column, gas: Column) -> Column:
    return F.log10(metals / gas / SOLAR_METALLICITY) + 9


def specific_sfr(sfr: Column, stellar: Column, h: float, default: float = -15.0) -> Column:
    """log10 of star formation per stellar mass, or the default where either is not positive."""
    ok = (sfr > 0) & (stellar > 0)
    return F.when(ok, F.log10(F.when(ok, sfr / (stellar * 1e10 / h)))).otherwise(F.lit(default))


def schechter(log_m: Column, log_star: float, phi: float, alpha: float) -> Column:
    x = F.pow(F.lit(10.0), log_m - log_star)
    return phi * math.log(10) * F.pow(x, F.lit(alpha + 1)) * F.exp(-x)


def log_normal(x: Column, mean: float, sigma: float) -> Column:
    return F.exp(-(F.log(x / mean) ** 2) / (2 * sigma * sigma)) / (x * sigma * math.sqrt(2 * math.pi))


def mass_metallicity(log_m: Column) -> Column:
    """The quadratic mass-metallicity relation of star-forming galaxies."""
    return -1.492 + 1.847 * log_m - 0.08026 * log_m * log_m


def tully_fisher(log_v: Column) -> Column:
    return 3.94 * log_v + 1.79
