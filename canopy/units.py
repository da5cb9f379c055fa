"""Units, cosmology and quadrature: what is computed once on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

# Physical constants in cgs units.
GRAVITY = 6.672e-8
SOLAR_MASS = 1.989e33
PROTON_MASS = 1.6726e-24
BOLTZMANN = 1.3806e-16
HUBBLE = 3.2407789e-18
CM_PER_MPC = 3.085678e24
SEC_PER_MEGAYEAR = 3.155e13
SEC_PER_YEAR = 3.155e7


@dataclass(frozen=True)
class Units:
    """A system of length, mass and velocity units, and what follows from it."""

    length_cm: float = 3.08568e24
    mass_g: float = 1.989e43
    velocity_cm_s: float = 1e5

    @property
    def time_s(self) -> float:
        return self.length_cm / self.velocity_cm_s

    @property
    def time_myr(self) -> float:
        return self.time_s / SEC_PER_MEGAYEAR

    @property
    def gravity(self) -> float:
        return GRAVITY / self.length_cm**3 * self.mass_g * self.time_s**2

    @property
    def hubble(self) -> float:
        return HUBBLE * self.time_s

    @property
    def density_cgs(self) -> float:
        return self.mass_g / self.length_cm**3

    @property
    def pressure_cgs(self) -> float:
        return self.mass_g / self.length_cm / self.time_s**2

    @property
    def cooling_rate_cgs(self) -> float:
        return self.pressure_cgs / self.time_s

    @property
    def energy_cgs(self) -> float:
        return self.mass_g * self.length_cm**2 / self.time_s**2

    @property
    def critical_density(self) -> float:
        return 3 * self.hubble**2 / (8 * math.pi * self.gravity)


def adaptive_simpson(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-10, depth: int = 20) -> float:
    """Simpson's rule, halving an interval (and its tolerance) while the two estimates differ too much."""

    def rule(a: float, fa: float, b: float, fb: float) -> tuple[float, float, float]:
        m = (a + b) / 2
        fm = f(m)
        return m, fm, (b - a) / 6 * (fa + 4 * fm + fb)

    # An explicit stack: (interval, values, estimate, tolerance, depth left).
    fa, fb = f(a), f(b)
    total, todo = 0.0, [(a, fa, b, fb, *rule(a, fa, b, fb), tolerance, depth)]
    while todo:
        a, fa, b, fb, m, fm, whole, tol, left = todo.pop()
        low, high = rule(a, fa, m, fm), rule(m, fm, b, fb)
        off = low[2] + high[2] - whole
        if left <= 0 or abs(off) <= 15 * tol:
            total += low[2] + high[2] + off / 15
        else:
            todo += [(a, fa, m, fm, *low, tol / 2, left - 1), (m, fm, b, fb, *high, tol / 2, left - 1)]
    return total


@dataclass(frozen=True)
class Cosmology:
    """A background cosmology in given units."""

    omega: float = 0.25
    omega_lambda: float = 0.75
    hubble_h: float = 0.73
    units: Units = field(default_factory=Units)

    def lookback(self, z: float) -> float:
        """Time from redshift z to now, in code units."""

        def rate(a: float) -> float:
            return 1 / math.sqrt(self.omega / a + (1 - self.omega - self.omega_lambda) + self.omega_lambda * a * a)

        return adaptive_simpson(rate, 1 / (1 + z), 1.0) / self.units.hubble

    def hubble_squared(self, z: float) -> float:
        return self.units.hubble**2 * (self.omega * (1 + z) ** 3 + (1 - self.omega - self.omega_lambda) * (1 + z) ** 2 + self.omega_lambda)

    def critical_density(self, z: float) -> float:
        return 3 * self.hubble_squared(z) / (8 * math.pi * self.units.gravity)


def snapshot_table(scale_factors: list[float], cosmology: Cosmology | None = None) -> list[tuple[int, float, float, float]]:
    """(snap, a, z, age) for each scale factor; age is lookback time in code units."""
    c = cosmology or Cosmology()
    return [(k, a, 1 / a - 1, c.lookback(1 / a - 1)) for k, a in enumerate(scale_factors)]
