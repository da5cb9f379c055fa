"""The module registry: named physics transforms, their parameters, and pipelines of them in a chosen order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from canopy.operators import physics as P
from canopy.sources.tables import module_order
from canopy.storage import store

Transform = Callable[..., DataFrame]


@dataclass(frozen=True)
class Parameter:
    """argument: of the transform; empty for a setting that is read elsewhere."""

    argument: str
    default: float | int | str
    low: float = float("-inf")
    high: float = float("inf")

    def read(self, text: object) -> float | int | bool | str:
        """The value of a setting: a whole string must parse, and lie in range."""
        if isinstance(self.default, str):
            return str(text)
        value = type(self.default)(float(text)) if not isinstance(self.default, bool) else bool(int(float(text)))
        if not self.low <= value <= self.high:
            raise ValueError(f"{self.argument} = {value} lies outside [{self.low}, {self.high}]")
        return value


@dataclass(frozen=True)
class Module:
    name: str
    section: str
    transform: Transform
    parameters: dict[str, Parameter] = field(default_factory=dict)
    requires: frozenset[str] = frozenset()
    needs_cooling_tables: bool = False
    #: Called with the context before a run and after it.
    init: Callable[[P.Context], None] | None = None
    cleanup: Callable[[P.Context], None] | None = None


_REGISTRY: dict[str, Module] = {}


def register(module: Module) -> Module:
    if module.name in _REGISTRY or len(_REGISTRY) >= 32:
        raise ValueError(f"module {module.name}: the name is taken, or there are 32 modules already")
    _REGISTRY[module.name] = module
    return module


def registered() -> dict[str, Module]:
    return dict(_REGISTRY)


register(Module("sage_infall", "SageInfall", P.infall, {
    "BaryonFrac": Parameter("fraction", 0.17, 0, 1), "ReionizationOn": Parameter("reionization", True), "Reionization_z0": Parameter("z0", 8.0, 0), "Reionization_zr": Parameter("zr", 7.0, 0), "StrippingSteps": Parameter("steps", 10.0, 1)}))
register(Module("sage_cooling", "SageCooling", P.cooling, {"RadioModeEfficiency": Parameter("efficiency", 0.01, 0), "AGNrecipeOn": Parameter("agn", 1, 0, 3), "CoolFunctionsDir": Parameter("", "")}, frozenset({"sage_infall"}), needs_cooling_tables=True))
register(Module("sage_starformation_feedback", "SageStarformationFeedback", P.star_formation, {
    "SfrEfficiency": Parameter("efficiency", 0.02, 0, 1), "SupernovaRecipeOn": Parameter("supernovae", True), "FeedbackReheatingEpsilon": Parameter("reheating", 3.0, 0), "FeedbackEjectionEfficiency": Parameter("ejection", 0.3, 0),
    "EnergySNcode": Parameter("energy", 1.0, 0), "EtaSNcode": Parameter("eta", 0.5, 0), "RecycleFraction": Parameter("recycled", 0.43, 0, 1), "Yield": Parameter("metal_yield", 0.03, 0, 1), "FracZleaveDisk": Parameter("leave", 0.3, 0, 1),
    "SFprescription": Parameter("prescription", 0, 0, 0), "DiskInstabilityOn": Parameter("instability", False)}, frozenset({"sage_cooling"})))
register(Module("sage_reincorporation", "SageReincorporation", P.reincorporation, {"ReIncorporationFactor": Parameter("factor", 1.0, 0)}, frozenset({"sage_starformation_feedback"})))
register(Module("sage_disk_instability", "SageDiskInstability", P.disk_instability, {"DiskRadiusFactor": Parameter("factor", 3.0, 1, 10), "DiskInstabilityOn": Parameter("enabled", True)}, frozenset({"sage_starformation_feedback"})))
register(Module("sage_mergers", "SageMergers", P.mergers, {
    "BlackHoleGrowthRate": Parameter("growth", 0.01, 0), "QuasarModeEfficiency": Parameter("wind", 0.001, 0), "ThreshMajorMerger": Parameter("major", 0.3, 0, 1), "RecycleFraction": Parameter("recycled", 0.43, 0, 1),
    "Yield": Parameter("metal_yield", 0.03, 0, 1), "FracZleaveDisk": Parameter("leave", 0.3, 0, 1), "FeedbackReheatingEpsilon": Parameter("reheating", 3.0, 0), "FeedbackEjectionEfficiency": Parameter("ejection", 0.3, 0),
    "AGNrecipeOn": Parameter("agn", True), "SupernovaRecipeOn": Parameter("supernovae", True), "DiskInstabilityOn": Parameter("instability", False)}))
register(Module("simple_cooling", "SimpleCooling", P.simple_cooling, {"BaryonFraction": Parameter("fraction", 0.15, 0, 1)}))
register(Module("simple_sfr", "SimpleSFR", P.simple_star_formation, {"Efficiency": Parameter("efficiency", 0.02, 0, 1)}, frozenset({"simple_cooling"})))
register(Module("test_fixture", "TestFixture", P.mark, {"DummyParameter": Parameter("value", 1.0), "EnableLogging": Parameter("", 0)}))


def build_order() -> list[str]:
    """All modules so that each comes after those it needs."""
    return module_order({m.name: set(m.requires) for m in _REGISTRY.values()})


def pipeline(enabled: list[str], ctx: P.Context) -> Callable[[DataFrame], DataFrame]:
    """The enabled modules in the given order, at one redshift a call; unknown names and parameters are errors."""
    unknown = [n for n in enabled if n not in _REGISTRY]
    if unknown:
        raise ValueError(f"unknown modules {unknown}; there are {sorted(_REGISTRY)}")
    steps = []
    for name in enabled:
        m = _REGISTRY[name]
        given = ctx.parameters.get(m.section, {})
        odd = set(given) - set(m.parameters)
        if odd:
            raise ValueError(f"{m.section}: unknown parameters {sorted(odd)}")
        read = {m.parameters[k].argument: m.parameters[k].read(v) for k, v in given.items()}
        steps.append((m, {k: v for k, v in read.items() if k}))
    if any(m.needs_cooling_tables for m, _ in steps) and not ctx.cooling_tables:
        raise ValueError("cooling needs the cooling tables: set CoolFunctionsDir")

    def run(df: DataFrame, redshift: float | None = None) -> DataFrame:
        own = ctx if redshift is None else replace(ctx, redshift=redshift)
        for k, (m, arguments) in enumerate(steps):
            df = m.transform(df, own, **arguments)
            if ctx.store_between and k + 1 < len(steps):
                df = store(df, m.name)
        return df

    return run


@contextmanager
def running(enabled: list[str], ctx: P.Context) -> Iterator[Callable[..., DataFrame]]:
    """The pipeline of modules that were set up in order; they are cleaned up in reverse, whatever happens."""
    run = pipeline(enabled, ctx)
    ready: list[Module] = []
    try:
        for name in enabled:
            m = _REGISTRY[name]
            if m.init:
                m.init(ctx)
            ready.append(m)
        yield run
    finally:
        for m in reversed(ready):
            if m.cleanup:
                m.cleanup(ctx)
