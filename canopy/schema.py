"""The property registry: one declaration of each property, from which schemas, defaults, output and checks derive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "vec3": T.ArrayType(T.FloatType(), False)}
_NUMPY = {"int": "i4", "long": "i8", "float": "f4", "double": "f8", "vec3": "3f4"}


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    units: str = "dimensionless"
    default: float | None = None
    output: bool = True
    valid: tuple[float, float] | None = None
    #: Values that stand for "none" and are not checked against the range.
    sentinels: tuple[float, ...] = ()

    @property
    def spark_type(self) -> T.DataType:
        return _TYPES[self.type]


_MASS = "1e10 Msun/h"

#: Properties of a tracked object that come from its halo.
HALO = [
    Property("SnapNum", "int", valid=(0, 1000)),
    Property("Type", "int", default=0, valid=(0, 2)),
    Property("HaloIndex", "long"),
    Property("CentralHaloIndex", "long"),
    Property("ModelHaloIndex", "int"),
    Property("ModelTreeIndex", "int"),
    Property("SimulationHaloIndex", "long"),
    Property("MergeStatus", "int", default=0, valid=(0, 1)),
    Property("mergeType", "int", default=0, valid=(0, 4)),
    Property("mergeIntoID", "int", default=-1, valid=(0, 100000), sentinels=(-1,)),
    Property("mergeIntoSnapNum", "int", default=-1, valid=(0, 1000), sentinels=(-1,)),
    Property("dT", "float", "Myr", default=-1.0, valid=(0.0, 2000.0), sentinels=(-1.0,)),
    Property("Pos", "vec3", "Mpc/h", valid=(0.0, 100.0)),
    Property("Vel", "vec3", "km/s", valid=(-5000.0, 5000.0)),
    Property("Spin", "vec3", valid=(-20.0, 20.0)),
    Property("Len", "int", "particles", valid=(20, 1e9)),
    Property("Mvir", "float", _MASS, valid=(1e-5, 1e4)),
    Property("CentralMvir", "float", _MASS),
    Property("Rvir", "float", "Mpc/h"),
    Property("Vvir", "float", "km/s"),
    Property("Vmax", "float", "km/s"),
    Property("VelDisp", "float", "km/s"),
    Property("infallMvir", "float", _MASS, default=-1.0),
    Property("infallVvir", "float", "km/s", default=-1.0),
    Property("infallVmax", "float", "km/s", default=-1.0),
]
#: Baryonic properties; all start at 0.
GALAXY = [Property(n, "double" if n in ("Cooling", "Heating") else "float", _MASS, default=0.0) for n in (
    "ColdGas", "StellarMass", "HotGas", "MetalsHotGas", "MetalsColdGas", "EjectedMass", "MetalsEjectedMass", "ICS", "MetalsICS", "BlackHoleMass",
    "Cooling", "Heating", "r_heat", "MetalsStellarMass", "BulgeMass", "MetalsBulgeMass", "QuasarModeBHaccretionMass",
    "TimeOfLastMajorMerger", "TimeOfLastMinorMerger", "DiskScaleRadius", "OutflowRate",
)]
#: Kept while objects are evolved, not written.
INTERNAL = [
    Property("HaloNr", "int", output=False),
    Property("MostBoundID", "long", output=False),
    Property("deltaMvir", "float", _MASS, default=0.0, output=False),
    Property("MergTime", "float", default=999.9, output=False),
    Property("TotalSatelliteBaryons", "float", _MASS, default=0.0, output=False),
    Property("TestDummyProperty", "float", default=0.0, output=False),
]
REGISTRY = {p.name: p for p in [*HALO, *GALAXY, *INTERNAL]}

#: The record of a tree file, in order.
TREE = [
    ("Descendant", "int"), ("FirstProgenitor", "int"), ("NextProgenitor", "int"), ("FirstHaloInFOFgroup", "int"), ("NextHaloInFOFgroup", "int"),
    ("Len", "int"), ("M_Mean200", "float"), ("Mvir", "float"), ("M_TopHat", "float"), ("Pos", "vec3"), ("Vel", "vec3"), ("VelDisp", "float"),
    ("Vmax", "float"), ("Spin", "vec3"), ("MostBoundID", "long"), ("SnapNum", "int"), ("FileNr", "int"), ("SubhaloIndex", "int"), ("SubHalfMass", "float"),
]


def tree_schema() -> T.StructType:
    own = [T.StructField("file_nr", T.IntegerType()), T.StructField("tree_id", T.IntegerType()), T.StructField("halo_nr", T.IntegerType())]
    return T.StructType(own + [T.StructField(n, _TYPES[t]) for n, t in TREE])


def output_schema() -> T.StructType:
    return T.StructType([T.StructField(p.name, p.spark_type, metadata={"units": p.units}) for p in [*HALO, *GALAXY]])


def numpy_record(fields: list[tuple[str, str]], order: str = "<") -> list[tuple]:
    """A NumPy record description of the fields in a byte order."""
    out: list[tuple] = []
    for name, kind in fields:
        code = _NUMPY[kind]
        out.append((name, order + code[1:], 3) if code[0] == "3" else (name, order + code))
    return out


def output_record(order: str = "<") -> list[tuple]:
    return numpy_record([(p.name, p.type) for p in [*HALO, *GALAXY]], order)
