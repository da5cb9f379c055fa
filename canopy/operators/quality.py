"""Data-quality checks: counts of bad values for each column in one pass, and catalogue comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.schema import REGISTRY, Property

_REAL = (T.FloatType, T.DoubleType)


def _numbers(df: DataFrame) -> list[tuple[str, str, Column]]:
    """(column, label, expression) of every number; vectors by component."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out.append((f.name, f.name, F.col(f.name).cast("double")))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            out += [(f.name, f"{f.name}[{i}]", F.get(f.name, F.lit(i)).cast("double")) for i in range(3)]
    return out


def profile(df: DataFrame, registry: dict[str, Property] | None = None) -> DataFrame:
    """(column, n_nan, n_inf, n_zero, n_out): NaN, infinite, zero and out-of-range values; sentinels are in range and no zeros."""
    registry = REGISTRY if registry is None else registry

    def count(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")

    totals = []
    for name, label, x in _numbers(df):
        p = registry.get(name)
        special = x.isin(*[float(s) for s in p.sentinels]) if p and p.sentinels else F.lit(False)
        off = (x < p.valid[0]) | (x > p.valid[1]) if p and p.valid else F.lit(False)
        totals.append(F.struct(F.lit(label).alias("column"), count(F.isnan(x)).alias("n_nan"), count(F.abs(x) == float("inf")).alias("n_inf"), count((x == 0) & ~special).alias("n_zero"), count(off & ~special & ~F.isnan(x)).alias("n_out")))
    return df.agg(F.array(*totals).alias("_all")).select(F.explode("_all").alias("_x")).select("_x.*")


def examples(df: DataFrame, bad: Column, key: list[str], n: int = 5) -> DataFrame:
    """The first n offending rows by key."""
    return df.filter(bad).orderBy(*key).limit(n)


def compare(a: DataFrame, b: DataFrame, key: list[str], rtol: float = 1e-6) -> DataFrame:
    """(column, n_different, n_missing): values that differ (numbers by rtol, others exactly), and rows that only one side has.

    Rows meet by key and their order among equal keys, since an index alone may repeat.
    """
    common = [c for c in a.columns if c in set(b.columns) and c not in key]
    order = Window.partitionBy(*key).orderBy(*common)
    x = a.withColumn("_k", F.row_number().over(order)).select(*key, "_k", F.struct(*common).alias("_a"))
    y = b.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*common))).select(*key, "_k", F.struct(*common).alias("_b"))
    both = x.join(y, [*key, "_k"], "full")
    missing = F.sum(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1).otherwise(0))
    out = []
    for c in common:
        p, q = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        same = p.eqNullSafe(q)
        if isinstance(a.schema[c].dataType, _REAL):
            same = same | (F.abs(p - q) <= rtol * F.abs(q))
        differs = F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.coalesce(same, F.lit(False))
        out.append(F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(F.when(differs, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_different"), F.coalesce(missing, F.lit(0)).cast("long").alias("n_missing")))
    return both.agg(F.array(*out).alias("_all")).select(F.explode("_all").alias("_x")).select("_x.*")
