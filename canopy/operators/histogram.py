"""Histograms with a closed right edge, over fixed or data-dependent ranges, empty bins included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(x: Column, low: Column, high: Column, n: Column) -> Column:
    """The bin of x among n of [low, high]: the right edge belongs to the last; null outside."""
    width = (high - low) / n
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / width), n.cast("long") - 1).cast("int"))


def digitize(x: Column, edges: list[float]) -> Column:
    """The left-closed bin of x between driver-side edges; null outside."""
    k = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.when((x >= edges[0]) & (x < edges[-1]), k)


def edges(start: float, stop: float, step: float) -> list[float]:
    """What an arange gives: start, start + step, ... below stop."""
    n = int(-((start - stop) // step))
    return [start + step * i for i in range(n)]


def fixed_histogram(df: DataFrame, value: Column, low: float, high: float, n: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, center, n): counts of every bin, zeros included, for each group that occurs."""
    by = by or []
    counted = df.select(*by, bin_of(value, F.lit(low), F.lit(high), F.lit(n)).alias("bin"))
    spine = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    counts = counted.filter("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    center = F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / n)
    return spine.join(counts, [*by, "bin"], "left").select(*by, "bin", center.alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def ranged_histogram(df: DataFrame, value: Column, width: float, margin: int, clamp: tuple[float, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, bin, center, n, width): the range runs from floor(min) - margin to floor(max) + margin, clamped.

    The range is a one-row aggregate for each group, joined back; nothing returns
    to the driver.  Without values there are no rows.
    """
    by = by or []
    rows = df.select(*by, value.alias("_x")).filter("_x is not null")
    low, high = F.floor(F.min("_x")) - margin, F.floor(F.max("_x")) + margin
    if clamp:
        low, high = F.greatest(low, F.lit(clamp[0])), F.least(high, F.lit(clamp[1]))
    span = rows.groupBy(*by).agg(low.cast("double").alias("_lo"), high.cast("double").alias("_hi"))
    span = span.withColumn("_bins", F.floor((F.col("_hi") - F.col("_lo")) / width).cast("int")).filter("_bins > 0")
    span = F.broadcast(span)  # a row for each group: a snapshot, or all
    counts = (rows.join(span, by) if by else rows.crossJoin(span)).select(*by, bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), F.col("_bins")).alias("bin"))
    counts = counts.filter("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
    actual = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    return spine.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * actual).alias("center"), F.coalesce("n", F.lit(0)).alias("n"), actual.alias("width"))


def volume_density(counts: DataFrame, volume: float, h: float, by: list[str] | None = None) -> DataFrame:
    """(by, bin, center, n, phi): counts per volume and dex."""
    return counts.select(*(by or []), "bin", "center", "n", (F.col("n") / volume * h**3 / F.col("width")).alias("phi"))
