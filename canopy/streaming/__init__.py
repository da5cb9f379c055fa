"""Catalogue statistics kept up to date while snapshots arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.histogram import bin_of


def running_histogram(stream: DataFrame, value: Column, low: float, high: float, n: int, by: list[str]) -> DataFrame:
    """Counts by (by, bin) of a stream, for complete or update output; state is one row a bin and group."""
    return stream.select(*by, bin_of(value, F.lit(low), F.lit(high), F.lit(n)).alias("bin")).filter("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
