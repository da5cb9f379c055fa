"""Sharding by a Feistel permutation over global row numbers, in DataFrame functions only.

Rows are numbered 0..n-1 in the order of chosen columns.  A six-round Feistel
network over a grid of ``a * b >= n`` cells with ``a*b - n < a`` permutes the
numbers; cycle walking keeps it inside 0..n-1.  The permuted number ``p`` gives
shard ``p % shards`` and slot ``p div shards``: counts differ by at most one,
slots have no gaps, and both can be computed for any row number without data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import free_name, materialise

ROUNDS = 6
#: A grid leaves fewer than ``a`` cells outside, so walks longer than this have
#: odds below a**-WALK; up to WALK rows a side every walk ends for certain.
WALK = 32


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, -(-max(n, 1) // a)


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _noise(value: Column, seed: int, k: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed * 1000 + k).cast("long")), F.lit(modulus).cast("long"))


def _network(x: Column, n: int, seed: int, inverse: bool) -> Column:
    a, b = (F.lit(v).cast("long") for v in _grid(n))
    na, nb = _grid(n)
    left, right = _div(x, b), x % b
    for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        sign = -1 if inverse else 1
        if k % 2:
            right = F.pmod(right + sign * _noise(left, seed, k, nb), b)
        else:
            left = F.pmod(left + sign * _noise(right, seed, k, na), a)
    return left * b + right


def permute(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The place of row number x in a pseudo-random order of 0..n-1, or with ``inverse`` the row number at a place."""
    once = _network(x, n, seed, inverse)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        once,
        lambda at, _: F.when(at < n, at).otherwise(_network(at, n, seed, inverse)),
    )
    inside = F.when(once < n, once).otherwise(walked)
    return F.when(inside < n, inside).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, order_by: list[str], into: str) -> tuple[DataFrame, int]:
    """df with a global row number 0..n-1 in the order of ``order_by``, and n.

    The rows are range-partitioned, sorted and stored once; a row's number is its
    place in its stored partition plus the rows of all partitions before, so no
    task ever holds more than its share.  Rows that tie are spread by an extra
    key and numbered in any order: they should be alike in all that is used.
    """
    spread, place = free_name(df, "_spread"), free_name(df, "_place")
    keys = [*order_by, spread]
    stored = materialise(
        df.withColumn(spread, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*df.columns, F.monotonically_increasing_id().alias(place)),
        "numbered",
    )
    part = F.shiftright(F.col(place), 33)
    # One row for each partition of the stored table: bounded by their number, whatever the rows.
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    own = stored.select(*[F.col(c) for c in df.columns], part.alias("_part_of"), F.col(place).bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    out = own.join(F.broadcast(offsets), own["_part_of"] == offsets["_part"])
    return out.select(*[own[c] for c in df.columns], (own["_at"] + offsets["_before"]).alias(into)), n


def shard_rows(df: DataFrame, order_by: list[str], shards: int, seed: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with a shard (0..shards-1) and a slot for each row, by law `rows`.

    The same rows in the same order columns get the same places, however they are
    partitioned.  Nulls sort first and are numbered like values; an empty table
    gives an empty result; repeated rows each get a place of their own.  Columns
    of df that are called like the new ones are replaced.
    """
    df = df.drop(shard, slot)
    number = free_name(df, "_number")
    numbered, n = number_rows(df, order_by, number)
    place = free_name(df, "_permuted")
    moved = numbered.withColumn(place, permute(F.col(number), max(n, 1), seed))
    at = F.col(place)
    return moved.select(*df.columns, (at % shards).cast("int").alias(shard), _div(at, F.lit(shards).cast("long")).alias(slot))
