"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import free_name, materialise

#: Rows of one source that the last, row-by-row step looks at, about.
BUCKET_ROWS = 256
#: Digits of the draw key that one step of the search for the cut looks at: 16**2 sums a source.
DIGITS = 2


def draw_key(seed: int, *ids: Column) -> Column:
    """The order in which a source's rows are drawn: an md5 of the seed and what identifies a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in ids]).cast("binary"))


def fill_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size) -> also target and capped.

    Weights go round the sources by code point, null last.  The target of a
    source is level * weight, or max_epochs times its size where that is less;
    the level solves sum(targets) = share * all sizes.  Sorted by cap / weight,
    the capped sources are a prefix: the first source whose cap lies above the
    level that the caps before it leave ends it.  That is where proportional
    resharing of the excess stops, found without iterating.
    """
    # These windows see one row a source.
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    out = (
        sizes.withColumn("_weight", weight)
        .withColumn("_ratio", cap / F.col("_weight"))
        .withColumn("_level", left / weights_left)
        .withColumn("_k", F.row_number().over(by_ratio))
        .withColumn("_first", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_k", "_level"))).over(everything))
    )
    capped = F.col("_first").isNull() | (F.col("_k") < F.col("_first._k"))
    target = F.when(capped, cap.cast("double")).otherwise(F.col("_first._level") * F.col("_weight"))
    return out.select("source", "source_size", target.alias("target"), capped.alias("capped"))


def plan_mix(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """What each source gives: rows of (source, size, draw) -> (source, source_size, target, whole, until, rest, tied).

    Every row is taken ``whole`` times; rows drawn before ``until`` once more, and
    the rows at ``until`` share ``rest`` of their ``tied`` words.  The draw order
    is cut by sums over key prefixes that grow by ``DIGITS`` digits a step, each
    within the one prefix where the target is reached, and at last row by row: no
    step orders more than some hundred sums a source, whatever its rows.
    """
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n / BUCKET_ROWS, 1), 16)))
    filled = fill_targets(stats.select("source", "source_size"), weights, share, max_epochs)
    whole = F.when(F.col("capped"), F.lit(max_epochs)).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = filled.withColumn("whole", whole).withColumn("_more", F.when(F.col("capped"), F.lit(0)).otherwise(F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))

    def reached(sums: DataFrame, key: str, need: DataFrame) -> DataFrame:
        """(source, key, _sum) and what a source needs -> the first key where the running sum reaches it, and what it lacks before."""
        run = Window.partitionBy("source").orderBy(key)
        with_sum = sums.withColumn("_upto", F.sum("_sum").over(run))
        both = with_sum.join(F.broadcast(need.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
        hit = both.filter((F.col("_more") > 0) & (F.col("_upto") >= F.col("_more")) & (F.col("_upto") - F.col("_sum") < F.col("_more")))
        return hit.select("source", key, (F.col("_more") - F.col("_upto") + F.col("_sum")).alias("_more"), "_sum")

    # The tables of one row a source are broadcast: a mix names its sources, so they are few whatever the rows.
    sums = rows.groupBy("source", F.substring("draw", 1, digits).alias("_prefix")).agg(F.sum("size").alias("_sum"))
    sums = materialise(sums, "prefixes") if digits > DIGITS else sums
    cut = plan.select("source", "_more").withColumn("_key", F.lit(""))
    for depth in [*range(DIGITS, digits, DIGITS), digits]:
        of, at = cut.select(F.col("source").alias("_s2"), F.col("_key").alias("_p2")), F.substring("_prefix", 1, depth)
        inside = sums.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("_s2")) & F.col("_prefix").startswith(F.col("_p2")))
        cut = reached(inside.groupBy("source", at.alias("_key")).agg(F.sum("_sum").alias("_sum")), "_key", cut.select("source", "_more"))
        cut = materialise(cut, "cut") if depth < digits else cut
    of = cut.select(F.col("source").alias("_s2"), F.col("_key").alias("_p2"))
    inside = rows.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("_s2")) & (F.substring("draw", 1, digits) == F.col("_p2")))
    last = reached(inside.groupBy("source", "draw").agg(F.sum("size").alias("_sum")), "draw", cut.select("source", "_more"))
    last = last.select(F.col("source").alias("_s3"), F.col("draw").alias("until"), F.col("_more").alias("rest"), F.col("_sum").alias("tied"))
    return plan.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("_s3")), "left").select("source", "source_size", "target", "whole", "until", "rest", "tied")


def apply_mix(df: DataFrame, plan: DataFrame, source: Column, size: Column, draw: Column, prefix: str = "mix") -> DataFrame:
    """df with mix_target, mix_source_size, mix_copies (whole repetitions) and mix_part (words of one more, partial, repetition).

    Sizes of 0 take nothing.  Rows with one draw key (a repeated id) share the
    remainder in proportion to size.  A null source is a source of its own.
    Columns of df that are called like the new ones, which begin with ``prefix``,
    are replaced.
    """
    df = df.drop(*[f"{prefix}_{x}" for x in ("target", "source_size", "copies", "part")])
    p = {c: free_name(df, f"_mix_{c}") for c in [*plan.columns, "key", "size", "draw"]}
    joined = df.withColumns({p["key"]: source, p["size"]: size, p["draw"]: draw}).join(
        F.broadcast(plan.toDF(*[p[c] for c in plan.columns])), F.col(p["key"]).eqNullSafe(F.col(p["source"])), "left"
    )
    before = F.coalesce(F.col(p["draw"]) < F.col(p["until"]), F.lit(False))
    at = F.coalesce(F.col(p["draw"]) == F.col(p["until"]), F.lit(False))
    full = at & (F.col(p["rest"]) == F.col(p["tied"]))
    part = F.when(at & ~full, F.call_function("div", F.col(p["size"]) * F.col(p["rest"]), F.col(p["tied"]))).otherwise(F.lit(0)).cast("long")
    return joined.select(
        *df.columns, F.col(p["source_size"]).alias(f"{prefix}_source_size"), F.col(p["target"]).alias(f"{prefix}_target"), (F.col(p["whole"]) + (before | full).cast("long")).alias(f"{prefix}_copies"), part.alias(f"{prefix}_part")
    )
