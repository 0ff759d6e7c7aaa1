"""Intervals, medians and ratios as expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's score interval of a proportion; (0, 0) without trials. The lower end isn't clamped."""
    k, n = k.cast("double"), n.cast("double")
    p, square = k / n, F.lit(z * z)
    scale = F.lit(1.0) + square / n
    centre = p + square / (n * 2.0)
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + square / (n * 4.0 * n))
    zero = F.lit(0.0)
    return F.when(n > 0, (centre - half) / scale).otherwise(zero), F.when(n > 0, (centre + half) / scale).otherwise(zero)


def ratio(k: Column, n: Column) -> Column:
    """k / n; null if n is 0."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def upper_median(name: str) -> Column:
    """The upper middle of a column's values: element n div 2 (from 0) in ascending order."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, mean_median, upper_median of the non-null values: a range sort numbers all rows, and of each group the middle ones are picked, so no task holds a group."""
    from cairnfield.operators.lookups import numbered

    placed = numbered(rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).filter("_v is not null"), [F.col("_g"), F.col("_v")])
    ends = placed.groupBy(F.col("_g").alias("_e")).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    near = placed.join(ends, F.col("_g").eqNullSafe(F.col("_e"))).select("_g", "_v", (F.col("_pos") - F.col("_first")).alias("_k"), "_n")
    picked = near.filter((F.col("_k") == F.floor(F.col("_n") / 2)) | (F.col("_k") == F.floor((F.col("_n") - 1) / 2)))
    return picked.groupBy(F.col("_g").alias(group)).agg(F.avg("_v").alias("mean_median"), F.max("_v").alias("upper_median"))


def percent(k: int, n: int, empty: str = "-") -> str:
    """k of n as a percentage of one decimal, ties away from zero on the exact value."""
    return f"{Decimal(100 * k / n).quantize(Decimal('0.1'), ROUND_HALF_UP)}%" if n else empty
