"""Integer minor-unit arithmetic, roundings and order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward +infinity (also for negatives)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def round_dp(x: Column, places: int) -> Column:
    """Fixed decimal places with halves toward +infinity, as a double."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def basis_points(change: Column, prior: Column) -> Column:
    """Change over prior in basis points, exact, halves away from zero.

    Decimal operands keep the product exact beyond 64 bits.
    """
    num = F.abs(change).cast("decimal(24,0)") * F.lit(20000).cast("decimal(6,0)")
    den = prior.cast("decimal(20,0)")
    magnitude = F.floor((num + den) / (den * F.lit(2).cast("decimal(1,0)"))).cast("long")
    return F.when(change < 0, -magnitude).otherwise(magnitude)


def permille(part: Column, whole: Column) -> Column:
    """Ratio in thousandths, halves toward +infinity."""
    return half_up(part.cast("double") * F.lit(1000.0) / whole.cast("double"))


def mean_minor(x: str) -> Column:
    """Mean of integers rounded half-up, exact at any count; partial sums combine before the shuffle.

    (2 sum + n) div 2n: what does not divide is taken off first, so that the
    decimal quotient is a whole number and loses no digit.
    """
    count = F.count(x).cast("decimal(19,0)")
    twice = (count * F.lit(2).cast("decimal(1,0)")).cast("decimal(20,0)")
    total = F.sum(F.col(x).cast("decimal(20,0)")) * F.lit(2).cast("decimal(1,0)") + count
    return ((total - F.pmod(total, twice)) / twice).cast("long")


def direction(change: Column) -> Column:
    return F.when(change < 0, F.lit("down")).when(change > 0, F.lit("up")).otherwise(F.lit("flat"))


def count_values(df: DataFrame, keys: Sequence[str], value: str, *extra: Column) -> DataFrame:
    """Rows per (keys, value). A hot group spreads over its distinct values here."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("value_count"), *extra)


def median_by_rank(counted: DataFrame, keys: Sequence[str], value: str, weight: str, alias: str, *extra: Column) -> DataFrame:
    """Exact half-up median of counted integers, by running rank.

    `counted` has one row per (keys, value). Ranking sorts distinct values and
    spills, so no group is ever held as a map in memory; integers stay integers.
    """
    group = Window.partitionBy(*keys)
    running = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({
        "rank_upto": F.sum(weight).over(running),
        "rank_total": F.sum(weight).over(group),
    })
    here = F.col(weight) > 0
    lower = F.min(F.when(here & (F.col("rank_upto") * 2 >= F.col("rank_total")), F.col(value)))
    upper = F.min(F.when(here & (F.col("rank_upto") * 2 > F.col("rank_total")), F.col(value)))
    # Arithmetic shift is floor division by two.
    return (
        ranked.groupBy(*keys)
        .agg(lower.alias("rank_lower"), upper.alias("rank_upper"), *extra)
        .withColumn(alias, F.shiftright(F.col("rank_lower") + F.col("rank_upper") + 1, 1))
        .drop("rank_lower", "rank_upper")
    )


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """Exact half-up median per group; rows fold to (keys, value, count) map-side first."""
    counted = count_values(df.where(F.col(value).isNotNull()), keys, value)
    return median_by_rank(counted, keys, value, "value_count", alias)


def format_gbp(minor: Column) -> Column:
    """123456 -> '£1,234.56', exact for the whole integer range."""
    pounds = F.format_number((F.abs(minor) - F.abs(minor) % 100) / 100, 0)
    pence = F.lpad((F.abs(minor) % 100).cast("string"), 2, "0")
    return F.concat(F.when(minor < 0, F.lit("-")).otherwise(F.lit("")), F.lit("£"), pounds, F.lit("."), pence)


def format_signed_percent(bp: Column) -> Column:
    """Basis points as a signed two-decimal percentage."""
    sign = F.when(bp > 0, F.lit("+")).when(bp < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(F.abs(bp) / 100).cast("long").cast("string")
    return F.concat(sign, whole, F.lit("."), F.lpad((F.abs(bp) % 100).cast("string"), 2, "0"), F.lit("%"))


def format_index(milli: Column) -> Column:
    """Index level in thousandths to one decimal place."""
    return F.format_string("%.1f", milli.cast("double") / 1000)
