"""Reason codes: every rule is a column, failures are listed in rule order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def failed(condition: Column) -> Column:
    """A rule whose condition cannot be established does not pass silently."""
    return F.coalesce(condition, F.lit(True))


def reason_codes(rules: Sequence[Rule]) -> Column:
    """Codes of the rules whose failure condition holds, in the given order.

    Put together from arrays of one code or none: a filter over an array is not
    compiled, and neither are the rules inside it.
    """
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(F.lit(code))).otherwise(none) for code, cond in rules])


def first_reason(rules: Sequence[Rule]) -> Column:
    """Only the first failing code, or null."""
    chain = F.when(rules[0][1], F.lit(rules[0][0]))
    for code, cond in rules[1:]:
        chain = chain.when(cond, F.lit(code))
    return chain


def violations(df: DataFrame, key: Column, rules: Sequence[Rule], detail: Column | None = None) -> DataFrame:
    """One row per failed rule: (rule, key, detail)."""
    codes = reason_codes(rules)
    return df.select(
        F.explode(codes).alias("rule"),
        key.cast("string").alias("key"),
        (detail.cast("string") if detail is not None else F.lit("")).alias("detail"),
    )


def duplicated(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """One violation per key that occurs more than once, with the count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            F.lit(rule).alias("rule"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            F.col("n").cast("string").alias("detail"),
        )
    )


def stacked(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def require_empty(found: DataFrame, what: str) -> None:
    """Refuse to go on when a check reported anything; shows a few rows."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
