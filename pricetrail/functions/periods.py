"""Calendar buckets. Periods are dates internally and text on output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(ts: Column) -> Column:
    return F.trunc(ts, "month")


def quarter_of(ts: Column) -> Column:
    return F.trunc(ts, "quarter")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_label(day: Column, separator: str = "") -> Column:
    """'2024Q1', or '2024-Q1' with separator='-'."""
    return F.concat(F.year(day).cast("string"), F.lit(f"{separator}Q"), F.quarter(day).cast("string"))


def quarter_end(day: Column) -> Column:
    """Exclusive upper bound of the quarter that starts on `day`."""
    return F.add_months(day, 3)


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def month_offset(month: Column, first: Column) -> Column:
    """Whole months from `first` to `month`, both 'YYYY-MM' text."""
    def number(m: Column) -> Column:
        return F.substring(m, 1, 4).cast("long") * 12 + F.substring(m, 6, 2).cast("long")

    return number(month) - number(first)


def month_span(first: Column, last: Column) -> Column:
    return month_offset(last, first) + 1


def london_date(ts: Column) -> Column:
    """Calendar day in London of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, "Europe/London"))


def instant_text(ts: Column) -> Column:
    """Whole-second UTC text form."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def valid_instant(text: Column) -> Column:
    """Fixed-width UTC text that is also a real instant."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.coalesce(shaped & parsed.isNotNull(), F.lit(False))


def period_spine(bounds: DataFrame, first: str, last: str, months: int, alias: str = "period") -> DataFrame:
    """Every period start between the two dates of a one-row (or per-key) table."""
    step = F.expr(f"INTERVAL {months} MONTH")
    return bounds.withColumn(alias, F.explode(F.sequence(F.col(first), F.col(last), step))).drop(first, last)
