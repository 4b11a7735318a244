"""Per-product series, observed-price ranges and derived point sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions.money import count_values, grouped_median, half_up, median_by_rank
from pricetrail.functions.periods import (
    instant_text,
    month_label,
    month_of,
    month_offset,
    month_span,
    period_spine,
    quarter_end,
    quarter_label,
    quarter_of,
)


def month_contributors(obs: DataFrame) -> DataFrame:
    """One row per (product, month, seller): the seller's single vote.

    Tax-inclusive captures decide the vote when there are any; otherwise the
    seller stays visible as excluded. Captures are counted per distinct price
    before the seller groups form, so a much-captured seller arrives as its
    price histogram.
    """
    cmp = F.coalesce(F.col("vat_included"), F.lit(False)).alias("comparable")
    first = F.min(F.struct("observed_at", "observation_id", "vat_included")).alias("first_row")
    keys = ["mpn", "month", "seller"]
    counted = count_values(
        obs.select(
            "mpn", month_of(F.col("observed_at")).alias("month"), "seller", cmp, "amount_minor",
            "observed_at", "observation_id", "vat_included",
        ),
        [*keys, "comparable"],
        "amount_minor",
        F.max("observed_at").alias("last_at"),
        first,
    )
    # Captures without a comparable price only count where none has one.
    seller = Window.partitionBy(*keys)
    marked = counted.withColumn("has_comparable", F.max("comparable").over(seller))
    voting = F.when(F.col("comparable") == F.col("has_comparable"), F.col("value_count")).otherwise(F.lit(0))
    priced = marked.withColumn("voting", voting).groupBy(*keys, "has_comparable", "amount_minor").agg(
        F.sum("voting").alias("voting"), F.sum("value_count").alias("value_count"),
        F.max("last_at").alias("last_at"), F.min("first_row").alias("first_row"),
    )
    grouped = median_by_rank(
        priced, [*keys, "has_comparable"], "amount_minor", "voting", "vote_minor",
        F.sum("value_count").alias("capture_count"),
        F.max("last_at").alias("last_observed_at"),
        F.min("first_row").alias("first_row"),
    )
    return grouped.select(
        *keys,
        "capture_count",
        "last_observed_at",
        F.col("vote_minor").alias("amount_minor"),
        F.when(F.col("has_comparable"), F.lit(True)).otherwise(F.col("first_row.vat_included")).alias("vat_included"),
        F.when(~F.col("has_comparable"), F.lit("VAT_BASIS_NOT_COMPARABLE")).alias("exclusion_reason"),
    )


def comparable_seller_medians(obs: DataFrame) -> DataFrame:
    """(mpn, month, seller, amount_minor) from tax-inclusive captures only."""
    rows = obs.where("vat_included").select("mpn", month_of(F.col("observed_at")).alias("month"), "seller", "amount_minor")
    return grouped_median(rows, ["mpn", "month", "seller"], "amount_minor", "amount_minor")


def monthly_medians(obs: DataFrame) -> DataFrame:
    """(mpn, month, median_minor) over seller medians; observed months only."""
    return grouped_median(comparable_seller_medians(obs), ["mpn", "month"], "amount_minor", "median_minor")


def per_product_month_series(obs: DataFrame) -> DataFrame:
    """One row per (product, month) with at least one capture, gaps absent.

    The seller breakdown of a point is `month_contributors`, kept as rows.
    """
    votes = month_contributors(obs)
    counts = votes.groupBy("mpn", "month", "amount_minor").agg(
        F.count_if(F.col("exclusion_reason").isNull()).alias("inside"),
        F.count_if(F.col("exclusion_reason").isNotNull()).alias("outside"),
    )
    kept = F.when(F.col("inside") > 0, F.col("amount_minor"))
    point = median_by_rank(
        counts, ["mpn", "month"], "amount_minor", "inside", "median_minor",
        F.min(kept).alias("low_minor"),
        F.max(kept).alias("high_minor"),
        F.sum("inside").alias("seller_count"),
        F.sum("outside").alias("excluded_seller_count"),
    )
    return point.select(
        "mpn",
        "month",
        F.when(F.col("seller_count") > 0, F.lit("observed")).otherwise(F.lit("no_comparable_price")).alias("state"),
        "median_minor",
        "low_minor",
        "high_minor",
        "seller_count",
        (F.col("seller_count") == 1).alias("single_seller"),
        "excluded_seller_count",
    )


def speed_from_mpn(mpn: Column, speeds: list[int]) -> Column:
    """First listed speed contained in the number, else a two-digit prefix code."""
    upper = F.upper(mpn)
    chain = F.when(F.length(mpn) == 0, F.lit(None))
    for speed in speeds:
        chain = chain.when(upper.contains(str(speed)), F.lit(speed))
    code = F.regexp_extract(upper, "^CT2K16G(48|52|56|60|64)C[0-9]", 1)
    return chain.when(code != "", code.try_cast("int") * 100).cast("long")


def comparable_votes(obs: DataFrame) -> DataFrame:
    """Distinct (mpn, month, seller) that put a tax-inclusive price on the table."""
    return obs.where("vat_included").select("mpn", month_of(F.col("observed_at")).alias("month"), "seller").distinct()


def series_summary(votes: DataFrame, speeds: list[int], min_months: int = 1, min_sellers: int = 1) -> DataFrame:
    """Per product: months with a median, sellers, multi-seller months; floors applied.

    A month has a median exactly when some seller has a comparable price, so
    the seller votes are enough and no price is touched here.
    """
    months = (
        votes.groupBy("mpn", "month").agg(F.count(F.lit(1)).alias("sellers"))
        .groupBy("mpn").agg(
            F.count(F.lit(1)).alias("month_count"),
            F.count_if(F.col("sellers") >= 2).alias("multi_seller_month_count"),
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
        )
    )
    sellers = votes.select("mpn", "seller").distinct().groupBy("mpn").agg(F.count(F.lit(1)).alias("seller_count"))
    joined = months.join(sellers, "mpn").where((F.col("month_count") >= min_months) & (F.col("seller_count") >= min_sellers))
    speed = speed_from_mpn(F.col("mpn"), speeds)
    return joined.select(
        "mpn",
        speed.alias("speed_mts"),
        F.when(speed.isNull(), F.lit("not_derivable_from_mpn"))
        .otherwise(F.lit("derived_from_mpn_for_grouping_only")).alias("speed_basis"),
        "month_count",
        "seller_count",
        "multi_seller_month_count",
        month_label(F.col("first_month")).alias("first_month"),
        month_label(F.col("last_month")).alias("last_month"),
    )


def filter_series(summary: DataFrame, speed: str = "all", deep: bool = True, multi: bool = True) -> DataFrame:
    """Interactive filters: one speed or 'unknown', six-month depth, two sellers."""
    out = summary
    if speed == "unknown":
        out = out.where("speed_mts IS NULL")
    elif speed != "all":
        out = out.where(F.col("speed_mts") == int(speed))
    if deep:
        out = out.where("month_count >= 6")
    if multi:
        out = out.where("seller_count >= 2")
    return out


def price_envelope(obs: DataFrame) -> DataFrame:
    """Low and high of every quarter with their observation; empty quarters stay.

    The contributing rows are `envelope_contributors`, kept as rows. Products
    and sellers are reduced to one row per quarter first, so the distinct
    counts run on that reduction and not on the observations.
    """
    low = F.min(F.struct("amount_minor", "observation_id", "mpn", "seller")).alias("low")
    high = F.min(F.struct((-F.col("amount_minor")).alias("neg"), "observation_id", "mpn", "seller")).alias("high")
    reduced = obs.groupBy(quarter_of(F.col("observed_at")).alias("period"), "mpn", "seller").agg(
        low, high,
        F.count(F.lit(1)).alias("n"),
        F.count("vat_included").alias("vat_known"),
    )
    products = reduced.groupBy("period", "mpn").agg(
        F.min("low").alias("low"), F.min("high").alias("high"), F.sum("n").alias("n"), F.sum("vat_known").alias("vat_known")
    )
    sellers = reduced.select("period", "seller").distinct().groupBy("period").agg(F.count(F.lit(1)).alias("seller_n"))
    periods = products.groupBy("period").agg(
        F.min("low").alias("low"),
        F.min("high").alias("high"),
        F.sum("n").alias("n"),
        F.sum("vat_known").alias("vat_known"),
        F.count(F.lit(1)).alias("mpn_n"),
    ).join(sellers, "period")
    bounds = obs.agg(
        quarter_of(F.min("observed_at")).alias("first"), quarter_of(F.max("observed_at")).alias("last")
    )
    spine = period_spine(bounds, "first", "last", 3)
    zero = F.lit(0).cast("long")
    return spine.join(periods, "period", "left").select(
        quarter_label(F.col("period"), "-").alias("period_id"),
        instant_text(F.col("period").cast("timestamp")).alias("start"),
        instant_text(quarter_end(F.col("period")).cast("timestamp")).alias("end"),
        F.when(F.col("n").isNull(), F.lit("no_eligible_evidence")).otherwise(F.lit("observed")).alias("state"),
        F.col("low.amount_minor").alias("low_minor"),
        F.col("low.observation_id").alias("low_observation_id"),
        F.col("low.mpn").alias("low_mpn"),
        F.col("low.seller").alias("low_seller"),
        (-F.col("high.neg")).alias("high_minor"),
        F.col("high.observation_id").alias("high_observation_id"),
        F.col("high.mpn").alias("high_mpn"),
        F.col("high.seller").alias("high_seller"),
        F.coalesce("n", zero).alias("observation_count"),
        F.coalesce("mpn_n", zero).alias("distinct_mpn_count"),
        F.coalesce("seller_n", zero).alias("distinct_seller_count"),
        F.coalesce("vat_known", zero).alias("vat_resolved_count"),
        F.coalesce(F.col("n") - F.col("vat_known"), zero).alias("vat_unresolved_count"),
    )


def envelope_contributors(obs: DataFrame) -> DataFrame:
    """Which observation stands behind which quarter."""
    return obs.select(quarter_label(quarter_of(F.col("observed_at")), "-").alias("period_id"), "observation_id")


def period_overlap(obs: DataFrame) -> DataFrame:
    """Products shared with the previous observed quarter, and the thin flag."""
    pairs = obs.groupBy("mpn", quarter_of(F.col("observed_at")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy("period").agg(F.sum("n").alias("observation_count"))
    order = counts.withColumn("previous", F.lag("period").over(Window.orderBy("period")))
    held = pairs.withColumn("mpn_previous", F.lag("period").over(Window.partitionBy("mpn").orderBy("period")))
    shared = (
        held.join(order.select("period", "previous"), "period")
        .groupBy("period")
        .agg(F.count_if(F.col("mpn_previous") == F.col("previous")).alias("shared"))
    )
    both = order.join(shared, "period")
    shared_known = F.when(F.col("previous").isNotNull(), F.col("shared"))
    return both.select(
        quarter_label(F.col("period"), "-").alias("period_id"),
        "observation_count",
        shared_known.alias("shared_with_previous"),
        ((F.col("observation_count") < 5) | F.coalesce(shared_known < 3, F.lit(False))).alias("thin"),
    )


def collapse_to_periods(points: DataFrame) -> DataFrame:
    """Median of a product's monthly medians per quarter; at most three rows a group."""
    return points.groupBy("mpn", quarter_of(F.col("month")).alias("period")).agg(
        half_up(F.percentile("median_minor", 0.5)).alias("price_minor")
    )


def coverage_gaps(points: DataFrame) -> DataFrame:
    """Unobserved stretches between consecutive observed months of a product."""
    after = F.lead("month").over(Window.partitionBy("mpn").orderBy("month"))
    return (
        points.select("mpn", F.col("month").alias("after_month"), after.alias("before_month"))
        .where(F.col("before_month") > F.add_months("after_month", 1))
        .select(
            "mpn",
            month_label(F.col("after_month")).alias("after_month"),
            month_label(F.col("before_month")).alias("before_month"),
            F.lit("unobserved").alias("state"),
            (F.months_between("before_month", "after_month").cast("long") - 1).alias("missing_months"),
        )
    )


def contiguous_segments(points: DataFrame, keys: list[str], at: str, unit: str) -> DataFrame:
    """Islands of consecutive days or months per key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(at)
    previous = F.lag(at).over(w)
    step = F.date_add(previous, 1) if unit == "day" else F.add_months(previous, 1)
    flagged = points.withColumn("starts", F.when(F.coalesce(step == F.col(at), F.lit(False)), 0).otherwise(1))
    numbered = flagged.withColumn("segment_no", F.sum("starts").over(w))
    return numbered.groupBy(*keys, "segment_no").agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("point_count")
    )


def value_runs(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Unbroken stretches of non-null values along an ordered axis."""
    w = Window.partitionBy(key).orderBy(at)
    broken = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(w)
    runs = rows.withColumn("broken", broken).where(F.col(value).isNotNull())
    return runs.groupBy(key, "broken").agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("point_count")
    ).drop("broken")


def series_staleness(summary: DataFrame, stale_after: int = 3) -> DataFrame:
    """Placement of every product inside the month span of the whole dataset."""
    ends = F.struct(F.min("first_month").alias("first"), F.max("last_month").alias("last"))
    # One subquery of one row, stated once and carried as a column.
    placed = summary.withColumn("domain", summary.agg(ends.alias("domain")).scalar())
    first, last = F.col("domain.first"), F.col("domain.last")
    behind = month_offset(last, F.col("last_month"))
    return placed.select(
        "mpn",
        month_span(first, last).alias("domain_months"),
        month_offset(F.col("first_month"), first).alias("starts_at"),
        (F.col("first_month") > first).alias("starts_late"),
        (F.col("last_month") < last).alias("ends_early"),
        behind.alias("months_behind"),
        (behind >= stale_after).alias("is_stale"),
    )
