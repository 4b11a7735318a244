"""Matched-product chained index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions.money import round_dp
from pricetrail.functions.periods import quarter_label


def matched_pairs(prices: DataFrame) -> DataFrame:
    """Products present in a quarter and in the one right before it.

    `prices` is (mpn, period, price_minor), one row each. The predecessor comes
    from the product's own ordered rows, so no self-join is needed.
    """
    w = Window.partitionBy("mpn").orderBy("period")
    held = prices.select(
        "mpn", "period", "price_minor",
        F.lag("period").over(w).alias("from_period"),
        F.lag("price_minor").over(w).alias("from_minor"),
    )
    return held.where(F.col("from_period") == F.add_months("period", -3)).select(
        "mpn", "period", "from_minor", F.col("price_minor").alias("to_minor")
    )


def matched_links(pairs: DataFrame) -> DataFrame:
    """Geometric mean of price relatives per quarter, with the matched count."""
    relative = F.ln(F.col("to_minor") / F.col("from_minor"))
    return pairs.groupBy("period").agg(
        F.count(F.lit(1)).alias("matched_count"), F.exp(F.avg(relative)).alias("link")
    )


def link_dispersion(pairs: DataFrame) -> DataFrame:
    """Smallest, upper-median and largest relative per quarter, four decimals.

    Rounding is monotone, so the order statistic of the rounded relatives is
    the rounded order statistic. Relatives are therefore counted per rounded
    value first and a quarter is ranked over its distinct values only.
    """
    relative = round_dp(F.col("to_minor") / F.col("from_minor"), 4)
    counted = pairs.groupBy("period", relative.alias("relative")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("period").orderBy("relative")
    ranked = counted.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("period")))
    reached = F.col("upto") > F.floor(F.col("total") / 2)
    return ranked.groupBy("period").agg(
        F.min("relative").alias("relative_min"),
        F.min(F.when(reached, F.col("relative"))).alias("relative_median"),
        F.max("relative").alias("relative_max"),
    )


def index_table(prices: DataFrame) -> DataFrame:
    """Everything the chain needs, one row per quarter between first and last.

    One pass over the prices: products are counted per quarter and rounded
    relative, null where a product has no price in the quarter before, with the
    sum of their logarithms. Presence, links and dispersion all fold from those
    counts; quarters in between come from the distance to the next one.
    """
    w = Window.partitionBy("mpn").orderBy("period")
    held = prices.select("period", "price_minor", F.lag(F.struct("period", "price_minor")).over(w).alias("before"))
    ratio = F.when(F.col("before.period") == F.add_months("period", -3), F.col("price_minor") / F.col("before.price_minor"))
    counted = held.select("period", ratio.alias("ratio")).groupBy("period", round_dp(F.col("ratio"), 4).alias("relative")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.ln("ratio")).alias("logs")
    )
    known = F.col("relative").isNotNull()
    quarter = Window.partitionBy("period")
    ranked = counted.withColumns({
        "upto": F.sum("n").over(quarter.orderBy(F.col("relative").asc_nulls_last())), "total": F.sum(F.when(known, F.col("n"))).over(quarter),
    })
    reached = known & (F.col("upto") > F.floor(F.col("total") / 2))
    per = ranked.groupBy("period").agg(
        F.sum("n").alias("distinct_products"), F.sum(F.when(known, F.col("n"))).alias("matched_count"),
        F.exp(F.sum("logs") / F.sum(F.when(known, F.col("n")))).alias("link"), F.min("relative").alias("relative_min"),
        F.min(F.when(reached, F.col("relative"))).alias("relative_median"), F.max("relative").alias("relative_max"),
    )
    upcoming = F.lead("period").over(Window.orderBy("period"))
    until = F.coalesce(F.add_months(upcoming, -3), F.col("period"))
    spread = per.withColumn("until", until).withColumn("quarter", F.explode(F.sequence("period", "until", F.expr("INTERVAL 3 MONTH"))))
    own = F.col("quarter") == F.col("period")
    return spread.select(F.col("quarter").alias("period"), *[F.when(own, F.col(c)).alias(c) for c in per.columns if c != "period"])


def chain_index(table: DataFrame, base: Column, floor: int, base_value: float = 100.0) -> DataFrame:
    """Level per quarter, chained both ways from `base`, stopped at thin links.

    `table` has one row per calendar quarter, so the two unpartitioned windows
    sort a few hundred rows at most.
    """
    forward = F.col("period") > base
    backward = F.col("period") < base
    up = Window.orderBy("period")
    down = Window.orderBy(F.col("period").desc())
    # The link into a quarter belongs to it going forward; going backward a
    # quarter is reached through the link of its successor.
    both_sides = F.col("distinct_products").isNotNull() & F.lag("distinct_products").over(up).isNotNull()
    t = table.withColumn("matched", F.when(both_sides, F.coalesce("matched_count", F.lit(0)))).withColumn(
        "usable", F.when(F.col("matched") >= floor, F.col("link"))
    )
    used = ["matched", "usable", "relative_min", "relative_median", "relative_max"]
    for name in used:
        t = t.withColumn(f"step_{name}", F.when(forward, F.col(name)).when(backward, F.lead(name).over(up)))
    failed = F.col("step_usable").isNull().cast("int")
    stops_up = F.sum(F.when(forward, failed)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    stops_down = F.sum(F.when(backward, failed)).over(down.rowsBetween(Window.unboundedPreceding, 0))
    logs = F.ln("step_usable")
    gain_up = F.sum(F.when(forward, logs)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    gain_down = F.sum(F.when(backward, logs)).over(down.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("stops", F.when(forward, stops_up).when(backward, stops_down).otherwise(F.lit(0)))
    t = t.withColumn("gain", F.when(forward, gain_up).when(backward, -gain_down).otherwise(F.lit(0.0)))
    # A quarter is the first stop when it fails itself and nothing failed before.
    first_stop = (F.col("stops") == 1) & F.col("step_usable").isNull()
    inside = F.col("stops") == 0
    described = inside | first_stop
    state = (
        F.when(inside, F.lit("observed"))
        .when(F.col("distinct_products").isNull(), F.lit("no_observations"))
        .when(first_stop, F.lit("insufficient_matched_evidence"))
        .otherwise(F.lit("outside_stopped_chain"))
    )
    return t.select(
        F.col("period"),
        quarter_label(F.col("period")).alias("period_id"),
        state.alias("state"),
        F.when(inside, round_dp(F.lit(base_value) * F.exp("gain"), 3)).alias("index_value"),
        F.when(inside & forward, round_dp(F.col("step_usable"), 4)).alias("link"),
        F.when(described, F.col("step_matched")).cast("long").alias("matched_product_count"),
        F.when(described, F.col("step_relative_min")).alias("relative_min"),
        F.when(described, F.col("step_relative_median")).alias("relative_median"),
        F.when(described, F.col("step_relative_max")).alias("relative_max"),
        F.coalesce("distinct_products", F.lit(0)).cast("long").alias("distinct_products_in_period"),
        (F.col("period") == base).alias("reference_period"),
    )


def matched_model_index(prices: DataFrame, base: str, floor: int = 10) -> DataFrame:
    """Chained index of (mpn, period, price_minor) anchored at the quarter `base`."""
    return chain_index(index_table(prices), F.to_date(F.lit(base)), floor)


def index_coverage(index: DataFrame) -> DataFrame:
    observed = F.col("state") == "observed"
    with_data = F.col("distinct_products_in_period") > 0
    return index.agg(
        F.min(F.when(observed, F.col("period_id"))).alias("first_period"),
        F.max(F.when(observed, F.col("period_id"))).alias("last_period"),
        F.count_if(observed).alias("observed_period_count"),
        (F.count_if(with_data) - F.count_if(observed)).alias("periods_with_evidence_outside_chain"),
        F.count_if(with_data).alias("total_periods_with_observations"),
    )


def index_extremes(index: DataFrame) -> DataFrame:
    """Peak, trough and latest observed quarter; ties go to the earlier quarter."""
    seen = index.where("state = 'observed'")
    peak = F.min(F.struct((-F.col("index_value")).alias("v"), "period_id"))
    trough = F.min(F.struct(F.col("index_value").alias("v"), "period_id"))
    last = F.max(F.struct("period_id", "index_value"))
    return seen.agg(peak.alias("peak"), trough.alias("trough"), last.alias("latest")).select(
        F.col("peak.period_id").alias("peak_period"),
        (-F.col("peak.v")).alias("peak_value"),
        F.col("trough.period_id").alias("trough_period"),
        F.col("trough.v").alias("trough_value"),
        F.col("latest.period_id").alias("latest_period"),
        F.col("latest.index_value").alias("latest_value"),
    )
