"""Movements of product-seller lines and of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions.money import basis_points, direction, half_up
from pricetrail.functions.reasons import stacked, violations
from pricetrail.functions.windows import lag_in_chunks

LINE = ["product_key", "retailer_key"]


def daily_lines(qualified: DataFrame) -> DataFrame:
    """One row per line and date with eligible rows, and how many there were.

    Folding to dates first bounds a line by the calendar, whatever share of the
    rows it holds.
    """
    day = F.to_date("observed_at").alias("date")
    return qualified.where("status = 'eligible'").groupBy(*LINE, day).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("landed_price_minor").alias("price_minor"),
        F.min("observation_id").alias("observation_id"),
    )


def line_conflicts(qualified: DataFrame) -> DataFrame:
    """Line-dates holding several eligible rows; no rule picks one of them."""
    return daily_lines(qualified).where("n > 1").select(*LINE, "date", F.col("n").alias("eligible_count"))


def line_movements(qualified: DataFrame) -> DataFrame:
    """Change between consecutive eligible dates of a line.

    Dates in conflict are left to `line_conflicts` and take no part here.
    """
    w = Window.partitionBy(*LINE).orderBy("date")
    rows = daily_lines(qualified).where("n = 1").select(
        *LINE,
        F.lag("date").over(w).alias("from_date"),
        F.col("date").alias("to_date"),
        F.lag("price_minor").over(w).alias("from_minor"),
        F.col("price_minor").alias("to_minor"),
        F.lag("observation_id").over(w).alias("from_observation_id"),
        F.col("observation_id").alias("to_observation_id"),
    ).where("from_date IS NOT NULL")
    change = F.col("to_minor") - F.col("from_minor")
    return rows.withColumns({
        "change_minor": change,
        "change_basis_points": basis_points(change, F.col("from_minor")),
        "direction": direction(change),
    })


def insufficient_history(qualified: DataFrame) -> DataFrame:
    """Lines with fewer than two eligible dates, including none at all."""
    day = F.when(F.col("status") == "eligible", F.to_date("observed_at"))
    dates = qualified.groupBy(*LINE, day.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return dates.groupBy(*LINE).agg(
        F.count("date").alias("eligible_date_count"), F.max("date").alias("only_date")
    ).where("eligible_date_count < 2").withColumn("reason", F.lit("requires_at_least_two_eligible_dates"))


def widest_movements(obs: DataFrame) -> DataFrame:
    """Per product, the pair widest apart in time, within one seller if possible.

    Ends are extreme (time, id) structs, so equal times resolve by id and rows
    collapse map-side to two structs per product-seller.
    """
    end = F.struct("observed_at", "observation_id", "amount_minor", "seller", "vat_included")
    lines = obs.groupBy("mpn", "seller").agg(F.min(end).alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("n"))
    span = F.unix_timestamp("last.observed_at") - F.unix_timestamp("first.observed_at")
    within = F.when(F.col("n") >= 2, F.struct((-span).alias("neg_span"), F.col("seller").alias("s"), F.col("first").alias("a"), F.col("last").alias("z")))
    products = lines.groupBy("mpn").agg(
        F.min(within).alias("within"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    ).where("n >= 2")
    picked = products.select(
        "mpn",
        F.coalesce("within.a", "first").alias("a"),
        F.coalesce("within.z", "last").alias("z"),
        F.when(F.col("within").isNotNull(), F.lit("within_seller")).otherwise(F.lit("cross_seller")).alias("comparison_basis"),
    )

    def label(name: str) -> Column:
        v = F.col(f"{name}.vat_included")
        return F.when(v.isNull(), F.lit("unresolved")).when(v, F.lit("included")).otherwise(F.lit("excluded"))

    delta = F.col("z.amount_minor") - F.col("a.amount_minor")
    return picked.select(
        F.concat_ws("-", F.lit("movement"), F.lower("mpn"), F.col("a.observation_id"), F.col("z.observation_id")).alias("movement_id"),
        "mpn",
        F.col("a.observation_id").alias("from_observation_id"),
        F.col("a.observed_at").alias("from_observed_at"),
        F.col("a.seller").alias("from_seller"),
        F.col("a.amount_minor").alias("from_minor"),
        F.col("z.observation_id").alias("to_observation_id"),
        F.col("z.observed_at").alias("to_observed_at"),
        F.col("z.seller").alias("to_seller"),
        F.col("z.amount_minor").alias("to_minor"),
        delta.alias("delta_minor"),
        half_up(delta.cast("double") * 10000 / F.col("a.amount_minor")).alias("delta_basis_points"),
        "comparison_basis",
        label("a").alias("vat_state_from"),
        label("z").alias("vat_state_to"),
        (F.col("a.vat_included").isNull() | F.col("z.vat_included").isNull()).alias("vat_disclosure_required"),
    )


def quoted_history(obs: DataFrame) -> DataFrame:
    """Consecutive deltas of products sold by exactly one legal seller, archived and live.

    Products are screened by a small aggregate; rows at one instant fold into
    the smallest id before the ordered pass.
    """
    line = F.coalesce("seller_legal_name", F.lit(""))
    sellers = obs.groupBy("mpn", line.alias("line")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("capture_kind") == "archive_capture").alias("archive"),
        F.bool_or(F.col("capture_kind") == "prospective_capture").alias("live"),
    )
    eligible = sellers.groupBy("mpn").agg(
        F.count(F.lit(1)).alias("lines"), F.max("line").alias("line"), F.sum("n").alias("n"),
        F.bool_or("archive").alias("archive"), F.bool_or("live").alias("live"),
    ).where("lines = 1 AND line <> '' AND n >= 2 AND archive AND live")
    points = obs.join(eligible.select("mpn"), "mpn", "left_semi").groupBy("mpn", "observed_at").agg(
        F.min(F.struct("observation_id", "amount_minor", "seller_legal_name")).alias("r")
    )
    flat = points.select("mpn", "observed_at", "r.observation_id", "r.amount_minor", "r.seller_legal_name")
    chained = lag_in_chunks(flat, ["mpn"], ["observed_at"], ["observation_id", "amount_minor"], F.trunc("observed_at", "month"))
    return chained.where("prior IS NOT NULL").select(
        "mpn",
        "seller_legal_name",
        F.col("prior.observation_id").alias("from_observation_id"),
        F.col("observation_id").alias("to_observation_id"),
        F.col("prior.amount_minor").alias("denominator_minor"),
        F.col("amount_minor").alias("to_minor"),
        (F.col("amount_minor") - F.col("prior.amount_minor")).alias("delta_minor"),
    )


def movement_drift(recorded: DataFrame, derived: DataFrame) -> DataFrame:
    """Recorded movements that are not derivable or differ in some field."""
    fields = [c for c in recorded.columns if c != "movement_id"]
    a = recorded.select("movement_id", F.struct(*fields).alias("was"))
    b = derived.select("movement_id", F.struct(*fields).alias("now"), F.lit(True).alias("derivable"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"was.{f}").eqNullSafe(F.col(f"now.{f}")), F.lit(f)) for f in fields]))
    joined = a.join(b, "movement_id", "left").withColumn("changed", changed)
    return violations(joined, F.col("movement_id"), [
        ("movement_not_derivable", F.col("derivable").isNull()),
        ("movement_values_differ", F.col("derivable") & (F.size("changed") > 0)),
    ], F.when(F.col("derivable"), F.array_join("changed", ",")).otherwise(F.lit("")))


def movement_lineage(movements: DataFrame, qualified: DataFrame) -> DataFrame:
    """Both ends eligible, same line, dates and prices equal, basis points re-derived."""
    rows = qualified.select("observation_id", "status", *LINE, F.to_date("observed_at").alias("date"), "landed_price_minor")

    def side(prefix: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns])

    joined = movements.join(side("a"), F.col("from_observation_id") == F.col("a_observation_id"), "left").join(
        side("z"), F.col("to_observation_id") == F.col("z_observation_id"), "left"
    )

    def differs(left: str, right: str) -> Column:
        return ~F.col(left).eqNullSafe(F.col(right))

    missing = F.col("a_status").isNull() | F.col("z_status").isNull()
    present = ~missing
    return violations(joined, F.concat_ws("|", "from_observation_id", "to_observation_id"), [
        ("endpoint_missing", missing),
        ("endpoint_not_eligible", present & ((F.col("a_status") != "eligible") | (F.col("z_status") != "eligible"))),
        ("line_differs", present & (differs("a_product_key", "product_key") | differs("z_product_key", "product_key")
                                    | differs("a_retailer_key", "retailer_key") | differs("z_retailer_key", "retailer_key"))),
        ("date_differs", present & (differs("a_date", "from_date") | differs("z_date", "to_date"))),
        ("price_differs", present & (differs("a_landed_price_minor", "from_minor") | differs("z_landed_price_minor", "to_minor"))),
        ("basis_points_differ", F.col("change_basis_points") != basis_points(F.col("change_minor"), F.col("from_minor"))),
    ])


def observation_lineage(obs: DataFrame, revisions: DataFrame, retailers: DataFrame, policies: DataFrame) -> DataFrame:
    """Foreign keys of a stored observation: product revision, retailer region, source policy."""

    def absent(other: DataFrame, keys: list[str], rule: str) -> DataFrame:
        return obs.join(other, keys, "left_anti").select(
            F.lit(rule).alias("rule"), F.col("observation_id").alias("key"), F.concat_ws("|", *keys).alias("detail")
        )

    return stacked(
        absent(revisions, ["revision_id", "product_key", "mpn_expected"], "product_revision_disagrees"),
        absent(retailers, ["retailer_key", "region"], "retailer_region_disagrees"),
        absent(policies, ["policy_id", "source_key"], "source_policy_disagrees"),
    )
