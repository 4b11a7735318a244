"""Series and index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.money import format_gbp, format_index, format_signed_percent, grouped_median
from pricetrail.functions.periods import instant_text, month_label, quarter_end, quarter_label, quarter_of, period_spine
from pricetrail.operators import chain, series
from pricetrail.plans.registry import register
from pricetrail.plans.views import index_views
from pricetrail.sources.adapter import SPEEDS, observations

BASE = "1998-01-01"


def prices(spark: SparkSession, root: str) -> DataFrame:
    return series.collapse_to_periods(series.monthly_medians(observations(spark, root)))


def holed_prices(spark: SparkSession, root: str) -> DataFrame:
    """The same prices with one quarter withdrawn, so the chain has to stop."""
    return prices(spark, root).where("period <> DATE'1999-07-01'")


def summary(spark: SparkSession, root: str, min_months: int = 1, min_sellers: int = 1) -> DataFrame:
    votes = series.comparable_votes(observations(spark, root))
    return series.series_summary(votes, SPEEDS, min_months, min_sellers)


@register("median_minor", """
SELECT mpn, CAST(floor(quantile_cont(amount_minor, 0.5) + 0.5) AS BIGINT) AS median_minor FROM v_lines GROUP BY mpn""")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    return grouped_median(lines(spark, root), ["mpn"], "amount_minor", "median_minor")


@register("mean_minor", """
SELECT mpn, CAST(floor(sum(amount_minor) / count(*) + 0.5) AS BIGINT) AS mean_minor FROM v_lines GROUP BY mpn""")
def _(spark, root):
    from pricetrail.functions.money import mean_minor
    from pricetrail.sources.adapter import lines

    return lines(spark, root).groupBy("mpn").agg(mean_minor("amount_minor").alias("mean_minor"))


@register("period_labels", """
SELECT strftime(observed_at, '%Y-%m') AS month, year(observed_at) || 'Q' || quarter(observed_at) AS quarter_id,
  year(observed_at) || '-Q' || quarter(observed_at) AS envelope_quarter_id,
  strftime(date_trunc('quarter', observed_at), '%Y-%m-%dT00:00:00Z') AS start,
  strftime(date_trunc('quarter', observed_at) + INTERVAL 3 MONTH, '%Y-%m-%dT00:00:00Z') AS "end", count(*) AS n
FROM v_lines GROUP BY ALL""")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    from pricetrail.functions.periods import month_of

    months = lines(spark, root).groupBy(month_of(F.col("observed_at")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    q = quarter_of(F.col("m"))
    return months.select(
        month_label(F.col("m")).alias("month"),
        quarter_label(q).alias("quarter_id"),
        quarter_label(q, "-").alias("envelope_quarter_id"),
        instant_text(q.cast("timestamp")).alias("start"),
        instant_text(quarter_end(q).cast("timestamp")).alias("end"),
        "n",
    )


@register("period_spine", """
WITH b AS (SELECT min(date_trunc('quarter', observed_at)) AS lo, max(date_trunc('quarter', observed_at)) AS hi FROM v_lines)
SELECT year(p) || '-Q' || quarter(p) AS period_id, coalesce(n, 0) AS n
FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 3 MONTH)) AS p FROM b) s
LEFT JOIN (SELECT date_trunc('quarter', observed_at) AS q, count(*) AS n FROM v_lines GROUP BY 1) c ON c.q = s.p""")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    held = lines(spark, root).groupBy(quarter_of(F.col("observed_at")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    bounds = held.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    return period_spine(bounds, "a", "b", 3).join(held, "period", "left").select(
        quarter_label(F.col("period"), "-").alias("period_id"), F.coalesce("n", F.lit(0)).alias("n")
    )


@register("month_contributors", """
SELECT mpn, strftime(month, '%Y-%m') AS month, seller, capture_count,
  strftime(last_observed_at, '%Y-%m-%dT%H:%M:%SZ') AS last_observed_at, amount_minor, vat_included,
  CASE WHEN NOT comparable THEN 'VAT_BASIS_NOT_COMPARABLE' END AS exclusion_reason FROM v_votes""")
def _(spark, root):
    return series.month_contributors(observations(spark, root)).withColumns(
        {"month": month_label(F.col("month")), "last_observed_at": instant_text(F.col("last_observed_at"))}
    )


@register("per_product_month_series", """
SELECT mpn, strftime(month, '%Y-%m') AS month, state, median_minor, low_minor, high_minor, seller_count, single_seller, excluded_seller_count FROM v_points""")
def _(spark, root):
    return series.per_product_month_series(observations(spark, root)).withColumn("month", month_label(F.col("month")))


SPEED_SQL = "CASE " + " ".join(f"WHEN contains(mpn, '{s}') THEN {s}" for s in SPEEDS) + (
    " WHEN regexp_matches(mpn, '^CT2K16G(48|52|56|60|64)C[0-9]') THEN CAST(substring(mpn, 8, 2) AS BIGINT) * 100 END"
)


@register("speed_from_mpn", f"SELECT DISTINCT mpn, {SPEED_SQL} AS speed_mts FROM v_lines")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    return lines(spark, root).select("mpn").distinct().select(
        "mpn", series.speed_from_mpn(F.col("mpn"), SPEEDS).alias("speed_mts")
    )


SUMMARY_COLUMNS = f"""mpn, {SPEED_SQL} AS speed_mts,
  CASE WHEN {SPEED_SQL} IS NULL THEN 'not_derivable_from_mpn' ELSE 'derived_from_mpn_for_grouping_only' END AS speed_basis,
  month_count, seller_count, multi_seller_month_count, first_month, last_month"""


@register("series_summary", f"SELECT {SUMMARY_COLUMNS} FROM v_summary WHERE month_count >= 12 AND seller_count >= 3")
def _(spark, root):
    return summary(spark, root, 12, 3).orderBy(F.col("month_count").desc(), "mpn")


@register("filter_series", f"SELECT * FROM (SELECT {SUMMARY_COLUMNS} FROM v_summary) WHERE speed_mts IS NULL AND month_count >= 6 AND seller_count >= 2")
def _(spark, root):
    return series.filter_series(summary(spark, root), "unknown")


@register("price_envelope", """
WITH c AS (SELECT date_trunc('quarter', observed_at) AS q, count(*) AS n, count(DISTINCT mpn) AS mpns, count(DISTINCT seller) AS sellers,
    count(vat_included) AS known, min(amount_minor) AS lo, max(amount_minor) AS hi FROM v_obs GROUP BY 1),
b AS (SELECT min(q) AS a, max(q) AS z FROM c),
s AS (SELECT unnest(generate_series(a, z, INTERVAL 3 MONTH)) AS q FROM b),
l AS (SELECT q, min(o.observation_id) AS id FROM v_obs o JOIN c ON date_trunc('quarter', observed_at) = q AND amount_minor = lo GROUP BY q),
h AS (SELECT q, min(o.observation_id) AS id FROM v_obs o JOIN c ON date_trunc('quarter', observed_at) = q AND amount_minor = hi GROUP BY q)
SELECT year(s.q) || '-Q' || quarter(s.q) AS period_id, strftime(s.q, '%Y-%m-%dT00:00:00Z') AS start,
  strftime(s.q + INTERVAL 3 MONTH, '%Y-%m-%dT00:00:00Z') AS "end",
  CASE WHEN n IS NULL THEN 'no_eligible_evidence' ELSE 'observed' END AS state,
  lo AS low_minor, l.id AS low_observation_id, lr.mpn AS low_mpn, lr.seller AS low_seller,
  hi AS high_minor, h.id AS high_observation_id, hr.mpn AS high_mpn, hr.seller AS high_seller,
  coalesce(n, 0) AS observation_count, coalesce(mpns, 0) AS distinct_mpn_count, coalesce(sellers, 0) AS distinct_seller_count,
  coalesce(known, 0) AS vat_resolved_count, coalesce(n - known, 0) AS vat_unresolved_count
FROM s LEFT JOIN c ON c.q = s.q LEFT JOIN l ON l.q = s.q LEFT JOIN h ON h.q = s.q
LEFT JOIN v_obs lr ON lr.observation_id = l.id LEFT JOIN v_obs hr ON hr.observation_id = h.id""")
def _(spark, root):
    return series.price_envelope(observations(spark, root))


@register("envelope_contributors", "SELECT year(observed_at) || '-Q' || quarter(observed_at) AS period_id, observation_id FROM v_lines")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    return series.envelope_contributors(lines(spark, root))


@register("period_overlap", """
WITH p AS (SELECT DISTINCT mpn, date_trunc('quarter', observed_at) AS q FROM v_lines),
c AS (SELECT date_trunc('quarter', observed_at) AS q, count(*) AS n FROM v_lines GROUP BY 1),
o AS (SELECT q, n, lag(q) OVER (ORDER BY q) AS prev FROM c)
SELECT year(o.q) || '-Q' || quarter(o.q) AS period_id, n AS observation_count,
  CASE WHEN prev IS NOT NULL THEN (SELECT count(*) FROM p a JOIN p b ON a.mpn = b.mpn WHERE a.q = o.q AND b.q = o.prev) END AS shared_with_previous,
  n < 5 OR coalesce(CASE WHEN prev IS NOT NULL THEN (SELECT count(*) FROM p a JOIN p b ON a.mpn = b.mpn WHERE a.q = o.q AND b.q = o.prev) END < 3, false) AS thin
FROM o""")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    return series.period_overlap(lines(spark, root))


@register("collapse_to_periods", "SELECT mpn, year(period) || 'Q' || quarter(period) AS period_id, price_minor FROM v_prices")
def _(spark, root):
    return prices(spark, root).select("mpn", quarter_label(F.col("period")).alias("period_id"), "price_minor")


@register("matched_links", """
SELECT year(period) || 'Q' || quarter(period) AS period_id, matched_count, floor(link * 10000 + 0.5) / 10000 AS link
FROM v_links""")
def _(spark, root):
    from pricetrail.functions.money import round_dp

    links = chain.matched_links(chain.matched_pairs(prices(spark, root)))
    return links.select(
        quarter_label(F.col("period")).alias("period_id"),
        "matched_count",
        round_dp(F.col("link"), 4).alias("link"),
    )


@register("link_dispersion", """
SELECT year(period) || 'Q' || quarter(period) AS period_id, relative_min, relative_median, relative_max FROM v_links""")
def _(spark, root):
    return chain.link_dispersion(chain.matched_pairs(prices(spark, root))).select(
        quarter_label(F.col("period")).alias("period_id"), "relative_min", "relative_median", "relative_max"
    )


INDEX_COLUMNS = """period_id, state, index_value, link, matched_product_count, relative_min, relative_median, relative_max,
  distinct_products_in_period, reference_period"""
PRICES_SQL = "SELECT mpn, period, price_minor FROM v_prices"
HOLED_SQL = PRICES_SQL + " WHERE period <> DATE '1999-07-01'"


def index_sql(prices_sql: str, floor: int, tail: str) -> str:
    return index_views(prices_sql, BASE, floor) + tail


@register("matched_model_index", index_sql(PRICES_SQL, 10, f"SELECT {INDEX_COLUMNS} FROM idx"))
def _(spark, root):
    return chain.matched_model_index(prices(spark, root), BASE).drop("period")


@register("matched_model_index_thin", index_sql(PRICES_SQL, 420, f"SELECT {INDEX_COLUMNS} FROM idx"))
def _(spark, root):
    return chain.matched_model_index(prices(spark, root), BASE, 420).drop("period")


@register("matched_model_index_gap", index_sql(HOLED_SQL, 10, f"SELECT {INDEX_COLUMNS} FROM idx"))
def _(spark, root):
    return chain.matched_model_index(holed_prices(spark, root), BASE).drop("period")


@register("index_coverage", index_sql(HOLED_SQL, 10, """
SELECT min(period_id) FILTER (WHERE state = 'observed') AS first_period, max(period_id) FILTER (WHERE state = 'observed') AS last_period,
  count(*) FILTER (WHERE state = 'observed') AS observed_period_count,
  count(*) FILTER (WHERE distinct_products_in_period > 0) - count(*) FILTER (WHERE state = 'observed') AS periods_with_evidence_outside_chain,
  count(*) FILTER (WHERE distinct_products_in_period > 0) AS total_periods_with_observations FROM idx"""))
def _(spark, root):
    return chain.index_coverage(chain.matched_model_index(holed_prices(spark, root), BASE))


@register("index_extremes", index_sql(PRICES_SQL, 10, """
SELECT (SELECT period_id FROM idx WHERE state = 'observed' ORDER BY index_value DESC, period_id LIMIT 1) AS peak_period,
  (SELECT max(index_value) FROM idx) AS peak_value,
  (SELECT period_id FROM idx WHERE state = 'observed' ORDER BY index_value, period_id LIMIT 1) AS trough_period,
  (SELECT min(index_value) FROM idx) AS trough_value,
  (SELECT max(period_id) FROM idx WHERE state = 'observed') AS latest_period,
  (SELECT index_value FROM idx WHERE state = 'observed' ORDER BY period_id DESC LIMIT 1) AS latest_value"""))
def _(spark, root):
    return chain.index_extremes(chain.matched_model_index(prices(spark, root), BASE))


@register("coverage_gaps", """
SELECT mpn, strftime(month, '%Y-%m') AS after_month, strftime(nxt, '%Y-%m') AS before_month, 'unobserved' AS state,
  date_diff('month', month, nxt) - 1 AS missing_months
FROM (SELECT mpn, month, lead(month) OVER (PARTITION BY mpn ORDER BY month) AS nxt FROM v_points WHERE state = 'observed')
WHERE nxt > month + INTERVAL 1 MONTH""")
def _(spark, root):
    return series.coverage_gaps(series.monthly_medians(observations(spark, root)))


@register("contiguous_segments_months", """
SELECT mpn, row_number() OVER (PARTITION BY mpn ORDER BY min(month)) AS segment_no, strftime(min(month), '%Y-%m') AS first_month,
  strftime(max(month), '%Y-%m') AS last_month, count(*) AS point_count
FROM (SELECT mpn, month, date_diff('month', DATE '1970-01-01', month) - row_number() OVER (PARTITION BY mpn ORDER BY month) AS g
  FROM v_points WHERE state = 'observed') GROUP BY mpn, g""")
def _(spark, root):
    segments = series.contiguous_segments(series.monthly_medians(observations(spark, root)), ["mpn"], "month", "month")
    return segments.select(
        "mpn", "segment_no", month_label(F.col("first_at")).alias("first_month"),
        month_label(F.col("last_at")).alias("last_month"), "point_count",
    )


@register("value_runs", """
SELECT mpn, strftime(min(month), '%Y-%m') AS first_month, strftime(max(month), '%Y-%m') AS last_month, count(*) AS point_count
FROM (SELECT *, sum(CASE WHEN median_minor IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY mpn ORDER BY month) AS g FROM v_points)
WHERE median_minor IS NOT NULL GROUP BY mpn, g""")
def _(spark, root):
    points = series.per_product_month_series(observations(spark, root))
    runs = series.value_runs(points, "mpn", "month", "median_minor")
    return runs.select(
        "mpn", month_label(F.col("first_at")).alias("first_month"), month_label(F.col("last_at")).alias("last_month"), "point_count"
    )


@register("series_staleness", """
WITH d AS (SELECT min(first_month) AS a, max(last_month) AS z FROM v_summary),
m AS (SELECT *, CAST(first_month || '-01' AS DATE) AS f, CAST(last_month || '-01' AS DATE) AS l, CAST(a || '-01' AS DATE) AS da, CAST(z || '-01' AS DATE) AS dz FROM v_summary, d)
SELECT mpn, date_diff('month', da, dz) + 1 AS domain_months, date_diff('month', da, f) AS starts_at, f > da AS starts_late, l < dz AS ends_early,
  date_diff('month', l, dz) AS months_behind, date_diff('month', l, dz) >= 3 AS is_stale FROM m""")
def _(spark, root):
    return series.series_staleness(summary(spark, root))


@register("month_offset", """
SELECT mpn, date_diff('month', CAST(first_month || '-01' AS DATE), CAST(last_month || '-01' AS DATE)) AS month_offset,
  date_diff('month', CAST(first_month || '-01' AS DATE), CAST(last_month || '-01' AS DATE)) + 1 AS month_span FROM v_summary""")
def _(spark, root):
    from pricetrail.functions.periods import month_offset, month_span

    return summary(spark, root).select(
        "mpn",
        month_offset(F.col("last_month"), F.col("first_month")).alias("month_offset"),
        month_span(F.col("first_month"), F.col("last_month")).alias("month_span"),
    )


@register("formatted_values", """
SELECT observation_id, CASE WHEN m < 0 THEN '-' ELSE '' END || '£' || format('{:,}', abs(m) // 100) || '.' || lpad(CAST(abs(m) % 100 AS VARCHAR), 2, '0') AS gbp,
  CASE WHEN m > 0 THEN '+' WHEN m < 0 THEN '-' ELSE '' END || (abs(m) // 100) || '.' || lpad(CAST(abs(m) % 100 AS VARCHAR), 2, '0') || '%' AS percent,
  ((p + 50) // 1000) || '.' || ((p + 50) // 100 % 10) AS index_level FROM (SELECT observation_id, amount_minor - 150000 AS m, amount_minor * 7 AS p FROM v_obs)""")
def _(spark, root):
    a = F.col("amount_minor")
    moved = (a - 150000).alias("m")
    rows = observations(spark, root).select("observation_id", moved, (a * 7).alias("p"))
    return rows.select("observation_id", format_gbp(F.col("m")).alias("gbp"), format_signed_percent(F.col("m")).alias("percent"), format_index(F.col("p")).alias("index_level"))
