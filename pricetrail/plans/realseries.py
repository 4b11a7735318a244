"""Fixed-base, monthly, constant-price and linked-vintage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.reasons import stacked
from pricetrail.operators import realseries as ops
from pricetrail.plans.market import settled_days
from pricetrail.plans.registry import register
from pricetrail.plans.views import VIEWS
from pricetrail.session import settle
from pricetrail.sources.adapter import observations
from pricetrail.sources.tables import literal_table, table

BASE_DAY = "1998-03-02"

VIEWS.update({
    "v_quoted": """
SELECT *, CASE WHEN reasons = '' THEN 'eligible' ELSE 'abstain' END AS status FROM (SELECT *, concat_ws(',',
  CASE WHEN k_part % 23 = 0 THEN 'retailer_owned_seller_unresolved' END, CASE WHEN vat_included IS DISTINCT FROM true THEN 'vat_inclusion_unresolved' END) AS reasons FROM v_obs)
""",
    "v_lineday": """
SELECT mpn, seller, CAST(observed_at AS DATE) AS date, bool_or(status = 'eligible') AS eligible,
  coalesce(arg_min(amount_minor, observation_id) FILTER (WHERE status = 'eligible'), arg_min(amount_minor, observation_id)) AS amount_minor
FROM v_quoted GROUP BY ALL
""",
    # Number family and region as a coarse line, so whole bases are met on some dates.
    "v_coarse": """
SELECT CASE WHEN mpn LIKE 'KX%' THEN 'KX' ELSE 'OTHER' END AS mpn, seller, CAST(observed_at AS DATE) AS date, arg_min(amount_minor, observation_id) AS amount_minor
FROM v_quoted WHERE status = 'eligible' GROUP BY ALL
""",
    "v_dayvalue": "SELECT date, CAST(typical_minor AS DECIMAL(38,10)) AS value FROM v_day",
    "v_contract": """
SELECT strftime(d, '%Y-%m') AS month, CAST(d AS DATE) AS required_date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM v_day)
WHERE day(d) IN (5, 15, 25)
""",
    "v_monthly": """
SELECT c.month, count(*) AS required, count(value) AS present, CASE WHEN count(*) = count(value) THEN sum(typical_minor) / count(*) END AS value
FROM v_contract c LEFT JOIN (SELECT date, typical_minor, 1 AS value FROM v_day) d ON d.date = c.required_date GROUP BY c.month
""",
})


def quoted(spark: SparkSession, root: str) -> DataFrame:
    o = observations(spark, root)
    from pricetrail.functions.reasons import reason_codes

    reasons = reason_codes([
        ("retailer_owned_seller_unresolved", F.col("k_part") % 23 == 0),
        ("vat_inclusion_unresolved", ~F.col("vat_included").eqNullSafe(F.lit(True))),
    ])
    return o.withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") == 0, F.lit("eligible")).otherwise(F.lit("abstain"))
    )


def coarse(spark: SparkSession, root: str) -> DataFrame:
    return ops.dated_lines(quoted(spark, root).withColumn("mpn", F.when(F.col("mpn").startswith("KX"), F.lit("KX")).otherwise(F.lit("OTHER"))))


COVERAGE_SQL = f"""
WITH l AS (SELECT mpn, seller, min(date) AS first_seen, max(CASE WHEN date = DATE '{BASE_DAY}' THEN CASE WHEN eligible THEN 'ok' ELSE 'bad' END END) AS base_state FROM v_lineday GROUP BY ALL),
g AS (SELECT l.*, d.date FROM l JOIN (SELECT DISTINCT date FROM v_lineday) d ON d.date >= l.first_seen),
p AS (SELECT mpn, seller, date AS prior, lead(date, 1, DATE '9999-01-01') OVER (PARTITION BY mpn, seller ORDER BY date) AS until FROM v_lineday WHERE eligible),
c AS (SELECT g.mpn, g.seller, g.date, CASE WHEN base_state = 'bad' THEN 'baseline_ineligible' WHEN base_state IS NULL THEN 'no_baseline_observation'
    WHEN v.eligible IS NULL THEN 'missing_current_observation_no_imputation' WHEN NOT v.eligible THEN 'current_observation_ineligible_no_imputation' ELSE 'eligible_paired_line' END AS status, p.prior
  FROM g LEFT JOIN v_lineday v ON v.mpn = g.mpn AND v.seller = g.seller AND v.date = g.date
  LEFT JOIN p ON p.mpn = g.mpn AND p.seller = g.seller AND p.prior < g.date AND p.until >= g.date)
"""


@register("base_coverage", COVERAGE_SQL + """
SELECT status, count(*) AS row_count, count(DISTINCT (mpn, seller)) AS line_count, count(CASE WHEN status LIKE 'missing%' THEN prior END) AS with_prior,
  CAST(sum(CASE WHEN status LIKE 'missing%' THEN date_diff('day', prior, date) END) AS BIGINT) AS stale_days FROM c GROUP BY status""")
def _(spark, root):
    daily = ops.dated_lines(quoted(spark, root))
    runs = ops.run_dates(ops.coverage_runs(daily, BASE_DAY), ops.observed_days(daily)).where("date_count > 0")
    per_line = runs.groupBy("status", "mpn", "seller").agg(
        F.sum("date_count").alias("n"), F.sum(F.when(F.col("last_eligible_date").isNotNull(), F.col("date_count")).otherwise(0)).alias("p"), F.sum("stale_days").alias("s")
    )
    return per_line.groupBy("status").agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("line_count"), F.sum("p").alias("with_prior"), F.sum("s").alias("stale_days")
    )


@register("base_coverage_lines", COVERAGE_SQL + """
SELECT mpn, seller, strftime(date, '%Y-%m-%d') AS date, status, CASE WHEN status LIKE 'missing%' THEN strftime(prior, '%Y-%m-%d') END AS last_eligible_date,
  CASE WHEN status LIKE 'missing%' THEN date_diff('day', prior, date) END AS stale_days FROM c WHERE status NOT IN ('no_baseline_observation', 'baseline_ineligible')""")
def _(spark, root):
    c = ops.base_coverage(ops.dated_lines(quoted(spark, root)), BASE_DAY)
    return c.where("status NOT IN ('no_baseline_observation', 'baseline_ineligible')").withColumns(
        {"date": F.col("date").cast("string"), "last_eligible_date": F.col("last_eligible_date").cast("string")}
    )


@register("base_coverage_by_date", COVERAGE_SQL + f"""
, base AS (SELECT count(*) AS d FROM c WHERE date = DATE '{BASE_DAY}' AND status = 'eligible_paired_line'),
per AS (SELECT date, d, count(*) FILTER (WHERE status = 'eligible_paired_line') AS n FROM c CROSS JOIN base GROUP BY date, d)
SELECT strftime(date, '%Y-%m-%d') AS date, d AS baseline_eligible_line_count, n AS eligible_paired_line_count,
  CASE WHEN d = 0 THEN 0 ELSE (20000 * n + d) // (2 * d) END AS coverage_basis_points,
  CASE WHEN d > 0 AND n = d THEN 'calculable_complete_base_basket_without_imputation'
    WHEN n > 0 THEN 'abstain_incomplete_base_basket_coverage' ELSE 'abstain_no_eligible_paired_lines' END AS quality_state
FROM per""")
def _(spark, root):
    daily = ops.dated_lines(quoted(spark, root))
    per = ops.coverage_by_date(ops.coverage_runs(daily, BASE_DAY), daily)
    return per.select(F.col("date").cast("string").alias("date"), "baseline_eligible_line_count", "eligible_paired_line_count", "coverage_basis_points", "quality_state")


@register("base_coverage_counts", COVERAGE_SQL + """
SELECT strftime(date, '%Y-%m-%d') AS date, count(*) FILTER (WHERE status = 'eligible_paired_line') AS eligible_paired_line_count,
  count(*) FILTER (WHERE status LIKE 'missing%') AS missing_current_observation_no_imputation_count, count(*) FILTER (WHERE status LIKE 'current%') AS current_observation_ineligible_no_imputation_count,
  count(*) FILTER (WHERE status LIKE 'no_base%') AS no_baseline_observation_count, count(*) FILTER (WHERE status = 'baseline_ineligible') AS baseline_ineligible_count
FROM c GROUP BY date""")
def _(spark, root):
    daily = ops.dated_lines(quoted(spark, root))
    per = ops.coverage_by_date(ops.coverage_runs(daily, BASE_DAY), daily)
    return per.select(F.col("date").cast("string").alias("date"), *[f"{s}_count" for s in [*ops.BASED, *ops.UNBASED]])


@register("base_coverage_runs", f"""
WITH q AS (SELECT mpn, seller, CAST(observed_at AS DATE) AS date, bool_or(status = 'eligible') AS eligible,
    coalesce(min(observation_id) FILTER (WHERE status = 'eligible'), min(observation_id)) AS id, coalesce(arg_min(reasons, observation_id) FILTER (WHERE status = 'eligible'), arg_min(reasons, observation_id)) AS reasons
  FROM v_quoted GROUP BY ALL),
b AS (SELECT mpn, seller, eligible AS base_eligible, id AS base_id, reasons AS base_reasons FROM q WHERE date = DATE '{BASE_DAY}'),
z AS (SELECT max(date) AS last_day FROM q),
r AS (SELECT q.*, base_eligible, base_id, base_reasons, last_day, row_number() OVER w AS nth, lead(date) OVER w AS next_date, max(CASE WHEN eligible THEN date END) OVER w AS upto
  FROM q LEFT JOIN b ON b.mpn = q.mpn AND b.seller = q.seller CROSS JOIN z WINDOW w AS (PARTITION BY q.mpn, q.seller ORDER BY date)),
o AS (
  SELECT mpn, seller, date AS s, last_day AS e, CASE WHEN base_eligible IS NULL THEN 'no_baseline_observation' ELSE 'baseline_ineligible' END AS status,
    coalesce(base_reasons, 'no_observation_on_immutable_base_date') AS reasons, NULL AS prior, NULL AS base_id, NULL AS now_id FROM r WHERE nth = 1 AND base_eligible IS DISTINCT FROM true
  UNION ALL SELECT mpn, seller, date, date, CASE WHEN eligible THEN 'eligible_paired_line' ELSE 'current_observation_ineligible_no_imputation' END, CASE WHEN eligible THEN '' ELSE reasons END, NULL, base_id, id FROM r WHERE base_eligible
  UNION ALL SELECT mpn, seller, date + 1, coalesce(next_date - 1, last_day), 'missing_current_observation_no_imputation', 'no_same_date_observation', upto, base_id, NULL FROM r WHERE base_eligible AND coalesce(next_date - 1, last_day) > date)
SELECT mpn, seller, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date, status, reasons, strftime(prior, '%Y-%m-%d') AS last_eligible_date, base_id AS base_observation_id, now_id AS current_observation_id FROM o""")
def _(spark, root):
    runs = ops.coverage_runs(ops.dated_lines(quoted(spark, root)), BASE_DAY)
    text = {c: F.col(c).cast("string") for c in ("start_date", "end_date", "last_eligible_date")}
    return runs.withColumns(text | {"reasons": F.array_join("reasons", ",")})


@register("fixed_base_relative", f"""
WITH b AS (SELECT mpn, seller, amount_minor AS base_minor FROM v_coarse WHERE date = DATE '{BASE_DAY}')
SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS eligible_line_count,
  CAST(floor(sum(CAST(amount_minor AS DOUBLE) / base_minor) / count(*) * 100000000 + 0.5) AS BIGINT) AS level_micros
FROM v_coarse JOIN b USING (mpn, seller) GROUP BY date HAVING count(*) = (SELECT count(*) FROM b)""")
def _(spark, root):
    return ops.fixed_base_levels(coarse(spark, root), BASE_DAY).withColumn("date", F.col("date").cast("string"))


@register("fixed_base_terms", f"""
WITH b AS (SELECT mpn, seller, amount_minor AS base_minor FROM v_coarse WHERE date = DATE '{BASE_DAY}'),
p AS (SELECT date, base_minor, CAST(sum(amount_minor) AS BIGINT) AS num, count(*) AS n FROM v_coarse JOIN b USING (mpn, seller) GROUP BY ALL),
t AS (SELECT date, base_minor // gcd(num, base_minor) AS den, num // gcd(num, base_minor) AS num FROM p WHERE date IN (SELECT date FROM p GROUP BY date HAVING sum(n) = (SELECT count(*) FROM b)))
SELECT strftime(date, '%Y-%m-%d') AS date, den AS denominator, CAST(sum(num) AS BIGINT) AS numerator FROM t GROUP BY ALL""")
def _(spark, root):
    terms = ops.fixed_base_terms(coarse(spark, root), BASE_DAY)
    return terms.select(F.col("date").cast("string").alias("date"), F.col("denominator").cast("long").alias("denominator"), F.col("numerator").cast("long").alias("numerator"))


@register("fixed_base_fractions")
def _(spark, root):
    return ops.fixed_base_relative(coarse(spark, root), BASE_DAY).withColumn("date", F.col("date").cast("string"))


def day_values(spark: SparkSession, root: str) -> DataFrame:
    return settled_days(spark, root).select("date", F.col("typical_minor").cast("decimal(38,10)").alias("value"))


def contracts(days: DataFrame) -> DataFrame:
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("z"))
    d = span.select(F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 DAY"))).alias("required_date"))
    return d.where(F.dayofmonth("required_date").isin(5, 15, 25)).select(F.date_format("required_date", "yyyy-MM").alias("month"), "required_date")


def months(spark: SparkSession, root: str) -> DataFrame:
    days = day_values(spark, root)
    return settle(ops.monthly_complete_mean(days, contracts(days)))


@register("monthly_complete_mean", """
SELECT month, CASE WHEN required = present THEN 'AVAILABLE' ELSE 'UNAVAILABLE_MONTH_INCOMPLETE' END AS quality_state, floor(value * 10000 + 0.5) / 10000 AS value,
  required - present AS missing_date_count FROM v_monthly""")
def _(spark, root):
    v = F.col("value").cast("double")
    return months(spark, root).withColumn("value", F.floor(v * 10000 + 0.5) / 10000).drop("exact")


def both_parts(df: DataFrame) -> DataFrame:
    """The exact fraction as two whole numbers."""
    return df.select("*", F.col("exact.num").cast("long").alias("numerator"), F.col("exact.den").cast("long").alias("denominator")).drop("exact", "value")


@register("monthly_mean_exact", """
SELECT month, quality_state, total // gcd(total, n) AS numerator, n // gcd(total, n) AS denominator, required - present AS missing_date_count FROM (
  SELECT c.month, count(*) AS required, count(typical_minor) AS present, CASE WHEN count(*) = count(typical_minor) THEN 'AVAILABLE' ELSE 'UNAVAILABLE_MONTH_INCOMPLETE' END AS quality_state,
    CASE WHEN count(*) = count(typical_minor) THEN CAST(sum(typical_minor) AS BIGINT) END AS total, CASE WHEN count(*) = count(typical_minor) THEN count(*) END AS n
  FROM v_contract c LEFT JOIN v_day d ON d.date = c.required_date GROUP BY c.month)""")
def _(spark, root):
    return both_parts(months(spark, root))


@register("missing_contract_dates", "SELECT month, strftime(required_date, '%Y-%m-%d') AS required_date FROM v_contract WHERE required_date NOT IN (SELECT date FROM v_day)")
def _(spark, root):
    days = day_values(spark, root)
    return ops.missing_contract_dates(days, contracts(days)).withColumn("required_date", F.col("required_date").cast("string"))


@register("check_contracts", """
SELECT 'required_date_in_other_month' AS rule, CASE WHEN day(required_date) = 25 THEN '1990-01' END || '|' || strftime(required_date, '%Y-%m-%d') AS key, '' AS detail FROM v_contract WHERE day(required_date) = 25
UNION ALL SELECT 'required_date_not_unique', month || '|' || strftime(required_date, '%Y-%m-%d'), '2' FROM v_contract WHERE day(required_date) = 5""")
def _(spark, root):
    c = contracts(day_values(spark, root))
    moved = c.withColumn("month", F.when(F.dayofmonth("required_date") == 25, F.lit("1990-01")).otherwise(F.col("month")))
    return ops.check_contracts(stacked(moved, c.where(F.dayofmonth("required_date") == 5)))


def reference_months(m: DataFrame, year: int) -> DataFrame:
    return m.where(F.col("month").startswith(str(year))).where("value IS NOT NULL").select("month")


@register("reference_level", """
SELECT 'AVAILABLE' AS quality_state, floor(avg(value) * 10000 + 0.5) / 10000 AS value, 0 AS missing_month_count FROM v_monthly WHERE month LIKE '1998%' AND value IS NOT NULL""")
def _(spark, root):
    m = months(spark, root)
    level = ops.reference_level(m, reference_months(m, 1998))
    return level.withColumn("value", F.floor(F.col("value").cast("double") * 10000 + 0.5) / 10000).drop("exact")


@register("reference_level_missing", """
SELECT CASE WHEN count(*) = count(value) THEN 'AVAILABLE' ELSE 'UNAVAILABLE_HISTORICAL_REFERENCE_INPUT' END AS quality_state,
  CASE WHEN count(*) = count(value) THEN floor(avg(value) * 10000 + 0.5) / 10000 END AS value, count(*) - count(value) AS missing_month_count FROM v_monthly""")
def _(spark, root):
    m = months(spark, root)
    level = ops.reference_level(m, m.select("month"))
    return level.withColumn("value", F.floor(F.col("value").cast("double") * 10000 + 0.5) / 10000).drop("exact")


@register("rebase_100", """
WITH r AS (SELECT avg(value) AS reference FROM v_monthly WHERE month LIKE '1998%' AND value IS NOT NULL)
SELECT month, CASE WHEN value IS NULL OR reference IS NULL THEN 'UNAVAILABLE_HISTORICAL_REFERENCE_INPUT' ELSE 'AVAILABLE' END AS quality_state,
  floor(value * 100 / reference * 1000 + 0.5) / 1000 AS value FROM v_monthly, r""")
def _(spark, root):
    m = months(spark, root)
    based = ops.rebase_100(m, ops.reference_level(m, reference_months(m, 1998)))
    return based.withColumn("value", F.floor(F.col("value") * 1000 + 0.5) / 1000).drop("exact")


#: Months with their mean as total over count, and the reference of a year as total over count: all contracts have as many dates.
EXACT_MONTHS = """e AS (SELECT c.month, CASE WHEN count(*) = count(typical_minor) THEN CAST(sum(typical_minor) AS HUGEINT) END AS total, count(*) AS n FROM v_contract c LEFT JOIN v_day d ON d.date = c.required_date GROUP BY c.month),
ref AS (SELECT sum(total * (6 // n)) AS rn, 6 * count(*) AS rd FROM e WHERE month LIKE '1998%' AND total IS NOT NULL)"""


@register("reference_level_exact", f"WITH {EXACT_MONTHS} SELECT 'AVAILABLE' AS quality_state, CAST(rn // gcd(CAST(rn AS HUGEINT), CAST(rd AS HUGEINT)) AS BIGINT) AS numerator, CAST(rd // gcd(CAST(rn AS HUGEINT), CAST(rd AS HUGEINT)) AS BIGINT) AS denominator, 0 AS missing_month_count FROM ref")
def _(spark, root):
    m = months(spark, root)
    return both_parts(ops.reference_level(m, reference_months(m, 1998)))


@register("rebase_100_exact", f"""
WITH {EXACT_MONTHS}, f AS (SELECT month, CAST(100 * total * rd AS HUGEINT) AS a, CAST(n * rn AS HUGEINT) AS b FROM e, ref)
SELECT month, CASE WHEN a IS NULL THEN 'UNAVAILABLE_HISTORICAL_REFERENCE_INPUT' ELSE 'AVAILABLE' END AS quality_state, CAST(a // gcd(a, b) AS BIGINT) AS numerator,
  CASE WHEN a IS NOT NULL THEN CAST(b // gcd(a, b) AS BIGINT) END AS denominator, CAST((a * 2000000 + b) // (2 * b) AS BIGINT) AS micros FROM f""")
def _(spark, root):
    m = months(spark, root)
    based = ops.rebase_100(m, ops.reference_level(m, reference_months(m, 1998)))
    return both_parts(based.withColumn("micros", F.round(F.col("value") * 1000000).cast("long")))


DEFLATOR = [(f"{y}-{m:02d}", "rel-1", "final", 100 + (y - 1995) * 3 + m / 4) for y in range(1995, 2001) for m in range(1, 13)]
DEFLATOR_SQL = "(SELECT * FROM (VALUES " + ", ".join(repr(r) for r in DEFLATOR) + ") AS d(month, release_vintage_id, observation_status, value))"


def deflator(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "month string, release_vintage_id string, observation_status string, value double", DEFLATOR)


@register("check_deflator", f"""
WITH d AS (SELECT strftime(m, '%Y-%m') AS month, n, v, CASE WHEN n % 6 = 0 THEN 'rel-2' ELSE 'rel-1' END AS rel FROM
  (SELECT date_trunc('month', observed_at) AS m, count(*) AS n, min(amount_minor) AS v FROM v_lines GROUP BY 1))
SELECT 'mixed_release_vintage_observation' AS rule, month AS key, '' AS detail FROM d WHERE n % 6 = 0
UNION ALL SELECT 'deflator_value_not_positive', month, '' FROM d WHERE v % 4 = 0
UNION ALL SELECT 'duplicate_observation_month', month, '2' FROM d WHERE n % 7 = 0
UNION ALL SELECT 'mixed_release_vintage_observation', month, '' FROM d WHERE n % 7 = 0 AND n % 6 = 0 UNION ALL SELECT 'deflator_value_not_positive', month, '' FROM d WHERE n % 7 = 0 AND v % 4 = 0""")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    d = lines(spark, root).groupBy(F.date_format("observed_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("amount_minor").alias("v")).select(
        "month", F.when(F.col("n") % 6 == 0, F.lit("rel-2")).otherwise(F.lit("rel-1")).alias("release_vintage_id"), F.lit("final").alias("observation_status"),
        F.when(F.col("v") % 4 == 0, F.lit(0)).otherwise(F.col("v")).alias("value"), "n",
    )
    return ops.check_deflator(stacked(d, d.where("n % 7 = 0")), "rel-1")


@register("check_deflator_release", """
WITH r AS (SELECT 'rel-' || o_orderkey AS release_id, o_orderkey AS k FROM orders)
SELECT 'release_date_malformed' AS rule, release_id AS key, '' AS detail FROM r WHERE k % 11 = 1 UNION ALL SELECT 'retrieved_at_not_utc', release_id, '' FROM r WHERE k % 13 = 2
UNION ALL SELECT 'capture_not_digest', release_id, '' FROM r WHERE k % 17 = 3 UNION ALL SELECT 'parser_version_missing', release_id, '' FROM r WHERE k % 19 = 4
UNION ALL SELECT 'series_title_missing', release_id, '' FROM r WHERE k % 23 = 5 UNION ALL SELECT 'series_adjustment_status_missing', release_id, '' FROM r WHERE k % 29 = 6
UNION ALL SELECT 'series_not_monthly_index', release_id, '' FROM r WHERE k % 31 = 7 UNION ALL SELECT 'series_source_not_https', release_id, '' FROM r WHERE k % 37 = 8""")
def _(spark, root):
    k = F.col("o_orderkey")
    unless = lambda m, r, good, bad: F.when(k % m == r, F.lit(bad)).otherwise(good)
    text, day = F.lit, F.date_format("o_orderdate", "yyyy-MM-dd")
    return ops.check_deflator_release(table(spark, root, "orders").select(
        F.concat(F.lit("rel-"), k.cast("string")).alias("release_id"), unless(11, 1, day, "1 March").alias("release_date"),
        unless(13, 2, F.concat(day, F.lit("T09:00:00Z")), "2024-01-01T09:00:00+01:00").alias("retrieved_at"), unless(17, 3, F.sha2(k.cast("string"), 256), "none").alias("capture_sha256"),
        unless(19, 4, text("v1"), None).alias("parser_version"), text("office").alias("provider"), text("L55O").alias("series_code"), unless(23, 5, text("Prices"), " ").alias("title"),
        unless(29, 6, text("unadjusted"), None).alias("adjustment_status"), unless(31, 7, text("monthly"), "quarterly").alias("frequency"), text("index_points").alias("unit"),
        unless(37, 8, text("https://office.example/l55o"), "http://office.example/l55o").alias("canonical_source_url"),
    ))


@register("constant_price", f"""
SELECT m.month, floor(m.value * (SELECT value FROM {DEFLATOR_SQL} WHERE month = '1998-01') / d.value * 100 + 0.5) / 100 AS value,
  CASE WHEN m.value IS NULL THEN 'monthly_nominal_unavailable' WHEN d.value IS NULL THEN 'observation_month_missing' END AS unavailable_reason
FROM v_monthly m LEFT JOIN {DEFLATOR_SQL} d ON d.month = m.month""")
def _(spark, root):
    real = ops.constant_price(months(spark, root), deflator(spark), "1998-01")
    return real.withColumn("value", F.floor(F.col("value") * 100 + 0.5) / 100).drop("exact")


@register("constant_price_exact", f"""
WITH {EXACT_MONTHS}, d AS (SELECT month, CAST(value * 4 AS HUGEINT) AS q, month LIKE '%-05' AS doubled FROM {DEFLATOR_SQL}),
f AS (SELECT e.month, total, CASE WHEN NOT doubled THEN CAST(total * (SELECT q FROM d WHERE month = '1998-01') AS HUGEINT) END AS a, CASE WHEN NOT doubled THEN CAST(n * q AS HUGEINT) END AS b, q, doubled
  FROM e LEFT JOIN d ON d.month = e.month)
SELECT month, CAST(a // gcd(a, b) AS BIGINT) AS numerator, CASE WHEN a IS NOT NULL THEN CAST(b // gcd(a, b) AS BIGINT) END AS denominator, CAST((a * 20000 + b) // (2 * b) AS BIGINT) AS ten_thousandths,
  CASE WHEN total IS NULL THEN 'monthly_nominal_unavailable' WHEN doubled THEN 'duplicate_observation_month' WHEN q IS NULL THEN 'observation_month_missing' END AS unavailable_reason FROM f""")
def _(spark, root):
    d = deflator(spark)
    real = ops.constant_price(months(spark, root), stacked(d, d.where("month LIKE '%-05'")), "1998-01")
    return both_parts(real.withColumn("ten_thousandths", F.round(F.col("value") * 10000).cast("long")))


@register("revision_impact", """
SELECT month, round((CASE WHEN month < '1999-01' THEN 1.0 ELSE 1.5 END - 1.0) * value, 2) AS impact,
  CASE WHEN value IS NULL OR month LIKE '2000%' THEN 'UNAVAILABLE_REVISION_COMPARISON_INPUT' ELSE 'AVAILABLE_ADDITIVE_IMPACT' END AS quality_state
FROM (SELECT month, CASE WHEN month NOT LIKE '2000%' THEN value END AS value FROM v_monthly)""")
def _(spark, root):
    earlier = months(spark, root).select("month", F.col("value").cast("double").alias("value"))
    later = earlier.withColumn("value", F.col("value") * F.when(F.col("month") < "1999-01", 1.0).otherwise(1.5))
    return ops.revision_impact(earlier.where("month NOT LIKE '2000%'"), later).withColumn("impact", F.round("impact", 2))


def vintage(days: DataFrame, low: bool) -> DataFrame:
    """Daily low or high price as a native series; some days unavailable."""
    value = F.col("low_minor" if low else "high_minor")
    ok = F.col("typical_minor") % 10 != 0
    return days.select("date", F.when(ok, F.lit("AVAILABLE")).otherwise(F.lit("UNAVAILABLE_FIXTURE_GAP")).alias("state"), F.when(ok, value * 1000).alias("value"))


def overlap(days: DataFrame) -> DataFrame:
    a = vintage(days, True).select("date", F.col("value").alias("prior_value"))
    b = vintage(days, False).select("date", "state", F.col("value").alias("candidate_value"))
    return a.join(b, "date").where("date BETWEEN DATE'1998-06-01' AND DATE'1998-06-30'").withColumnRenamed("state", "quality_state")


VINTAGE = """native AS (SELECT date, CASE WHEN typical_minor % 10 <> 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE_FIXTURE_GAP' END AS state,
  CASE WHEN typical_minor % 10 <> 0 THEN low_minor * 1000 END AS lo, CASE WHEN typical_minor % 10 <> 0 THEN high_minor * 1000 END AS hi FROM v_day),
f AS (SELECT lo, hi FROM native WHERE state = 'AVAILABLE' AND date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' ORDER BY date LIMIT 1)"""


@register("link_vintage", f"""
WITH {VINTAGE}
SELECT 1 AS segment_no, strftime(date, '%Y-%m-%d') AS date, state, lo AS value FROM native WHERE date < DATE '1998-07-01'
UNION ALL SELECT 2, strftime(date, '%Y-%m-%d'), state, CAST((2 * CAST(native.hi AS HUGEINT) * f.lo + f.hi) // (2 * f.hi) AS BIGINT) FROM native, f WHERE date >= DATE '1998-07-01'""")
def _(spark, root):
    days = settled_days(spark, root)
    prior = vintage(days, True).where("date < DATE'1998-07-01'").withColumn("segment_no", F.lit(1).cast("long"))
    linked = ops.link_vintage(prior, vintage(days, False), overlap(days), "1998-07-01")
    return linked.withColumn("date", F.col("date").cast("string"))


@register("check_overlap", f"""
WITH {VINTAGE}
SELECT 'overlap_not_available' AS rule, strftime(date, '%Y-%m-%d') AS key, '' AS detail FROM native WHERE state <> 'AVAILABLE' AND date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30'
UNION ALL SELECT 'overlap_value_not_positive', strftime(date, '%Y-%m-%d'), '' FROM native WHERE lo IS NULL AND date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30'
UNION ALL SELECT 'overlap_date_not_unique', '1998-06-09', '2' FROM native WHERE date = DATE '1998-06-09'
UNION ALL SELECT 'overlap_not_available', '1998-06-09', '' FROM native WHERE state <> 'AVAILABLE' AND date = DATE '1998-06-09'
UNION ALL SELECT 'overlap_value_not_positive', '1998-06-09', '' FROM native WHERE lo IS NULL AND date = DATE '1998-06-09'""")
def _(spark, root):
    o = overlap(settled_days(spark, root))
    return ops.check_overlap(stacked(o, o.where("date = DATE'1998-06-09'")))


@register("check_prefix", f"""
WITH {VINTAGE}
SELECT 'point_not_before_boundary' AS rule, strftime(date, '%Y-%m-%d') AS key, '' AS detail FROM native WHERE date >= DATE '2001-01-01'
UNION ALL SELECT 'point_value_malformed', strftime(date, '%Y-%m-%d'), '' FROM native WHERE state <> 'AVAILABLE' AND day(date) = 1""")
def _(spark, root):
    points = vintage(settled_days(spark, root), True)
    spoiled = points.withColumn("value", F.when(F.dayofmonth("date") == 1, F.coalesce("value", F.lit(5))).otherwise(F.col("value")))
    return ops.check_prefix(spoiled, "2001-01-01")
