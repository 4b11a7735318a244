"""Publication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.periods import month_label
from pricetrail.functions.reasons import stacked
from pricetrail.operators import chain, movements, publish, series
from pricetrail.plans.ingest import readings
from pricetrail.plans.registry import register
from pricetrail.plans.series import BASE, HOLED_SQL, PRICES_SQL, holed_prices, index_sql, prices, summary
from pricetrail.sources.adapter import observations
from pricetrail.sources.tables import table


@register("project_index", index_sql(HOLED_SQL, 10, """
SELECT period_id, state, CAST(floor(index_value * 1000 + 0.5) AS BIGINT) AS index_milli, CAST(floor(link * 1000 + 0.5) AS BIGINT) AS link_permille,
  CAST(floor((link - 1) * 1000 + 0.5) AS BIGINT) AS change_permille, matched_product_count, distinct_products_in_period, reference_period AS is_reference FROM idx"""))
def _(spark, root):
    return publish.project_index(chain.matched_model_index(holed_prices(spark, root), BASE))


@register("project_index_summary", index_sql(PRICES_SQL, 10, """
, o AS (SELECT * FROM idx WHERE state = 'observed'), l AS (SELECT period_id, index_value FROM o ORDER BY period_id DESC LIMIT 1), r AS (SELECT index_value AS ref FROM o WHERE reference_period)
SELECT period_id AS latest_period, CAST(floor(index_value * 1000 + 0.5) AS BIGINT) AS latest_index_milli, CAST(floor((index_value / ref - 1) * 1000 + 0.5) AS BIGINT) AS change_from_reference_permille,
  CASE WHEN index_value > ref THEN 'higher' WHEN index_value < ref THEN 'lower' ELSE 'level' END AS direction FROM l, r"""))
def _(spark, root):
    return publish.project_index_summary(chain.matched_model_index(prices(spark, root), BASE))


POINTS_SQL = """SELECT mpn, strftime(month, '%Y-%m') AS month, CAST(floor(median_minor * CAST(1000 AS DOUBLE) / first_value(median_minor) OVER (PARTITION BY mpn ORDER BY month) + 0.5) AS BIGINT) AS relative_permille,
  seller_count, single_seller FROM v_points WHERE state = 'observed'"""


def product_points(spark: SparkSession, root: str) -> DataFrame:
    return publish.project_product_points(series.per_product_month_series(observations(spark, root)))


@register("project_product_points", POINTS_SQL)
def _(spark, root):
    return product_points(spark, root)


@register("project_products", f"""
SELECT s.mpn, month_count, seller_count, multi_seller_month_count, first_month, last_month, relative_permille - 1000 AS change_permille
FROM v_summary s JOIN ({POINTS_SQL.replace('seller_count, single_seller', 'single_seller')}) p ON p.mpn = s.mpn AND p.month = s.last_month WHERE month_count >= 12 AND seller_count >= 3""")
def _(spark, root):
    return publish.project_products(product_points(spark, root), summary(spark, root, 12, 3))


@register("excluded_below_floor", "SELECT count(*) AS excluded_below_floor_count FROM v_summary WHERE NOT (month_count >= 12 AND seller_count >= 3)")
def _(spark, root):
    return publish.excluded_below_floor(summary(spark, root), summary(spark, root, 12, 3))


def explanations(w: DataFrame) -> DataFrame:
    """A reviewed explanation for the larger movements."""
    return w.where("abs(delta_basis_points) > 5000").select(
        F.concat(F.lit("ex-"), "movement_id").alias("explanation_id"), "movement_id",
        F.concat(F.year("to_observed_at").cast("string"), F.lit("Q"), F.quarter("to_observed_at").cast("string")).alias("period_id"),
        F.lit("descriptive").alias("causal_language_level"), F.concat(F.lit("On "), "mpn").alias("source_title"), F.lit("not_stated_by_publisher").alias("source_author"),
        F.lit("A paper").alias("source_publisher"), F.lit("https://news.example/a").alias("source_url"), F.date_format("to_observed_at", "yyyy-MM-dd").alias("published_on"),
        F.col("comparison_basis"),
    )


EXPLAINED = """(SELECT 'ex-' || movement_id AS explanation_id, year(to_observed_at) || 'Q' || quarter(to_observed_at) AS period_id, 'On ' || mpn AS title, strftime(to_observed_at, '%Y-%m-%d') AS published_on, comparison_basis
  FROM v_widest WHERE abs(delta_basis_points) > 5000)"""


def widest(spark: SparkSession, root: str) -> DataFrame:
    return movements.widest_movements(observations(spark, root))


@register("project_events", f"""
SELECT 'ev-' || substring(sha256(explanation_id), 1, 12) AS marker_id, period_id, 'descriptive' AS causal_language_level, title, 'not_stated_by_publisher' AS author, 'A paper' AS publisher,
  'https://news.example/a' AS url, published_on FROM {EXPLAINED}""")
def _(spark, root):
    return publish.project_events(explanations(widest(spark, root)))


@register("event_counts", f"""
SELECT (SELECT count(*) FROM v_widest) AS movement_count, count(*) AS explained_movement_count, (SELECT count(*) FROM v_widest) - count(*) AS unexplained_movement_count,
  CASE WHEN (SELECT count(*) FROM v_widest) <> count(*) THEN 'pending_review' END AS pending_reason FROM {EXPLAINED}""")
def _(spark, root):
    w = widest(spark, root)
    return publish.event_counts(explanations(w), w)


@register("explanation_totals", f"""
SELECT (SELECT count(*) FROM v_widest) AS measured, (SELECT count(*) FROM {EXPLAINED}) AS markers, (SELECT count(*) FROM v_widest) - (SELECT count(*) FROM {EXPLAINED}) AS unexplained""")
def _(spark, root):
    w = widest(spark, root)
    e = explanations(w)
    per = [
        publish.event_counts(e.where(F.col("comparison_basis") == b), w.where(F.col("comparison_basis") == b)) for b in ("within_seller", "cross_seller")
    ]
    return publish.explanation_totals(stacked(*per))


@register("align_markers", f"""
SELECT 'ev-' || substring(sha256(explanation_id), 1, 12) AS marker_id, period_id, period_id IN (SELECT DISTINCT year(period) || 'Q' || quarter(period) FROM v_prices WHERE period >= DATE '2000-01-01') AS placed FROM {EXPLAINED}""")
def _(spark, root):
    markers = publish.project_events(explanations(widest(spark, root)))
    periods = chain.matched_model_index(prices(spark, root), BASE).where("period >= DATE'2000-01-01'")
    return publish.align_markers(markers, periods).select("marker_id", "period_id", "placed")


MARKER_FIELDS = ["event_id", "headline", "publisher", "author", "source_url", "publication_date", "event_date", "interpretation", "uncertainty", "counter_evidence", "revision"]


@register("event_line_contract", """
WITH e AS (SELECT 'm-' || event_id AS id, * FROM events)
SELECT 'source_url_not_https' AS rule, id AS key, '' AS detail FROM e WHERE event_type = 'error' UNION ALL SELECT 'headline_missing', id, '' FROM e WHERE value < 5
UNION ALL SELECT 'author_blank', id, '' FROM e WHERE value > 150 UNION ALL SELECT 'counter_evidence_missing', id, '' FROM e WHERE value > 100
UNION ALL SELECT 'empty_line_has_markers', 'empty_pending_review', CAST(count(*) AS VARCHAR) FROM e UNION ALL SELECT 'unknown_field_amount', 'columns', ''""")
def _(spark, root):
    v = F.col("value")
    markers = table(spark, root, "events").select(
        F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("event_id"), F.when(v < 5, F.lit("")).otherwise(F.lit("h")).alias("headline"), F.lit("p").alias("publisher"),
        F.when(v > 150, F.lit("")).when(v > 50, F.lit("a")).alias("author"),
        F.when(F.col("event_type") == "error", F.lit("http://a.example")).otherwise(F.lit("https://a.example")).alias("source_url"),
        F.date_format("ts", "yyyy-MM-dd").alias("publication_date"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"), F.lit("i").alias("interpretation"), F.lit("u").alias("uncertainty"),
        F.when(v > 100, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("counter_evidence"), F.lit(1).alias("revision"), v.alias("amount"),
    )
    return publish.event_line_contract(markers, "empty_pending_review", MARKER_FIELDS)


@register("assert_public_safe", """
WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE amount_minor % 100 = 0) AS gbp,
  count(*) FILTER (WHERE amount_minor % 100 <> 0) AS dp FROM v_lines)
SELECT 'not_in_public_schema' AS rule, 'low_price' AS key, '1' AS detail UNION ALL SELECT 'money_bearing_name', 'low_price', '1' UNION ALL SELECT 'non_integer_number', 'low_price', '1'
UNION ALL SELECT 'not_in_public_schema', 'note', '1' UNION ALL SELECT 'currency_text', 'note', CAST(gbp AS VARCHAR) FROM n WHERE gbp > 0 UNION ALL SELECT 'two_decimal_text', 'note', CAST(dp AS VARCHAR) FROM n WHERE dp > 0
UNION ALL SELECT 'two_decimal_text', 'low_price', CAST(count(*) AS VARCHAR) FROM v_lines WHERE (amount_minor % 100) % 10 <> 0""")
def _(spark, root):
    a = F.col("amount_minor")
    rows = observations(spark, root).select(
        "mpn", a.alias("relative_permille"), (a / 100).cast("decimal(20,2)").cast("double").alias("low_price"),
        F.when(a % 100 == 0, F.lit("in GBP terms")).otherwise(F.format_string("about %d.%02d", F.floor(a / 100), a % 100)).alias("note"),
    )
    return publish.assert_public_safe(rows, ["mpn", "relative_permille"])


@register("private_tokens", """
SELECT DISTINCT token FROM (SELECT unnest([observation_id, source_url, CASE WHEN amount_minor > 100 THEN '£' || f END, CASE WHEN amount_minor > 100 THEN f END, CASE WHEN amount_minor > 100 THEN 'GBP ' || f END]) AS token
  FROM (SELECT *, (amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS f FROM v_offer)) WHERE token IS NOT NULL""")
def _(spark, root):
    from pricetrail.sources.adapter import offer_observations

    return publish.private_tokens(offer_observations(spark, root).select("observation_id", "source_url", "mpn", "amount_minor"), "amount_minor")


@register("reason_tokens", "SELECT DISTINCT token FROM (SELECT unnest([rejection, reason]) AS token FROM v_triaged) WHERE regexp_matches(token, '^[A-Z][A-Z0-9_]{5,}$')")
def _(spark, root):
    from pricetrail.operators.ingest import triage_readings

    return publish.reason_tokens(triage_readings(readings(spark, root)), ["reasons", "rejection"])


@register("private_json_tokens", """
SELECT DISTINCT token FROM (SELECT unnest([observation_id, source_url, CASE WHEN amount_minor > 100 THEN '£' || f END, CASE WHEN amount_minor > 100 THEN f END, CASE WHEN amount_minor > 100 THEN 'GBP ' || f END]) AS token
  FROM (SELECT *, (amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS f FROM v_offer)) WHERE token IS NOT NULL""")
def _(spark, root):
    from pricetrail.sources.adapter import offer_observations

    price = F.struct("amount_minor", F.lit("GBP").alias("currency"))
    held = F.struct("observation_id", "mpn", price.alias("item_price"), F.array(F.col("mpn")).alias("legal_name"), F.struct("amount_minor").alias("delivery"))
    document = F.to_json(F.struct(F.array(F.array(held)).alias("parts"), F.struct(F.struct("source_url").alias("page")).alias("seen"), F.lit(7).alias("review_id")))
    return publish.private_json_tokens(offer_observations(spark, root).select(document.alias("body")), "body")


@register("reason_json_tokens", "SELECT DISTINCT token FROM (SELECT unnest([rejection, reason]) AS token FROM v_triaged) WHERE regexp_matches(token, '^[A-Z][A-Z0-9_]{5,}$')")
def _(spark, root):
    from pricetrail.operators.ingest import triage_readings

    counts = F.map_from_arrays(F.array(F.col("rejection")), F.array(F.lit(1)))
    deep = F.struct(F.when(F.col("rejection").isNotNull(), counts).alias("abstention_reasons"), F.lit("NOT_A_REASON").alias("note"))
    document = F.to_json(F.struct(F.array(F.struct("reasons")).alias("rows"), deep.alias("run")))
    return publish.reason_json_tokens(triage_readings(readings(spark, root)).select(document.alias("body")), "body")


@register("assert_public_safe_tokens", """
WITH t AS (SELECT DISTINCT token FROM (SELECT unnest(string_split(text, '. ')) AS token FROM benchmark) WHERE length(token) > 12 AND NOT contains(token, chr(10)) AND NOT contains(token, '"') AND NOT contains(token, chr(92))),
h AS (SELECT token, count(*) AS n FROM documents JOIN t ON contains(text, token) GROUP BY token), c AS (SELECT DISTINCT upper(lang) || '_DOCUMENT' AS code FROM documents WHERE lang IS NOT NULL)
SELECT 'private_token' AS rule, token AS key, CAST(n AS VARCHAR) AS detail FROM h
UNION ALL SELECT 'reason_code', code, (SELECT CAST(count(*) AS VARCHAR) FROM documents WHERE upper(lang) || '_DOCUMENT' = code AND doc_id % 3 = 0) FROM c
UNION ALL SELECT 'not_in_public_schema', 'note', '1'""")
def _(spark, root):
    docs = table(spark, root, "documents")
    code = F.concat(F.upper("lang"), F.lit("_DOCUMENT"))
    plain = F.length("token") > 12
    for sign in ("\n", '"', "\\"):
        plain = plain & ~F.contains("token", F.lit(sign))
    tokens = table(spark, root, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("token")).where(plain)
    rows = docs.select(F.struct(F.col("text").alias("headline")).alias("item"), F.when(F.col("doc_id") % 3 == 0, code).alias("note"))
    codes = docs.where("lang IS NOT NULL").select(code.alias("token")).distinct()
    found = publish.assert_public_safe(rows, ["item", "headline"], tokens, codes)
    return found.where("rule NOT IN ('currency_text', 'two_decimal_text')")


@register("leak_scan", """
WITH t AS (SELECT DISTINCT token FROM (SELECT unnest(string_split(text, '. ')) AS token FROM benchmark) WHERE length(token) > 0)
SELECT doc_id AS text_id, token FROM documents JOIN t ON contains(text, token)""")
def _(spark, root):
    tokens = table(spark, root, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("token"))
    return publish.leak_scan(table(spark, root, "documents").select(F.col("doc_id").alias("text_id"), "text"), tokens)


SECRET_SQL = " UNION ALL ".join(
    f"SELECT text_id, '{kind}' AS kind, len(regexp_extract_all(text, '{shape.replace(chr(39), chr(39) * 2)}')) AS hits FROM t WHERE regexp_matches(text, '{shape.replace(chr(39), chr(39) * 2)}')"
    for kind, shape in publish.SECRET_SHAPES.items()
)


@register("secret_scan", f"""
WITH t AS (SELECT doc_id AS text_id, text || CASE WHEN doc_id % 50 = 1 THEN ' Authorization: Bearer ' || sha256('' || doc_id) WHEN doc_id % 50 = 2 THEN ' ftp://u' || doc_id || ':pw@host.example/' ELSE '' END AS text FROM documents)
{SECRET_SQL}""")
def _(spark, root):
    i = F.col("doc_id")
    planted = (
        F.when(i % 50 == 1, F.concat(F.lit(" Authorization: Bearer "), F.sha2(i.cast("string"), 256)))
        .when(i % 50 == 2, F.concat(F.lit(" ftp://u"), i.cast("string"), F.lit(":pw@host.example/"))).otherwise(F.lit(""))
    )
    return publish.secret_scan(table(spark, root, "documents").select(i.alias("text_id"), F.concat("text", planted).alias("text")))
