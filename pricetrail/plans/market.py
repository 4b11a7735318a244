"""Offer and daily market queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.periods import instant_text
from pricetrail.functions.reasons import stacked
from pricetrail.operators import market
from pricetrail.plans.registry import register
from pricetrail.plans.views import AVAILABLE, VIEWS
from pricetrail.session import settle
from pricetrail.sources.adapter import catalogue, evidence_ledger, offer_observations, retailers, stated_ledger, stated_offers, stated_retailers

SENTINELS = [9999999]


def policy(spark: SparkSession, root: str) -> DataFrame:
    return catalogue(spark, root).where("k_size <= 30").select(
        F.col("mpn_normalized").alias("mpn"), F.concat(F.lit("review-"), (F.col("k_part") % 2).cast("string")).alias("review_id")
    )


def reviews(spark: SparkSession, root: str) -> DataFrame:
    return catalogue(spark, root).where("k_size % 10 <> 7").select(
        F.concat(F.lit("review-"), (F.col("k_part") % 2).cast("string")).alias("review_id"), "product_key"
    )


def approved(spark: SparkSession, root: str) -> DataFrame:
    return market.approved_products(catalogue(spark, root), policy(spark, root), reviews(spark, root))


def qualified_offers(spark: SparkSession, root: str, accepted_only: bool = False, slim: bool = False) -> DataFrame:
    # Written, so that Spark knows how few the products are next to the observations.
    return market.qualify_offer(
        offer_observations(spark, root), settle(approved(spark, root)), evidence_ledger(spark, root), retailers(spark, root), accepted_only, slim
    )


def candidates(qualified: DataFrame) -> DataFrame:
    """Accepted rows plus exact copies and clashing copies of some of them."""
    base = market.offer_candidates(qualified)
    price = F.col("item_price_minor")
    kinds = F.array_compact(F.array(
        F.lit(""), F.when(price % 9 == 0, F.lit("-copy")), F.when(price % 9 == 1, F.lit("-clash"))
    ))
    return base.withColumn("kind", F.explode(kinds)).withColumns({
        "observation_id": F.concat("observation_id", "kind"),
        "item_price_minor": price + F.when(F.col("kind") == "-clash", 1).otherwise(0),
    }).drop("kind")


def offers(spark: SparkSession, root: str) -> DataFrame:
    """The published table, written once; everything after it starts from there."""
    return settle(market.public_offers(candidates(qualified_offers(spark, root, accepted_only=True))))


def day_rows(spark: SparkSession, root: str) -> DataFrame:
    return market.daily_offers(offers(spark, root), SENTINELS)


def daily(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    # Read by several folds, none of which looks at the offer's id or time.
    rows = settle(day_rows(spark, root).drop("public_observation_id", "observed_at"))
    return market.daily_market(rows, approved(spark, root)), market.daily_products(rows)


def settled_days(spark: SparkSession, root: str) -> DataFrame:
    """The daily table, one row per calendar day, written once for plans that read it repeatedly."""
    return settle(daily(spark, root)[0])


def dated(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


STAMP = "strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at"


@register("approved_products", "SELECT * FROM v_approved")
def _(spark, root):
    return approved(spark, root)


@register("check_approvals", """
SELECT CASE WHEN r.product_key IS NULL THEN 'approved_product_not_reviewed' ELSE 'approved_product_out_of_scope' END AS rule, p.mpn AS key, '' AS detail
FROM v_policy p JOIN v_catalogue c ON c.mpn_normalized = p.mpn LEFT JOIN v_review r ON r.review_id = p.review_id AND r.product_key = c.product_key
WHERE r.product_key IS NULL OR NOT (memory_generation = 'DDR5' AND total_capacity_gb = 32 AND module_count = 2 AND form_factor = 'UDIMM')
UNION ALL SELECT 'approved_product_not_in_catalogue', mpn || '-GONE', '' FROM v_policy WHERE mpn LIKE 'ZZ-%'""")
def _(spark, root):
    p = policy(spark, root)
    gone = p.where(F.col("mpn").startswith("ZZ-")).withColumn("mpn", F.concat(F.col("mpn"), F.lit("-GONE")))
    return market.check_approvals(catalogue(spark, root), stacked(p, gone), reviews(spark, root))


@register("qualify_offer", "SELECT observation_id, retailer_id, stock, reasons FROM v_offer_q")
def _(spark, root):
    return qualified_offers(spark, root).select("observation_id", "retailer_id", "stock", F.array_join("reasons", ",").alias("reasons"))


VIEWS.update({
    "v_stated": """
SELECT * REPLACE (CASE WHEN k_part % 61 <> 0 THEN seller_relationship END AS seller_relationship), observed_at + CASE WHEN k_part % 59 = 0 THEN INTERVAL (-1) SECOND ELSE INTERVAL 1 DAY END AS created_at,
  CASE WHEN k_part % 67 = 0 THEN mpn || 'P' ELSE mpn END AS product_mpn, k_part % 71 > 3 AS right_kit,
  CASE WHEN k_part % 79 = 0 THEN sha256('x') WHEN k_part % 79 > 40 THEN sha256(evidence_id) END AS stated_sha,
  CASE WHEN k_part % 83 = 0 THEN 1 WHEN k_part % 83 > 40 THEN length(source_url) END AS stated_bytes,
  CASE WHEN k_part % 89 = 0 THEN source_url || 'x' WHEN k_part % 89 > 40 THEN source_url END AS stated_archive
FROM (SELECT * REPLACE (CASE WHEN NOT archived AND k_part % 97 = 0 THEN replace(source_url, 'https://www.' || shop || '.example/', 'HTTPS://WWW.' || upper(shop) || '.EXAMPLE:443/')
    WHEN NOT archived AND k_part % 97 = 1 THEN replace(source_url, 'https://www.' || shop || '.example/', 'https://www.' || shop || '.example:8443/')
    WHEN k_part % 7 = 0 THEN replace(source_url, 'https://www.' || shop || '.example/', 'https://shop.' || shop || '.example/')
    WHEN NOT archived AND k_part % 97 = 2 THEN replace(source_url, 'https://www.' || shop || '.example/', 'https://me@www.' || shop || '.example/') ELSE source_url END AS source_url)
  FROM (SELECT *, lower(replace(seller_display_name, '_', '-')) AS shop FROM v_offer))
""",
    # An offer's own entry by evidence id, or by address, time and seller: several offers of a seller can share the latter.
    "v_stated_match": """
SELECT observation_id, count(entry) AS entry_count, CASE WHEN count(entry) = 1 THEN bool_and(right_kit AND fact_capacity = 32 AND fact_modules = 2 AND fact_mpn = mpn AND fact_amount = amount_minor AND fact_currency = currency
    AND fact_vat = (vat_state = 'included') AND seen_at = observed_at AND coalesce(stated_sha = held_sha, true) AND coalesce(stated_bytes = held_bytes, true) AND (NOT archived OR coalesce(stated_archive = held_archive, true))) END AS facts_equal
FROM (WITH l AS (SELECT evidence_id AS entry, seller_display_name AS l_seller, source_url AS l_url, observed_at AS l_time, archived AS l_archived, observed_at + CASE WHEN k_part % 101 = 0 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS captured,
    sha256(evidence_id) AS held_sha, length(source_url) AS held_bytes, source_url AS held_archive, mpn AS fact_mpn, amount_minor AS fact_amount, currency AS fact_currency, vat_state = 'included' AS fact_vat,
    CASE WHEN k_part % 73 = 0 THEN 16 WHEN k_part % 73 <> 1 THEN 32 ELSE 0 END AS fact_capacity, CASE WHEN k_part % 73 = 2 THEN 4 ELSE 2 END AS fact_modules FROM v_stated WHERE k_part % 29 <> 0)
  SELECT o.*, l.*, captured AS seen_at FROM v_stated o LEFT JOIN l ON l.entry = o.evidence_id WHERE o.archived
  UNION ALL SELECT o.*, l.*, l_time AS seen_at FROM v_stated o LEFT JOIN l ON l_url = o.source_url AND l_time = o.observed_at AND l_seller = o.seller_display_name AND NOT l_archived WHERE NOT o.archived)
GROUP BY observation_id
""",
})

#: The address rules on stated offers, written from how those addresses are made.
STATED_URL = """(scheme_ok AND tail_ok AND NOT (NOT archived AND k_part % 97 IN (1, 2) AND (k_part % 97 = 1 OR k_part % 7 <> 0)))"""


@register("match_evidence_stated", "SELECT observation_id, entry_count, facts_equal FROM v_stated_match")
def _(spark, root):
    return market.match_evidence(stated_offers(spark, root), stated_ledger(spark, root))


@register("qualify_offer_stated", f"""
SELECT o.observation_id, r.retailer_id, concat_ws(',',
  CASE WHEN archived AND (NOT identity_exact OR product_mpn <> o.mpn) THEN 'archived_identity_not_exact' END,
  CASE WHEN NOT archived AND mpn_expected <> o.mpn THEN 'direct_identity_not_exact_mpn' END, CASE WHEN observed_at > created_at THEN 'invalid_or_future_observed_at' END,
  CASE WHEN currency <> 'GBP' THEN 'currency_not_gbp' END, CASE WHEN vat_state <> 'included' THEN 'vat_not_explicitly_included' END,
  CASE WHEN {AVAILABLE} IS NULL THEN 'availability_not_explicitly_orderable' END, CASE WHEN r.retailer_id IS NULL THEN 'retailer_not_recognised' END,
  CASE WHEN seller_relationship <> 'retailer_owned' THEN 'seller_not_retailer_owned' END, CASE WHEN seller_relationship IS NULL AND NOT archived THEN 'primary_retail_relationship_not_established' END,
  CASE WHEN entry_count = 0 THEN 'missing_evidence_ledger_entry' WHEN entry_count > 1 THEN 'ambiguous_evidence_ledger_entry' END, CASE WHEN NOT facts_equal THEN 'evidence_facts_mismatch' END,
  CASE WHEN r.retailer_id IS NOT NULL AND NOT {STATED_URL} THEN 'source_url_contract_mismatch' END,
  CASE WHEN stock_semantics = 'ambiguous' OR contains(lower(review_note), 'identity_mismatch') THEN 'record_specific_ambiguity_restriction_or_rejection' END,
  CASE WHEN publication_allowed THEN 'record_authority_drift' END) AS reasons
FROM (SELECT *, NOT contains(source_url, 'http://') AS scheme_ok, NOT regexp_matches(source_url, '[?#].') AS tail_ok FROM v_stated) o
JOIN v_approved a ON a.mpn = o.mpn LEFT JOIN v_retailer r ON r.accepted_name = o.seller_display_name JOIN v_stated_match m ON m.observation_id = o.observation_id""")
def _(spark, root):
    o = stated_offers(spark, root)
    q = market.qualify_offer(o, settle(approved(spark, root)), stated_ledger(spark, root), stated_retailers(spark, root))
    return q.select("observation_id", "retailer_id", F.array_join("reasons", ",").alias("reasons"))


@register("public_offers", f"SELECT * REPLACE ({STAMP}) FROM v_public")
def _(spark, root):
    fresh = market.public_offers(candidates(qualified_offers(spark, root, accepted_only=True)))
    return fresh.withColumn("observed_at", instant_text(F.col("observed_at")))


@register("offer_exceptions", """
WITH k AS (SELECT mpn, retailer_id, observed_at, count(*) AS n, min(observation_id) AS kept,
  count(DISTINCT (public_observation_id, item_price_minor, source_url, availability, observation_kind)) AS sets FROM v_copied GROUP BY ALL)
SELECT observation_id, mpn, strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, 'excluded_pending_review' AS disposition, reasons FROM v_offer_q WHERE reasons <> ''
UNION ALL SELECT c.observation_id, c.mpn, strftime(c.observed_at, '%Y-%m-%dT%H:%M:%SZ'),
  CASE WHEN sets > 1 THEN 'excluded_conflicting_duplicate' ELSE 'excluded_exact_duplicate' END,
  CASE WHEN sets > 1 THEN 'conflicting_same_retailer_timestamp' ELSE 'duplicate_fact' END
FROM v_copied c JOIN k ON k.mpn = c.mpn AND k.retailer_id = c.retailer_id AND k.observed_at = c.observed_at WHERE sets > 1 OR c.observation_id <> kept""")
def _(spark, root):
    q = settle(qualified_offers(spark, root, slim=True))
    return market.offer_exceptions(q, candidates(q)).withColumn("observed_at", instant_text(F.col("observed_at")))


@register("assert_public_offers", f"""
WITH o AS (SELECT * REPLACE (CASE WHEN mpn LIKE 'ZZ-%' THEN mpn || 'Q' ELSE mpn END AS mpn, CASE WHEN retailer_id = 'nation-3' THEN 'Other' ELSE retailer_name END AS retailer_name) FROM v_public),
j AS (SELECT o.*, r.retailer_name AS roster, a.mpn AS known, https_host, observation_kind = 'archived_retail_observation' AS archived FROM o LEFT JOIN v_retailer r ON r.retailer_id = o.retailer_id LEFT JOIN v_approved a ON a.mpn = o.mpn)
SELECT 'product_unknown' AS rule, public_observation_id AS key, '' AS detail FROM j WHERE known IS NULL
UNION ALL SELECT 'retailer_name_differs', public_observation_id, '' FROM j WHERE roster <> retailer_name
UNION ALL SELECT 'url_kind', public_observation_id, '' FROM (SELECT * FROM j) WHERE NOT (https_host IS NOT NULL AND CASE WHEN archived THEN
  regexp_extract(source_url, 'id_/https://([^/]+)', 1) = https_host AND regexp_extract(source_url, '/web/([0-9]{{14}})id_', 1) = strftime(observed_at, '%Y%m%d%H%M%S')
  ELSE regexp_extract(source_url, '^https://([^/]+)', 1) = https_host END)
UNION ALL SELECT 'product_without_offer', mpn, '' FROM v_approved WHERE mpn NOT IN (SELECT mpn FROM o)
UNION ALL SELECT 'retailer_without_offer', retailer_id, '' FROM v_retailer WHERE retailer_id NOT IN (SELECT retailer_id FROM o)""")
def _(spark, root):
    o = offers(spark, root).withColumns({
        "mpn": F.when(F.col("mpn").startswith("ZZ-"), F.concat(F.col("mpn"), F.lit("Q"))).otherwise(F.col("mpn")),
        "retailer_name": F.when(F.col("retailer_id") == "nation-3", F.lit("Other")).otherwise(F.col("retailer_name")),
    })
    return market.assert_public_offers(o, approved(spark, root), retailers(spark, root))


@register("release_counts", """
SELECT count(*) AS observation_count, count(DISTINCT mpn) AS product_count, count(DISTINCT retailer_id) AS retailer_count,
  strftime(min(observed_at), '%Y-%m-%dT%H:%M:%SZ') AS oldest_at, strftime(max(observed_at), '%Y-%m-%dT%H:%M:%SZ') AS latest_at FROM v_public""")
def _(spark, root):
    return market.release_counts(offers(spark, root)).withColumns(
        {"oldest_at": instant_text(F.col("oldest_at")), "latest_at": instant_text(F.col("latest_at"))}
    )


@register("latest_offers", f"""
SELECT * EXCLUDE (rn) REPLACE ({STAMP}) FROM (SELECT *, row_number() OVER (PARTITION BY mpn ORDER BY observed_at DESC, retailer_id DESC, item_price_minor DESC, source_url DESC) AS rn FROM v_public) WHERE rn = 1""")
def _(spark, root):
    return market.latest_offers(offers(spark, root)).withColumn("observed_at", instant_text(F.col("observed_at")))


@register("offer_history", f"SELECT * REPLACE ({STAMP}) FROM v_public WHERE mpn = 'KX-2-5600'")
def _(spark, root):
    return market.offer_history(offers(spark, root), "KX-2-5600").withColumn("observed_at", instant_text(F.col("observed_at")))


@register("latest_per_key", """
SELECT k_part, k_supp, strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, observation_id, amount_minor FROM
  (SELECT *, row_number() OVER (PARTITION BY k_part, k_supp ORDER BY observed_at DESC, observation_id DESC) AS rn FROM v_lines) WHERE rn = 1""")
def _(spark, root):
    from pricetrail.sources.adapter import lines

    rows = lines(spark, root).select("k_part", "k_supp", "observed_at", "observation_id", "amount_minor")
    return market.latest_per_key(rows, ["k_part", "k_supp"], ["observed_at", "observation_id"]).withColumn(
        "observed_at", instant_text(F.col("observed_at"))
    )


@register("daily_market", "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM v_day")
def _(spark, root):
    return dated(daily(spark, root)[0], "date")


@register("daily_products", "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM v_day_product")
def _(spark, root):
    return dated(market.daily_products(day_rows(spark, root)), "date")


@register("daily_evidence", """
WITH e AS (SELECT date, min(item_price_minor) AS lo, max(item_price_minor) AS hi FROM v_day_row GROUP BY date)
SELECT strftime(d.date, '%Y-%m-%d') AS date, side, public_observation_id, mpn, retailer_id, item_price_minor, strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at
FROM v_day_row d JOIN e ON e.date = d.date JOIN (SELECT unnest(['low', 'high']) AS side) s ON item_price_minor = CASE WHEN side = 'low' THEN lo ELSE hi END""")
def _(spark, root):
    return dated(market.daily_evidence(day_rows(spark, root)), "date").withColumn("observed_at", instant_text(F.col("observed_at")))


for name, start in {"7D": "max_date - INTERVAL 6 DAY", "30D": "max_date - INTERVAL 29 DAY", "3M": "max_date - INTERVAL 3 MONTH",
                    "1Y": "max_date - INTERVAL 12 MONTH", "ALL": "DATE '0001-01-01'"}.items():

    def _range(spark: SparkSession, root: str, name: str = name) -> DataFrame:
        return dated(market.range_points(daily(spark, root)[0], name).select("date", "typical_minor"), "date")

    register(f"range_points_{name.lower()}", f"""
SELECT strftime(date, '%Y-%m-%d') AS date, typical_minor FROM v_day, (SELECT max(date) AS max_date FROM v_day) WHERE date >= {start}""")(_range)


MONTHLY_SQL = """
SELECT strftime(d.month, '%Y-%m') AS month, strftime(d.date, '%Y-%m-%d') AS date, typical_minor, daily_point_count, product_count, declared_product_count FROM
(SELECT date_trunc('month', date) AS month, max(date) AS date, CAST(floor(sum(typical_minor) / count(*) + 0.5) AS BIGINT) AS typical_minor, count(*) AS daily_point_count,
  max(declared_product_count) AS declared_product_count FROM v_day GROUP BY 1) d
JOIN (SELECT date_trunc('month', date) AS month, count(DISTINCT mpn) AS product_count FROM v_day_product GROUP BY 1) p ON p.month = d.month"""


@register("monthly_average", MONTHLY_SQL)
def _(spark, root):
    points, products = daily(spark, root)
    return dated(market.monthly_average(points, products), "date")


@register("range_view", """
WITH lim AS (SELECT max(date) - INTERVAL 12 MONTH AS start FROM v_day)
SELECT strftime(d.month, '%Y-%m') AS label, typical_minor, product_count FROM
(SELECT date_trunc('month', date) AS month, CAST(floor(sum(typical_minor) / count(*) + 0.5) AS BIGINT) AS typical_minor FROM v_day, lim WHERE date >= start GROUP BY 1) d
JOIN (SELECT date_trunc('month', date) AS month, count(DISTINCT mpn) AS product_count FROM v_day_product, lim WHERE date >= start GROUP BY 1) p ON p.month = d.month""")
def _(spark, root):
    points, products = daily(spark, root)
    return market.range_view(points, products, "1Y")


@register("first_direct_day", "SELECT strftime(min(date), '%Y-%m-%d') AS first_direct_date FROM v_day WHERE capture_basis <> 'archive'")
def _(spark, root):
    return dated(market.first_direct_day(daily(spark, root)[0]), "first_direct_date")


@register("contiguous_segments", """
SELECT row_number() OVER (ORDER BY min(date)) AS segment_no, strftime(min(date), '%Y-%m-%d') AS first_at, strftime(max(date), '%Y-%m-%d') AS last_at, count(*) AS point_count
FROM (SELECT date, date_diff('day', DATE '1970-01-01', date) - row_number() OVER (ORDER BY date) AS g FROM v_day) GROUP BY g""")
def _(spark, root):
    return dated(market.day_segments(daily(spark, root)[0]).drop("market"), "first_at", "last_at")


@register("previous_day_change", """
WITH s AS (SELECT date, string_agg(mpn, ',' ORDER BY mpn) AS names FROM v_day_product GROUP BY date),
w AS (SELECT d.date, typical_minor, names, lag(d.date) OVER (ORDER BY d.date) AS pd, lag(typical_minor) OVER (ORDER BY d.date) AS pt, lag(names) OVER (ORDER BY d.date) AS pn
  FROM v_day d JOIN s ON s.date = d.date)
SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN pd = date - INTERVAL 1 DAY AND pn = names THEN CAST(floor((typical_minor - pt) * 1000.0 / pt + 0.5) AS BIGINT) END AS change_permille FROM w""")
def _(spark, root):
    points, products = daily(spark, root)
    return dated(market.previous_day_change(points, products), "date")


@register("validate_daily", """
SELECT 'price_bounds' AS rule, strftime(date, '%Y-%m-%d') AS key, '' AS detail FROM v_day WHERE typical_minor % 5 = 0
UNION ALL SELECT 'evidence_not_published', public_observation_id, '' FROM v_day_row d JOIN (SELECT date, min(item_price_minor) AS lo, max(item_price_minor) AS hi FROM v_day_row GROUP BY date) e ON e.date = d.date
  JOIN (SELECT unnest(['low', 'high']) AS side) s ON item_price_minor = CASE WHEN side = 'low' THEN lo ELSE hi END WHERE retailer_id = 'nation-2'""")
def _(spark, root):
    public = offers(spark, root)
    rows = market.daily_offers(public, SENTINELS)
    points = market.daily_market(rows, approved(spark, root))
    spoiled = points.withColumn("low_minor", F.when(F.col("typical_minor") % 5 == 0, F.col("high_minor") + 1).otherwise(F.col("low_minor")))
    published = public.where("retailer_id <> 'nation-2'")
    return market.validate_daily(spoiled, market.daily_evidence(rows), published, SENTINELS)
