"""The adapter views restated as SQL, for the oracle side only."""

from __future__ import annotations

MPN = """CASE WHEN {k} % 13 < 10 THEN 'KX-' || {k} || '-' ||
  ['4800','5200','5600','6000','6200','6400','6600','7200','7600','8000'][CAST({k} % 13 + 1 AS INTEGER)]
  WHEN {k} % 13 = 10 THEN 'CT2K16G56C' || {k} ELSE 'ZZ-' || {k} END"""

HALF_UP = "CAST(floor({x} + 0.5) AS BIGINT)"

VIEWS: dict[str, str] = {
    "v_lines": f"""
SELECT l_orderkey AS k_order, l_partkey AS k_part, l_suppkey AS k_supp, CAST(l_linenumber AS BIGINT) AS k_line,
  CAST(l_quantity AS BIGINT) AS k_qty, l_tax AS k_tax, l_discount AS k_disc,
  concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
    CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d'),
    CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS VARCHAR)) AS observation_id,
  l_shipdate + to_minutes(CAST((l_partkey * 7 + l_linenumber * 131) % 1440 AS BIGINT)) AS observed_at,
  {MPN.format(k='l_partkey')} AS mpn,
  CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS amount_minor,
  'GBP' AS currency,
  CASE WHEN l_returnflag <> 'R' THEN true WHEN l_linestatus = 'O' THEN false END AS vat_included,
  CASE WHEN l_linestatus = 'F' THEN 'archive_capture' ELSE 'prospective_capture' END AS capture_kind
FROM lineitem
""",
    "v_obs": """
SELECT l.*, s_name AS seller_observed, n_name AS seller_fine, r_name AS seller,
  CASE WHEN n_nationkey % 5 <> 4 THEN n_name || ' Ltd' END AS seller_legal_name
FROM v_lines l JOIN supplier ON k_supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
""",
    "v_landed": """
SELECT observation_id, observed_at, capture_kind, lower(mpn) AS product_key, mpn AS mpn_expected,
  CASE WHEN k_line = 6 AND k_part % 11 = 0 THEN NULL WHEN k_line = 5 AND k_part % 17 = 0 THEN mpn || 'X' ELSE mpn END AS mpn_observed,
  CASE WHEN k_line = 6 AND k_part % 11 = 0 THEN 'unresolved' ELSE 'exact_mpn' END AS match_basis,
  CASE WHEN k_line = 7 AND k_qty > 45 THEN 'MARKETPLACE' ELSE 'PRIMARY_RETAIL' END AS channel,
  lower(replace(seller_fine, '_', '-')) AS retailer_key, seller_fine AS retailer_name, seller_legal_name,
  CASE k_part % 23 WHEN 0 THEN 'third_party' WHEN 1 THEN 'unresolved' ELSE 'retailer_owned' END AS seller_relationship,
  item AS item_price_minor,
  CASE WHEN k_line = 7 AND k_qty = 49 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE WHEN vat_included THEN 'included' WHEN NOT vat_included THEN 'excluded' ELSE 'unknown' END AS vat_state,
  CASE WHEN k_line = 5 AND k_qty < 10 THEN 'out_of_stock' WHEN k_line = 6 AND k_qty < 5 THEN 'unknown' ELSE 'in_stock' END AS availability,
  CASE WHEN k_tax < 0.005 THEN 'free_delivery_explicit' WHEN k_tax > 0.075 THEN 'unknown' ELSE 'mandatory_cost_known' END AS delivery_state,
  delivery AS delivery_amount_minor,
  CASE WHEN k_disc < 0.095 THEN 'eligible' ELSE 'unresolved' END AS landed_eligibility,
  CASE WHEN k_disc < 0.095 THEN item + delivery + CASE WHEN k_part % 97 = 0 AND k_line = 1 THEN 1 ELSE 0 END END AS landed_price_minor
FROM (SELECT *, CASE WHEN k_qty = 50 AND k_line = 2 THEN 0 ELSE amount_minor END AS item,
    CAST(CASE WHEN k_tax < 0.005 THEN CASE WHEN k_line = 7 THEN 100 ELSE 0 END WHEN k_tax > 0.075 THEN NULL
      ELSE floor(k_tax * 10000 + 0.5) END AS BIGINT) AS delivery FROM v_obs)
""",
    "v_offer": """
SELECT observation_id, observed_at, capture_kind, archived, mpn,
  CASE WHEN k_line = 5 AND k_part % 17 = 0 THEN mpn || 'X' ELSE mpn END AS mpn_expected, mpn AS mpn_observed,
  k_part % 19 <> 0 AS identity_exact, 'exact_mpn' AS match_basis, seller_fine AS seller_display_name,
  CASE WHEN k_part % 23 = 0 THEN 'third_party' ELSE 'retailer_owned' END AS seller_relationship,
  CASE WHEN k_qty = 50 AND k_line = 1 THEN 9999999 ELSE amount_minor END AS amount_minor,
  CASE WHEN k_line = 7 AND k_qty = 49 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE WHEN vat_included THEN 'included' WHEN NOT vat_included THEN 'excluded' ELSE 'unknown' END AS vat_state,
  CASE WHEN k_line = 4 AND k_qty < 5 THEN 'available_to_order' WHEN k_line = 5 AND k_qty < 5 THEN 'out_of_stock'
    WHEN k_line = 3 THEN 'stated_at_capture' ELSE 'in_stock' END AS stock_state,
  CASE WHEN k_line = 3 AND k_qty < 20 THEN 'Hurry, only 3 left' WHEN k_line = 3 AND k_qty < 25 THEN 'Available to order'
    WHEN k_line = 3 AND k_qty < 30 THEN 'call us' WHEN k_line = 2 AND k_qty < 4 THEN 'Sold out' ELSE 'In stock' END AS stock_text,
  CASE WHEN k_line = 1 AND k_qty = 7 THEN 'ambiguous' ELSE 'explicit' END AS stock_semantics,
  CASE WHEN archived THEN 'https://web.archive.org/web/' || strftime(observed_at, '%Y%m%d%H%M%S') || 'id_/' || page ELSE page END AS source_url,
  'ev-' || observation_id AS evidence_id,
  CASE WHEN k_line = 2 AND k_qty = 9 THEN 'IDENTITY_MISMATCH_NOTED' ELSE 'retained' END AS review_note,
  k_line = 2 AND k_qty = 11 AS publication_allowed, k_order, k_part
FROM (SELECT *, capture_kind = 'archive_capture' AS archived,
    CASE WHEN k_line = 6 AND k_qty < 10 THEN 'http://' ELSE 'https://' END || 'www.' || lower(replace(seller_fine, '_', '-'))
      || '.example/p/' || lower(mpn) || CASE WHEN k_line = 7 AND k_qty < 10 THEN '?ref=x' WHEN k_line = 7 AND k_qty < 20 THEN '#top' ELSE '' END AS page
  FROM v_obs)
""",
    "v_ledger": """
SELECT evidence_id, seller_display_name, source_url, observed_at AS retrieved_at,
  CASE WHEN o_orderstatus = 'P' THEN 404 ELSE 200 END AS http_status, sha256(evidence_id) AS response_sha256,
  length(source_url) AS response_bytes, mpn AS fact_mpn,
  CASE WHEN k_part % 37 = 0 THEN amount_minor + 1 ELSE amount_minor END AS fact_amount_minor,
  currency AS fact_currency, vat_state = 'included' AS fact_vat_included
FROM v_offer JOIN orders ON k_order = o_orderkey JOIN (SELECT unnest([1, 2]) AS copy_no) c
  ON copy_no = 1 OR k_part % 31 = 0
WHERE k_part % 29 <> 0
""",
    "v_retailer": """
SELECT lower(replace(n_name, '_', '-')) AS retailer_id, 'Retailer ' || n_nationkey AS retailer_name, n_name AS accepted_name,
  'www.' || lower(replace(n_name, '_', '-')) || '.example' AS https_host
FROM nation WHERE n_nationkey % 12 <> 11
""",
    "v_catalogue": f"""
SELECT 'part-' || p_partkey AS product_key, lower(replace(p_brand, '#', '-')) AS manufacturer_key,
  p_brand AS manufacturer_name, p_name AS model, {MPN.format(k='p_partkey')} AS mpn_raw,
  {MPN.format(k='p_partkey')} AS mpn_normalized, lower(p_type) AS family_key,
  CASE WHEN p_size = 49 THEN 'DDR4' ELSE 'DDR5' END AS memory_generation,
  CASE WHEN p_size = 50 THEN 16 ELSE 32 END AS total_capacity_gb, 2 AS module_count,
  CASE WHEN p_size = 48 THEN 'SODIMM' ELSE 'UDIMM' END AS form_factor, false AS ecc, false AS registered,
  4800 + (p_size % 8) * 400 AS speed_mt_s,
  CASE WHEN p_partkey % 3 = 0 THEN 'reviewed_fixture' ELSE 'candidate_pending_review' END AS review_status,
  p_partkey AS k_part, p_size AS k_size
FROM part
""",
    "v_alias": """
SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS manufacturer_key, p_brand AS manufacturer_name, alias
FROM (SELECT p_brand, unnest([p_brand, upper(p_brand), replace(p_brand, 'Brand#', 'The Brand '),
  CASE WHEN p_brand IN ('Brand#3', 'Brand#4') THEN 'Shared Brand' END]) AS alias FROM part)
WHERE alias IS NOT NULL
""",
    "v_listing": """
SELECT observation_id AS listing_id,
  CASE WHEN k_line = 4 AND k_qty % 2 = 1 THEN 'Choose 16GB or ' ELSE 'Kit ' END || p_name AS title,
  CASE WHEN k_line = 7 AND k_qty % 2 = 0 THEN 'Brand#99'
    WHEN k_line = 7 THEN CASE WHEN p_brand = 'Brand#1' THEN 'Brand#2' ELSE 'Brand#1' END ELSE p_brand END AS manufacturer_raw,
  CASE k_line WHEN 1 THEN mpn WHEN 2 THEN ' ' || lower(mpn) WHEN 3 THEN mpn || 'Z' WHEN 6 THEN 'NOPE-' || k_order WHEN 7 THEN mpn END AS mpn_raw,
  CASE WHEN k_line = 5 THEN CASE k_qty % 3 WHEN 0 THEN '12AB' WHEN 1 THEN '5012345678900' END END AS gtin_raw,
  CASE WHEN k_qty = 1 THEN 'DDR4' WHEN k_qty < 20 THEN 'DDR5' END AS memory_generation,
  CASE WHEN k_qty = 2 THEN 'SODIMM' END AS form_factor,
  CASE WHEN k_qty = 3 THEN 1 WHEN k_qty > 30 THEN 2 END AS module_count,
  CASE WHEN k_qty = 4 THEN 16 WHEN k_qty > 40 THEN 32 END AS total_capacity_gb,
  CASE WHEN k_qty = 5 THEN true END AS ecc
FROM v_lines JOIN part ON k_part = p_partkey
""",
}

VIEWS.update({
    "v_votes": """
SELECT mpn, CAST(date_trunc('month', observed_at) AS DATE) AS month, seller, count(*) AS capture_count,
  max(observed_at) AS last_observed_at, bool_or(coalesce(vat_included, false)) AS comparable,
  CAST(CASE WHEN bool_or(coalesce(vat_included, false))
    THEN floor(quantile_cont(CASE WHEN vat_included THEN amount_minor END, 0.5) + 0.5)
    ELSE floor(quantile_cont(amount_minor, 0.5) + 0.5) END AS BIGINT) AS amount_minor,
  CASE WHEN bool_or(coalesce(vat_included, false)) THEN true ELSE first(vat_included ORDER BY observed_at, observation_id) END AS vat_included
FROM v_obs GROUP BY ALL
""",
    "v_points": """
SELECT mpn, month, CASE WHEN count(*) FILTER (WHERE comparable) > 0 THEN 'observed' ELSE 'no_comparable_price' END AS state,
  CAST(floor(quantile_cont(CASE WHEN comparable THEN amount_minor END, 0.5) + 0.5) AS BIGINT) AS median_minor,
  min(amount_minor) FILTER (WHERE comparable) AS low_minor, max(amount_minor) FILTER (WHERE comparable) AS high_minor,
  count(*) FILTER (WHERE comparable) AS seller_count, count(*) FILTER (WHERE comparable) = 1 AS single_seller,
  count(*) FILTER (WHERE NOT comparable) AS excluded_seller_count
FROM v_votes GROUP BY mpn, month
""",
    "v_summary": """
SELECT p.mpn, month_count, multi_seller_month_count, seller_count, first_month, last_month FROM
  (SELECT mpn, count(*) AS month_count, count(*) FILTER (WHERE seller_count >= 2) AS multi_seller_month_count,
     strftime(min(month), '%Y-%m') AS first_month, strftime(max(month), '%Y-%m') AS last_month
   FROM v_points WHERE state = 'observed' GROUP BY mpn) p
  JOIN (SELECT mpn, count(DISTINCT seller) AS seller_count FROM v_votes WHERE comparable GROUP BY mpn) s ON p.mpn = s.mpn
""",
    "v_prices": """
SELECT mpn, CAST(date_trunc('quarter', month) AS DATE) AS period, CAST(floor(quantile_cont(median_minor, 0.5) + 0.5) AS BIGINT) AS price_minor
FROM v_points WHERE state = 'observed' GROUP BY ALL
""",
    "v_pairs": """
SELECT b.mpn, b.period, a.price_minor AS from_minor, b.price_minor AS to_minor
FROM v_prices b JOIN v_prices a ON a.mpn = b.mpn AND a.period = b.period - INTERVAL 3 MONTH
""",
    "v_links": """
SELECT period, count(*) AS matched_count, exp(avg(ln(to_minor / from_minor))) AS link,
  floor(min(to_minor / from_minor) * 10000 + 0.5) / 10000 AS relative_min,
  floor(max(to_minor / from_minor) * 10000 + 0.5) / 10000 AS relative_max,
  floor(list_sort(list(to_minor / from_minor))[CAST(floor(count(*) / 2) AS BIGINT) + 1] * 10000 + 0.5) / 10000 AS relative_median
FROM v_pairs GROUP BY period
""",
})


def index_views(prices: str, base: str, floor: int) -> str:
    """The chained index as recursive SQL, walking out from the base quarter."""
    return f"""
WITH RECURSIVE prices AS ({prices}),
pairs AS (SELECT b.mpn, b.period, a.price_minor AS from_minor, b.price_minor AS to_minor
  FROM prices b JOIN prices a ON a.mpn = b.mpn AND a.period = b.period - INTERVAL 3 MONTH),
links AS (SELECT period, count(*) AS matched_count, exp(avg(ln(to_minor / from_minor))) AS link,
    min(to_minor / from_minor) AS lo, max(to_minor / from_minor) AS hi,
    list_sort(list(to_minor / from_minor))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mid
  FROM pairs GROUP BY period),
present AS (SELECT period, count(*) AS n FROM prices GROUP BY period),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM present), (SELECT max(period) FROM present), INTERVAL 3 MONTH)) AS DATE) AS period),
steps AS (SELECT s.period, p.n, l.link, l.lo, l.mid, l.hi,
    CASE WHEN p.n IS NOT NULL AND q.n IS NOT NULL THEN coalesce(l.matched_count, 0) END AS matched
  FROM spine s LEFT JOIN present p ON p.period = s.period LEFT JOIN present q ON q.period = s.period - INTERVAL 3 MONTH
  LEFT JOIN links l ON l.period = s.period),
up AS (SELECT period, CAST(100.0 AS DOUBLE) AS level, false AS stopped, CAST(NULL AS DATE) AS via, false AS first_stop FROM spine WHERE period = DATE '{base}'
  UNION ALL SELECT s.period, CASE WHEN NOT u.stopped AND s.matched >= {floor} THEN u.level * s.link END,
    u.stopped OR coalesce(s.matched, -1) < {floor}, s.period, NOT u.stopped AND coalesce(s.matched, -1) < {floor}
  FROM up u JOIN steps s ON s.period = u.period + INTERVAL 3 MONTH),
down AS (SELECT period, CAST(100.0 AS DOUBLE) AS level, false AS stopped, CAST(NULL AS DATE) AS via, false AS first_stop FROM spine WHERE period = DATE '{base}'
  UNION ALL SELECT p.period, CASE WHEN NOT d.stopped AND s.matched >= {floor} THEN d.level / s.link END,
    d.stopped OR coalesce(s.matched, -1) < {floor}, s.period, NOT d.stopped AND coalesce(s.matched, -1) < {floor}
  FROM down d JOIN steps s ON s.period = d.period JOIN spine p ON p.period = d.period - INTERVAL 3 MONTH),
walked AS (SELECT * FROM up UNION ALL SELECT * FROM down WHERE period < DATE '{base}'),
idx AS (SELECT w.period, year(w.period) || 'Q' || quarter(w.period) AS period_id,
    CASE WHEN w.level IS NOT NULL THEN 'observed' WHEN p.n IS NULL THEN 'no_observations'
      WHEN w.first_stop THEN 'insufficient_matched_evidence' ELSE 'outside_stopped_chain' END AS state,
    floor(w.level * 1000 + 0.5) / 1000 AS index_value,
    CASE WHEN w.level IS NOT NULL AND w.period > DATE '{base}' THEN floor(s.link * 10000 + 0.5) / 10000 END AS link,
    CASE WHEN w.level IS NOT NULL OR w.first_stop THEN s.matched END AS matched_product_count,
    CASE WHEN w.level IS NOT NULL OR w.first_stop THEN floor(s.lo * 10000 + 0.5) / 10000 END AS relative_min,
    CASE WHEN w.level IS NOT NULL OR w.first_stop THEN floor(s.mid * 10000 + 0.5) / 10000 END AS relative_median,
    CASE WHEN w.level IS NOT NULL OR w.first_stop THEN floor(s.hi * 10000 + 0.5) / 10000 END AS relative_max,
    coalesce(p.n, 0) AS distinct_products_in_period, w.period = DATE '{base}' AS reference_period
  FROM walked w LEFT JOIN present p ON p.period = w.period LEFT JOIN steps s ON s.period = w.via)
"""

IDENTITY_BAD = "match_basis <> 'exact_mpn' OR mpn_observed IS NULL OR mpn_observed <> mpn_expected"

VIEWS.update({
    "v_solo": """
SELECT * REPLACE (CASE WHEN k_qty > 10 THEN mpn || '-' || seller_fine ELSE mpn END AS mpn) FROM v_obs
""",
    "v_qual": f"""
SELECT *, CASE WHEN reasons = '' THEN 'eligible' ELSE 'abstain' END AS status FROM (
  SELECT *, CASE WHEN one <> '' THEN one WHEN landed_eligibility <> 'eligible' THEN 'landed_price_eligibility_unresolved'
    WHEN landed_price_minor IS DISTINCT FROM item_price_minor + delivery_amount_minor THEN 'landed_price_arithmetic_mismatch' ELSE '' END AS reasons
  FROM (SELECT *, concat_ws(',',
      CASE WHEN {IDENTITY_BAD} THEN 'exact_mpn_unresolved' END,
      CASE WHEN channel <> 'PRIMARY_RETAIL' THEN 'channel_not_primary_retail' END,
      CASE WHEN seller_relationship <> 'retailer_owned' THEN 'retailer_owned_seller_unresolved' END,
      CASE WHEN item_price_minor = 0 THEN 'item_price_not_positive' END,
      CASE WHEN vat_state <> 'included' THEN 'vat_inclusion_unresolved' END,
      CASE WHEN availability = 'unknown' THEN 'availability_unresolved' WHEN availability <> 'in_stock' THEN 'not_available_to_purchase' END,
      CASE WHEN delivery_state = 'unknown' OR delivery_amount_minor IS NULL OR (delivery_state = 'free_delivery_explicit' AND delivery_amount_minor <> 0)
        THEN 'mandatory_delivery_unresolved' END) AS one FROM v_landed))
""",
    "v_persisted": f"""
SELECT *, concat_ws(',', CASE WHEN {IDENTITY_BAD} THEN 'exact_mpn_unresolved' END,
  CASE WHEN seller_relationship <> 'retailer_owned' THEN 'retailer_owned_seller_unresolved' END,
  CASE WHEN vat_state <> 'included' THEN 'vat_inclusion_unresolved' END,
  CASE WHEN availability = 'unknown' THEN 'availability_unresolved' WHEN availability <> 'in_stock' THEN 'not_available_to_purchase' END,
  CASE WHEN delivery_state NOT IN ('mandatory_cost_known', 'free_delivery_explicit') OR delivery_amount_minor IS NULL THEN 'mandatory_delivery_unresolved' END,
  CASE WHEN landed_eligibility <> 'eligible' OR landed_price_minor IS NULL THEN 'landed_price_eligibility_unresolved' END) AS reasons
FROM v_landed
""",
    "v_daily_line": """
SELECT product_key, retailer_key, CAST(observed_at AS DATE) AS date, count(*) AS n, min(landed_price_minor) AS price_minor, min(observation_id) AS observation_id
FROM v_qual WHERE status = 'eligible' GROUP BY ALL
""",
    "v_move": """
SELECT product_key, retailer_key, from_date, date AS to_date, from_minor, price_minor AS to_minor, from_observation_id, observation_id AS to_observation_id,
  price_minor - from_minor AS change_minor,
  CAST(sign(price_minor - from_minor) AS BIGINT) * ((2 * 10000 * abs(price_minor - from_minor) + from_minor) // (2 * from_minor)) AS change_basis_points,
  CASE WHEN price_minor < from_minor THEN 'down' WHEN price_minor > from_minor THEN 'up' ELSE 'flat' END AS direction
FROM (SELECT *, lag(date) OVER w AS from_date, lag(price_minor) OVER w AS from_minor, lag(observation_id) OVER w AS from_observation_id
  FROM v_daily_line WHERE n = 1 WINDOW w AS (PARTITION BY product_key, retailer_key ORDER BY date))
WHERE from_date IS NOT NULL
""",
    "v_widest": """
SELECT 'movement-' || lower(mpn) || '-' || a.observation_id || '-' || z.observation_id AS movement_id, mpn,
  a.observation_id AS from_observation_id, a.observed_at AS from_observed_at, a.seller AS from_seller, a.amount_minor AS from_minor,
  z.observation_id AS to_observation_id, z.observed_at AS to_observed_at, z.seller AS to_seller, z.amount_minor AS to_minor,
  z.amount_minor - a.amount_minor AS delta_minor,
  CAST(floor((z.amount_minor - a.amount_minor) * 10000.0 / a.amount_minor + 0.5) AS BIGINT) AS delta_basis_points, basis AS comparison_basis,
  CASE WHEN a.vat_included IS NULL THEN 'unresolved' WHEN a.vat_included THEN 'included' ELSE 'excluded' END AS vat_state_from,
  CASE WHEN z.vat_included IS NULL THEN 'unresolved' WHEN z.vat_included THEN 'included' ELSE 'excluded' END AS vat_state_to,
  a.vat_included IS NULL OR z.vat_included IS NULL AS vat_disclosure_required
FROM (
  SELECT mpn, coalesce(w.a, p.a) AS a, coalesce(w.z, p.z) AS z, CASE WHEN w.a IS NULL THEN 'cross_seller' ELSE 'within_seller' END AS basis
  FROM (SELECT mpn, first(r ORDER BY observed_at, observation_id) AS a, first(r ORDER BY observed_at DESC, observation_id DESC) AS z
        FROM (SELECT *, struct_pack(observation_id, observed_at, seller, amount_minor, vat_included) AS r FROM v_obs) GROUP BY mpn HAVING count(*) >= 2) p
  LEFT JOIN (SELECT mpn AS m, a, z FROM (SELECT *, row_number() OVER (PARTITION BY mpn ORDER BY date_diff('second', a.observed_at, z.observed_at) DESC, seller) AS rn
      FROM (SELECT mpn, seller, first(r ORDER BY observed_at, observation_id) AS a, first(r ORDER BY observed_at DESC, observation_id DESC) AS z
        FROM (SELECT *, struct_pack(observation_id, observed_at, seller, amount_minor, vat_included) AS r FROM v_obs) GROUP BY mpn, seller HAVING count(*) >= 2)) WHERE rn = 1) w
  ON w.m = p.mpn)
""",
})

AVAILABLE = """CASE WHEN stock_semantics <> 'explicit' THEN NULL
  WHEN regexp_matches(lower(stock_text), 'out of stock|sold out|unavailable|not available') THEN NULL
  WHEN stock_state IN ('in_stock', 'available_to_order') THEN stock_state
  WHEN stock_state = 'stated_at_capture' AND regexp_matches(lower(stock_text), 'in stock|hurry, only [1-9][0-9]* left') THEN 'in_stock'
  WHEN stock_state = 'stated_at_capture' AND contains(lower(stock_text), 'available to order') THEN 'available_to_order' END"""

URL_OK = """(https_host IS NOT NULL AND CASE WHEN archived THEN
  regexp_matches(source_url, '^https://web\\.archive\\.org/web/[0-9]{14}id_/https://[^/:@?#]+(/[^?#]*)?$')
  AND regexp_extract(source_url, 'id_/https://([^/]+)', 1) = https_host AND regexp_extract(source_url, '/web/([0-9]{14})id_', 1) = strftime(observed_at, '%Y%m%d%H%M%S')
  ELSE regexp_matches(source_url, '^https://[^/:@?#]+(/[^?#]*)?$') AND regexp_extract(source_url, '^https://([^/]+)', 1) = https_host END)"""

VIEWS.update({
    "v_policy": "SELECT mpn_normalized AS mpn, 'review-' || (k_part % 2) AS review_id FROM v_catalogue WHERE k_size <= 30",
    "v_review": "SELECT 'review-' || (k_part % 2) AS review_id, product_key FROM v_catalogue WHERE k_size % 10 <> 7",
    "v_approved": """
SELECT p.mpn, manufacturer_name AS manufacturer, model, memory_generation AS memory_type, total_capacity_gb AS capacity_gb, module_count, speed_mt_s, form_factor
FROM v_policy p JOIN v_catalogue c ON c.mpn_normalized = p.mpn JOIN v_review r ON r.review_id = p.review_id AND r.product_key = c.product_key
WHERE memory_generation = 'DDR5' AND total_capacity_gb = 32 AND module_count = 2 AND form_factor = 'UDIMM'
""",
    "v_match": """
SELECT observation_id, count(entry) AS entry_count,
  CASE WHEN count(entry) = 1 THEN bool_and(http_status = 200 AND response_bytes > 0 AND fact_mpn = mpn AND fact_amount_minor = amount_minor
    AND fact_currency = currency AND fact_vat_included = (vat_state = 'included') AND retrieved_at = observed_at) END AS facts_equal
FROM (SELECT o.*, l.* EXCLUDE (evidence_id, seller_display_name, source_url), l.evidence_id AS entry FROM v_offer o LEFT JOIN v_ledger l ON o.evidence_id = l.evidence_id WHERE o.archived
  UNION ALL SELECT o.*, l.* EXCLUDE (evidence_id, seller_display_name, source_url), l.evidence_id AS entry FROM v_offer o LEFT JOIN v_ledger l
  ON o.source_url = l.source_url AND o.observed_at = l.retrieved_at AND o.seller_display_name = l.seller_display_name WHERE NOT o.archived)
GROUP BY observation_id
""",
    "v_offer_q": f"""
SELECT o.*, r.retailer_id, r.retailer_name, {AVAILABLE} AS stock, concat_ws(',',
  CASE WHEN archived AND NOT identity_exact THEN 'archived_identity_not_exact' END,
  CASE WHEN NOT archived AND mpn_expected <> o.mpn THEN 'direct_identity_not_exact_mpn' END,
  CASE WHEN amount_minor <= 0 THEN 'invalid_item_price' END,
  CASE WHEN currency <> 'GBP' THEN 'currency_not_gbp' END,
  CASE WHEN vat_state <> 'included' THEN 'vat_not_explicitly_included' END,
  CASE WHEN {AVAILABLE} IS NULL THEN 'availability_not_explicitly_orderable' END,
  CASE WHEN r.retailer_id IS NULL THEN 'retailer_not_recognised' END,
  CASE WHEN seller_relationship <> 'retailer_owned' THEN 'seller_not_retailer_owned' END,
  CASE WHEN entry_count = 0 THEN 'missing_evidence_ledger_entry' WHEN entry_count > 1 THEN 'ambiguous_evidence_ledger_entry' END,
  CASE WHEN NOT facts_equal THEN 'evidence_facts_mismatch' END,
  CASE WHEN r.retailer_id IS NOT NULL AND NOT {URL_OK} THEN 'source_url_contract_mismatch' END,
  CASE WHEN stock_semantics = 'ambiguous' OR contains(lower(review_note), 'identity_mismatch') THEN 'record_specific_ambiguity_restriction_or_rejection' END,
  CASE WHEN publication_allowed THEN 'record_authority_drift' END) AS reasons
FROM v_offer o JOIN v_approved a ON a.mpn = o.mpn LEFT JOIN v_retailer r ON r.accepted_name = o.seller_display_name JOIN v_match m ON m.observation_id = o.observation_id
""",
    # Merged instants: times cut to the quarter hour so several offers share a key.
    "v_cand": """
SELECT 'offer-' || substring(sha256(concat_ws(chr(31), mpn, retailer_id, strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ'), CAST(amount_minor AS VARCHAR), currency, source_url)), 1, 24) AS public_observation_id,
  observed_at, CASE WHEN archived THEN 'archived_retail_observation' ELSE 'direct_retail_observation' END AS observation_kind, mpn, retailer_id, retailer_name,
  amount_minor AS item_price_minor, currency, vat_state, stock AS availability, 'excluded_not_verified' AS delivery_state, source_url, observation_id
FROM v_offer_q WHERE reasons = ''
""",
    "v_copied": """
SELECT * FROM v_cand UNION ALL SELECT * REPLACE (observation_id || '-copy' AS observation_id) FROM v_cand WHERE item_price_minor % 9 = 0
UNION ALL SELECT * REPLACE (observation_id || '-clash' AS observation_id, item_price_minor + 1 AS item_price_minor) FROM v_cand WHERE item_price_minor % 9 = 1
""",
    "v_public": """
SELECT public_observation_id, observed_at, observation_kind, mpn, retailer_id, retailer_name, item_price_minor, currency, vat_state, availability, delivery_state, source_url
FROM (SELECT *, row_number() OVER (PARTITION BY mpn, retailer_id, observed_at ORDER BY observation_id) AS rn,
  count(*) OVER (PARTITION BY mpn, retailer_id, observed_at) AS n, f.fact_sets FROM v_copied
  JOIN (SELECT mpn AS m, retailer_id AS r, observed_at AS t, count(DISTINCT (public_observation_id, item_price_minor, source_url, availability, observation_kind)) AS fact_sets FROM v_copied GROUP BY ALL) f
  ON f.m = mpn AND f.r = retailer_id AND f.t = observed_at) WHERE fact_sets = 1 AND rn = 1
""",
    "v_day_row": """
SELECT * FROM (SELECT CAST((observed_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS DATE) AS date, *,
  row_number() OVER (PARTITION BY CAST((observed_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS DATE), mpn, retailer_id ORDER BY observed_at DESC, public_observation_id DESC) AS rn
  FROM v_public WHERE availability = 'in_stock' AND item_price_minor <> 9999999) WHERE rn = 1
""",
    "v_day_product": """
SELECT date, mpn, CAST(floor(quantile_cont(item_price_minor, 0.5) + 0.5) AS BIGINT) AS median_minor, min(item_price_minor) AS low_minor,
  max(item_price_minor) AS high_minor, count(*) AS retailer_count FROM v_day_row GROUP BY ALL
""",
    "v_day": """
SELECT p.date, typical_minor, low_minor, high_minor, product_count, (SELECT count(*) FROM v_approved) AS declared_product_count, retailer_count, observation_count,
  CAST(floor(product_count * 1000 / (SELECT count(*) FROM v_approved)) AS BIGINT) AS coverage_permille, capture_basis
FROM (SELECT date, CAST(floor(quantile_cont(median_minor, 0.5) + 0.5) AS BIGINT) AS typical_minor, count(*) AS product_count FROM v_day_product GROUP BY date) p
JOIN (SELECT date, min(item_price_minor) AS low_minor, max(item_price_minor) AS high_minor, count(DISTINCT retailer_id) AS retailer_count, count(*) AS observation_count,
  CASE WHEN count(DISTINCT observation_kind) > 1 THEN 'mixed' WHEN min(observation_kind) = 'direct_retail_observation' THEN 'direct' ELSE 'archive' END AS capture_basis
  FROM v_day_row GROUP BY date) r ON r.date = p.date
""",
})
