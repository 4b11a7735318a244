"""Qualification and movement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.periods import instant_text
from pricetrail.functions.reasons import stacked
from pricetrail.operators import movements, qualify
from pricetrail.plans.registry import register
from pricetrail.sources.adapter import (
    evidence_ledger,
    landed_observations,
    lines,
    observations,
    offer_observations,
    retailers,
    sellers,
)
from pricetrail.sources.tables import literal_table, table


def joined(column: str = "reasons") -> F.Column:
    return F.array_join(column, ",").alias("reasons")


def qualified(spark: SparkSession, root: str) -> DataFrame:
    return qualify.qualify_landed(landed_observations(spark, root))


@register("qualify_landed", "SELECT observation_id, status, reasons, CASE WHEN status = 'eligible' THEN landed_price_minor END AS landed_price_minor FROM v_qual")
def _(spark, root):
    return qualified(spark, root).select(
        "observation_id", "status", joined(),
        F.when(F.col("status") == "eligible", F.col("landed_price_minor")).alias("landed_price_minor"),
    )


@register("reason_codes_sql", "SELECT observation_id, reasons FROM v_persisted")
def _(spark, root):
    return qualify.reason_codes_sql(landed_observations(spark, root)).select("observation_id", joined())


@register("qualify_quoted", """
SELECT observation_id, CASE WHEN reasons = '' THEN 'eligible' ELSE 'abstain' END AS status, reasons FROM (
SELECT observation_id, concat_ws(',', CASE WHEN match_basis <> 'exact_mpn' OR mpn_observed IS NULL OR mpn_observed <> mpn_expected THEN 'exact_mpn_unresolved' END,
  CASE WHEN seller_relationship <> 'retailer_owned' THEN 'retailer_owned_seller_unresolved' END,
  CASE WHEN item_price_minor <= 0 THEN 'item_price_not_positive_safe_integer' END, CASE WHEN currency <> 'GBP' THEN 'currency_not_gbp' END,
  CASE WHEN vat_state <> 'included' THEN 'vat_inclusion_unresolved' END) AS reasons FROM v_landed)""")
def _(spark, root):
    return qualify.qualify_quoted(landed_observations(spark, root)).select("observation_id", "status", joined())


AVAILABILITY_SQL = """CASE WHEN stock_semantics <> 'explicit' THEN NULL
  WHEN regexp_matches(lower(stock_text), 'out of stock|sold out|unavailable|not available') THEN NULL
  WHEN stock_state IN ('in_stock', 'available_to_order') THEN stock_state
  WHEN stock_state = 'stated_at_capture' AND regexp_matches(lower(stock_text), 'in stock|hurry, only [1-9][0-9]* left') THEN 'in_stock'
  WHEN stock_state = 'stated_at_capture' AND contains(lower(stock_text), 'available to order') THEN 'available_to_order' END"""


@register("classify_availability", f"SELECT observation_id, {AVAILABILITY_SQL} AS availability FROM v_offer")
def _(spark, root):
    return offer_observations(spark, root).select(
        "observation_id",
        qualify.classify_availability(F.col("stock_state"), F.col("stock_text"), F.col("stock_semantics")).alias("availability"),
    )


MATCH_SQL = """
SELECT o.observation_id, o.archived, count(l.evidence_id) AS entry_count,
  CASE WHEN count(l.evidence_id) = 1 THEN bool_and(l.http_status = 200 AND l.response_bytes > 0 AND l.fact_mpn = o.mpn AND l.fact_amount_minor = o.amount_minor
    AND l.fact_currency = o.currency AND l.fact_vat_included = (o.vat_state = 'included') AND l.retrieved_at = o.observed_at) END AS facts_equal
FROM v_offer o LEFT JOIN v_ledger l ON CASE WHEN o.archived THEN o.evidence_id = l.evidence_id
  ELSE o.source_url = l.source_url AND o.observed_at = l.retrieved_at AND o.seller_display_name = l.seller_display_name END
GROUP BY ALL"""


@register("match_evidence", """
WITH a AS (SELECT o.*, l.* EXCLUDE (evidence_id, seller_display_name, source_url), l.evidence_id AS entry FROM v_offer o LEFT JOIN v_ledger l ON o.evidence_id = l.evidence_id WHERE o.archived),
b AS (SELECT o.*, l.* EXCLUDE (evidence_id, seller_display_name, source_url), l.evidence_id AS entry FROM v_offer o LEFT JOIN v_ledger l
  ON o.source_url = l.source_url AND o.observed_at = l.retrieved_at AND o.seller_display_name = l.seller_display_name WHERE NOT o.archived)
SELECT observation_id, count(entry) AS entry_count,
  CASE WHEN count(entry) = 1 THEN coalesce(bool_and(http_status = 200 AND response_bytes > 0 AND fact_mpn = mpn AND fact_amount_minor = amount_minor
    AND fact_currency = currency AND fact_vat_included = (vat_state = 'included') AND retrieved_at = observed_at), false) END AS facts_equal
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY observation_id""")
def _(spark, root):
    return qualify.match_evidence(offer_observations(spark, root), evidence_ledger(spark, root))


@register("check_source_url", """
SELECT observation_id, https_host IS NOT NULL AND CASE WHEN archived THEN
  regexp_matches(source_url, '^https://web\\.archive\\.org/web/[0-9]{14}id_/https://[^/:@?#]+(/[^?#]*)?$')
  AND regexp_extract(source_url, 'id_/https://([^/]+)', 1) = https_host AND regexp_extract(source_url, '/web/([0-9]{14})id_', 1) = strftime(observed_at, '%Y%m%d%H%M%S')
  ELSE regexp_matches(source_url, '^https://[^/:@?#]+(/[^?#]*)?$') AND regexp_extract(source_url, '^https://([^/]+)', 1) = https_host END AS url_ok
FROM v_offer LEFT JOIN v_retailer ON seller_display_name = accepted_name""")
def _(spark, root):
    o = offer_observations(spark, root)
    r = retailers(spark, root)
    return o.join(r, o.seller_display_name == r.accepted_name, "left").select(
        "observation_id",
        qualify.check_source_url(F.col("source_url"), F.col("archived"), F.col("observed_at"), F.array("https_host")).alias("url_ok"),
    )


@register("restriction_reasons", """
SELECT observation_id, concat_ws(',', CASE WHEN stock_semantics = 'ambiguous' OR contains(lower(review_note), 'identity_mismatch')
  THEN 'record_specific_ambiguity_restriction_or_rejection' END, CASE WHEN publication_allowed THEN 'record_authority_drift' END) AS reasons FROM v_offer""")
def _(spark, root):
    return offer_observations(spark, root).select(
        "observation_id",
        F.array_join(qualify.restriction_reasons(["review_note", "stock_semantics"], ["publication_allowed"]), ",").alias("reasons"),
    )


def tax_resolutions(spark: SparkSession, root: str) -> DataFrame:
    """Settle the unresolved tax basis of high-quantity lines; some entries are wrong."""
    o = lines(spark, root).where("vat_included IS NULL AND k_qty > 25")
    return o.select(
        F.when(F.col("k_line") == 7, F.concat(F.col("observation_id"), F.lit("-x"))).otherwise(F.col("observation_id")).alias("observation_id"),
        F.when(F.col("k_line") == 6, F.lit(True)).alias("vat_before"),
        F.lit(True).alias("vat_after"),
    )


RESOLUTION_SQL = """SELECT CASE WHEN k_line = 7 THEN observation_id || '-x' ELSE observation_id END AS observation_id,
  CASE WHEN k_line = 6 THEN true END AS vat_before, true AS vat_after FROM v_lines WHERE vat_included IS NULL AND k_qty > 25"""


@register("apply_tax_resolutions", f"""
WITH r AS ({RESOLUTION_SQL})
SELECT o.observation_id, CASE WHEN r.observation_id IS NOT NULL THEN r.vat_after ELSE o.vat_included END AS vat_included,
  CASE WHEN r.observation_id IS NOT NULL THEN 'tax-resolution-1' END AS vat_resolution_source
FROM v_lines o LEFT JOIN r ON o.observation_id = r.observation_id""")
def _(spark, root):
    out = qualify.apply_tax_resolutions(lines(spark, root), tax_resolutions(spark, root), "tax-resolution-1")
    return out.select("observation_id", "vat_included", "vat_resolution_source")


@register("check_tax_resolutions", f"""
WITH r AS ({RESOLUTION_SQL})
SELECT CASE WHEN o.observation_id IS NULL THEN 'unknown_observation_in_resolution' ELSE 'resolution_before_state_mismatch' END AS rule,
  r.observation_id AS key, '' AS detail FROM r LEFT JOIN v_lines o ON o.observation_id = r.observation_id
WHERE o.observation_id IS NULL OR r.vat_before IS DISTINCT FROM o.vat_included""")
def _(spark, root):
    return qualify.check_tax_resolutions(lines(spark, root), tax_resolutions(spark, root))


def aliases(spark: SparkSession, root: str) -> DataFrame:
    return sellers(spark, root).select(F.col("seller_observed").alias("observed_name"), F.col("seller").alias("canonical_name"))


@register("apply_seller_resolution", "SELECT observation_id, seller_observed, seller AS seller_resolved FROM v_obs")
def _(spark, root):
    o = observations(spark, root).select("observation_id", "seller_observed")
    return qualify.apply_seller_resolution(o, aliases(spark, root))


@register("check_seller_resolution", """
WITH roster AS (SELECT r_name AS seller_name FROM region WHERE r_name <> 'ASIA'),
al AS (SELECT s_name AS observed_name, r_name AS canonical_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_suppkey <> 7 UNION ALL SELECT s_name, 'EUROPE' FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT r_name, 'AFRICA' FROM region WHERE r_name = 'AMERICA')
SELECT 'alias_target_not_on_roster' AS rule, observed_name AS key, canonical_name AS detail FROM al WHERE canonical_name NOT IN (SELECT seller_name FROM roster)
UNION ALL SELECT 'duplicate_alias', observed_name, CAST(count(*) AS VARCHAR) FROM al GROUP BY observed_name HAVING count(*) > 1
UNION ALL SELECT 'roster_seller_is_also_alias', observed_name, '' FROM al WHERE observed_name IN (SELECT seller_name FROM roster)
UNION ALL SELECT 'unrostered_seller', seller_observed, CAST(count(*) AS VARCHAR) FROM v_obs
  WHERE seller_observed NOT IN (SELECT observed_name FROM al WHERE canonical_name IN (SELECT seller_name FROM roster)) GROUP BY seller_observed""")
def _(spark, root):
    region = table(spark, root, "region")
    roster = region.where("r_name <> 'ASIA'").select(F.col("r_name").alias("seller_name"))
    base = aliases(spark, root).where("observed_name <> 'Supplier#000000007'")
    doubled = sellers(spark, root).where("k_supp = 3").select(
        F.col("seller_observed").alias("observed_name"), F.lit("EUROPE").alias("canonical_name")
    )
    own = region.where("r_name = 'AMERICA'").select(F.col("r_name").alias("observed_name"), F.lit("AFRICA").alias("canonical_name"))
    return qualify.check_seller_resolution(observations(spark, root), roster, stacked(base, doubled, own))


@register("quarantine_sentinels", f"""
SELECT count(*) FILTER (WHERE coalesce({AVAILABILITY_SQL}, '') <> 'in_stock') AS not_in_stock_count,
  count(*) FILTER (WHERE {AVAILABILITY_SQL} = 'in_stock' AND amount_minor = 9999999) AS sentinel_price_count,
  count(*) FILTER (WHERE {AVAILABILITY_SQL} = 'in_stock' AND amount_minor <> 9999999) AS kept_count FROM v_offer""")
def _(spark, root):
    o = offer_observations(spark, root).withColumn(
        "availability", qualify.classify_availability(F.col("stock_state"), F.col("stock_text"), F.col("stock_semantics"))
    )
    return qualify.quarantine_sentinels(o, [9999999])[1]


@register("check_contract", """
SELECT 'currency_not_gbp' AS rule, observation_id AS key, '' AS detail FROM v_landed WHERE currency <> 'GBP'
UNION ALL SELECT 'observation_id_not_unique', observation_id, CAST(count(*) AS VARCHAR) FROM v_landed GROUP BY observation_id HAVING count(*) > 1""")
def _(spark, root):
    return qualify.check_contract(landed_observations(spark, root))


@register("check_locks", """
SELECT 'publication_allowed_must_remain_false' AS rule, observation_id AS key, '' AS detail FROM v_offer WHERE publication_allowed
UNION ALL SELECT 'index_eligibility_must_remain_false', observation_id, '' FROM v_offer WHERE k_part % 19 <> 0 IS NULL""")
def _(spark, root):
    o = offer_observations(spark, root).withColumn("index_eligibility", F.lit(False))
    return qualify.check_locks(o, "observation_id", ["publication_allowed", "index_eligibility"])


@register("check_landed_arithmetic", """
WITH p AS (SELECT *, CASE WHEN availability = 'out_of_stock' THEN 'stale' ELSE reasons END AS recorded, CASE WHEN reasons = '' OR seller_relationship = 'third_party' THEN 'eligible' ELSE 'abstain' END AS st FROM v_persisted),
r AS (SELECT 'delivery_state_amount_disagree' AS rule, observation_id AS key FROM p WHERE delivery_state = 'free_delivery_explicit' AND delivery_amount_minor <> 0
UNION ALL SELECT 'landed_state_amount_disagree', observation_id FROM p WHERE (landed_eligibility = 'eligible') <> (landed_price_minor IS NOT NULL)
UNION ALL SELECT 'landed_not_item_plus_delivery', observation_id FROM p WHERE landed_price_minor <> item_price_minor + delivery_amount_minor
UNION ALL SELECT 'recorded_reasons_differ', observation_id FROM p WHERE recorded <> reasons
UNION ALL SELECT 'status_reasons_disagree', observation_id FROM p WHERE (st = 'eligible') <> (reasons = ''))
SELECT rule, key, '' AS detail FROM r""")
def _(spark, root):
    p = qualify.reason_codes_sql(landed_observations(spark, root))
    recorded = p.withColumns({
        "recorded_reasons": F.when(F.col("availability") == "out_of_stock", F.lit("stale")).otherwise(F.array_join("reasons", ",")),
        "recorded_status": F.when((F.size("reasons") == 0) | (F.col("seller_relationship") == "third_party"), F.lit("eligible")).otherwise(F.lit("abstain")),
    })
    return qualify.check_landed_arithmetic(recorded)


MOVE_COLUMNS = """product_key, retailer_key, strftime(from_date, '%Y-%m-%d') AS from_date, strftime(to_date, '%Y-%m-%d') AS to_date, from_minor, to_minor,
  from_observation_id, to_observation_id, change_minor, change_basis_points, direction"""


@register("line_movements", f"SELECT {MOVE_COLUMNS} FROM v_move")
def _(spark, root):
    return movements.line_movements(qualified(spark, root)).withColumns(
        {"from_date": F.col("from_date").cast("string"), "to_date": F.col("to_date").cast("string")}
    )


@register("line_conflicts", "SELECT product_key, retailer_key, strftime(date, '%Y-%m-%d') AS date, n AS eligible_count FROM v_daily_line WHERE n > 1")
def _(spark, root):
    return movements.line_conflicts(qualified(spark, root)).withColumn("date", F.col("date").cast("string"))


@register("insufficient_history", """
SELECT product_key, retailer_key, count(DISTINCT CASE WHEN status = 'eligible' THEN CAST(observed_at AS DATE) END) AS eligible_date_count,
  strftime(max(CASE WHEN status = 'eligible' THEN CAST(observed_at AS DATE) END), '%Y-%m-%d') AS only_date, 'requires_at_least_two_eligible_dates' AS reason
FROM v_qual GROUP BY ALL HAVING count(DISTINCT CASE WHEN status = 'eligible' THEN CAST(observed_at AS DATE) END) < 2""")
def _(spark, root):
    return movements.insufficient_history(qualified(spark, root)).withColumn("only_date", F.col("only_date").cast("string"))


def widest(spark: SparkSession, root: str) -> DataFrame:
    return movements.widest_movements(observations(spark, root)).withColumns({
        "from_observed_at": instant_text(F.col("from_observed_at")), "to_observed_at": instant_text(F.col("to_observed_at"))
    })


@register("widest_movements", """
SELECT * REPLACE (strftime(from_observed_at, '%Y-%m-%dT%H:%M:%SZ') AS from_observed_at, strftime(to_observed_at, '%Y-%m-%dT%H:%M:%SZ') AS to_observed_at) FROM v_widest""")
def _(spark, root):
    return widest(spark, root)


@register("quoted_history", """
WITH e AS (SELECT mpn FROM v_solo GROUP BY mpn HAVING count(DISTINCT coalesce(seller_legal_name, '')) = 1 AND max(seller_legal_name) IS NOT NULL AND count(*) >= 2
  AND bool_or(capture_kind = 'archive_capture') AND bool_or(capture_kind = 'prospective_capture')),
p AS (SELECT o.mpn, observed_at, arg_min(struct_pack(observation_id, amount_minor, seller_legal_name), observation_id) AS r FROM v_solo o JOIN e ON o.mpn = e.mpn GROUP BY ALL)
SELECT * FROM (SELECT mpn, r.seller_legal_name AS seller_legal_name, lag(r.observation_id) OVER w AS from_observation_id, r.observation_id AS to_observation_id,
  lag(r.amount_minor) OVER w AS denominator_minor, r.amount_minor AS to_minor, r.amount_minor - lag(r.amount_minor) OVER w AS delta_minor
  FROM p WINDOW w AS (PARTITION BY mpn ORDER BY observed_at)) WHERE from_observation_id IS NOT NULL""")
def _(spark, root):
    return movements.quoted_history(solo_lines(spark, root))


def solo_lines(spark: SparkSession, root: str) -> DataFrame:
    """Products named down to one country, so single-seller products exist."""
    o = observations(spark, root)
    return o.withColumn("mpn", F.when(F.col("k_qty") > 10, F.concat_ws("-", "mpn", "seller_fine")).otherwise(F.col("mpn")))


@register("movement_drift", """
WITH rec AS (SELECT movement_id || CASE WHEN comparison_basis = 'cross_seller' OR delta_minor % 50 = 0 THEN '-old' ELSE '' END AS movement_id,
  from_minor, to_minor, delta_minor + CASE WHEN delta_minor % 7 = 0 THEN 1 ELSE 0 END AS delta_minor, comparison_basis FROM v_widest)
SELECT CASE WHEN d.movement_id IS NULL THEN 'movement_not_derivable' ELSE 'movement_values_differ' END AS rule, r.movement_id AS key,
  CASE WHEN d.movement_id IS NULL THEN '' ELSE 'delta_minor' END AS detail
FROM rec r LEFT JOIN v_widest d ON r.movement_id = d.movement_id WHERE d.movement_id IS NULL OR r.delta_minor <> d.delta_minor""")
def _(spark, root):
    derived = movements.widest_movements(observations(spark, root))
    old = (F.col("comparison_basis") == "cross_seller") | (F.col("delta_minor") % 50 == 0)
    recorded = derived.select(
        F.concat(F.col("movement_id"), F.when(old, F.lit("-old")).otherwise(F.lit(""))).alias("movement_id"),
        "from_minor", "to_minor",
        (F.col("delta_minor") + F.when(F.col("delta_minor") % 7 == 0, 1).otherwise(0)).alias("delta_minor"),
        "comparison_basis",
    )
    return movements.movement_drift(recorded, derived)


@register("movement_lineage", """
WITH m AS (SELECT * REPLACE (CASE WHEN change_minor % 11 = 0 THEN change_basis_points + 1 ELSE change_basis_points END AS change_basis_points,
    CASE WHEN change_minor % 13 = 0 THEN from_minor + 1 ELSE from_minor END AS from_minor,
    CASE WHEN change_minor % 17 = 0 THEN 'gone-' || to_observation_id ELSE to_observation_id END AS to_observation_id),
    from_minor AS true_from FROM v_move),
j AS (SELECT m.*, a.status AS sa, z.status AS sz, a.landed_price_minor AS pa, z.landed_price_minor AS pz,
  CAST(sign(change_minor) AS BIGINT) * ((20000 * abs(change_minor) + from_minor) // (2 * from_minor)) AS bp
  FROM m LEFT JOIN v_qual a ON a.observation_id = from_observation_id LEFT JOIN v_qual z ON z.observation_id = to_observation_id)
SELECT rule, from_observation_id || '|' || to_observation_id AS key, '' AS detail FROM (
SELECT 'endpoint_missing' AS rule, * FROM j WHERE sa IS NULL OR sz IS NULL
UNION ALL SELECT 'price_differs', * FROM j WHERE sa IS NOT NULL AND sz IS NOT NULL AND (pa <> from_minor OR pz <> to_minor)
UNION ALL SELECT 'basis_points_differ', * FROM j WHERE change_basis_points <> bp)""")
def _(spark, root):
    q = qualified(spark, root)
    m = movements.line_movements(q)
    change = F.col("change_minor")
    spoiled = m.withColumns({
        "change_basis_points": F.col("change_basis_points") + F.when(change % 11 == 0, 1).otherwise(0),
        "from_minor": F.col("from_minor") + F.when(change % 13 == 0, 1).otherwise(0),
        "to_observation_id": F.when(change % 17 == 0, F.concat(F.lit("gone-"), "to_observation_id")).otherwise(F.col("to_observation_id")),
    })
    return movements.movement_lineage(spoiled, q)


@register("observation_lineage", """
WITH o AS (SELECT l_orderkey, observation_id, product_key, mpn_expected, retailer_key FROM v_landed JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON CAST(split_part(observation_id, '-', 1) AS BIGINT) = l_orderkey)
SELECT 'product_revision_disagrees' AS rule, observation_id AS key, 'rev-' || product_key || '|' || product_key || '|' || mpn_expected AS detail FROM o
  WHERE product_key NOT IN (SELECT lower(mpn_normalized) FROM v_catalogue WHERE k_size <> 13)
UNION ALL SELECT 'retailer_region_disagrees', observation_id, retailer_key || '|GB' FROM o WHERE retailer_key IN (SELECT lower(replace(n_name, '_', '-')) FROM nation WHERE n_regionkey = 2)
UNION ALL SELECT 'source_policy_disagrees', observation_id, 'policy-1|src-' || retailer_key FROM o WHERE retailer_key IN (SELECT lower(replace(n_name, '_', '-')) FROM nation WHERE n_nationkey = 5)""")
def _(spark, root):
    from pricetrail.sources.adapter import catalogue, retailer_key

    o = landed_observations(spark, root).select(
        "observation_id", "product_key", "mpn_expected", "retailer_key",
        F.concat(F.lit("rev-"), "product_key").alias("revision_id"), F.lit("GB").alias("region"),
        F.lit("policy-1").alias("policy_id"), F.concat(F.lit("src-"), "retailer_key").alias("source_key"),
    )
    revisions = catalogue(spark, root).where("k_size <> 13").select(
        F.concat(F.lit("rev-"), F.lower("mpn_normalized")).alias("revision_id"),
        F.lower("mpn_normalized").alias("product_key"), F.col("mpn_normalized").alias("mpn_expected"),
    )
    nation = table(spark, root, "nation")
    key = retailer_key(F.col("n_name"))
    regions = nation.select(key.alias("retailer_key"), F.when(F.col("n_regionkey") == 2, F.lit("XX")).otherwise(F.lit("GB")).alias("region"))
    policies = nation.where("n_nationkey <> 5").select(F.lit("policy-1").alias("policy_id"), F.concat(F.lit("src-"), key).alias("source_key"))
    return movements.observation_lineage(o, revisions, regions, policies)
