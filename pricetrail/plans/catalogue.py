"""Catalogue and listing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.reasons import stacked
from pricetrail.functions.text import normalise_manufacturer, normalise_mpn
from pricetrail.operators import catalogue as ops
from pricetrail.plans.registry import register
from pricetrail.session import settle
from pricetrail.sources.adapter import catalogue, listings, manufacturer_aliases
from pricetrail.sources.tables import literal_table, table

DECISIONS = ["match", "no_match", "abstain_ambiguous", "abstain_insufficient", "unsupported"]


def identifiers(spark: SparkSession, root: str) -> DataFrame:
    """A primary MPN per product, some second primaries, GTINs that collide, moved ones."""
    c = catalogue(spark, root)
    key = F.col("product_key")
    own = c.where("k_size <> 12").select(key, "manufacturer_key", F.lit("MPN").alias("identifier_type"), F.col("mpn_normalized").alias("normalized_value"), F.lit(True).alias("is_primary"))
    second = c.where("k_size = 11").select(key, "manufacturer_key", F.lit("MPN").alias("identifier_type"), F.concat(F.lit("ALT-"), F.col("model")).alias("normalized_value"), F.lit(True).alias("is_primary"))
    gtin = c.select(
        key, F.when(F.col("k_size") == 9, F.lit("brand-other")).otherwise(F.col("manufacturer_key")).alias("manufacturer_key"),
        F.lit("GTIN").alias("identifier_type"), F.concat(F.lit("50"), F.lpad((F.col("k_part") - F.col("k_part") % 3 * F.when(F.col("k_size") < 5, 1).otherwise(0)).cast("string"), 11, "0")).alias("normalized_value"),
        F.lit(False).alias("is_primary"),
    )
    return stacked(own, second, gtin)


IDENT = """(SELECT product_key, manufacturer_key, 'MPN' AS identifier_type, mpn_normalized AS normalized_value, true AS is_primary FROM v_catalogue WHERE k_size <> 12
UNION ALL SELECT product_key, manufacturer_key, 'MPN', 'ALT-' || model, true FROM v_catalogue WHERE k_size = 11
UNION ALL SELECT product_key, CASE WHEN k_size = 9 THEN 'brand-other' ELSE manufacturer_key END, 'GTIN',
  '50' || lpad(CAST(k_part - k_part % 3 * CASE WHEN k_size < 5 THEN 1 ELSE 0 END AS VARCHAR), 11, '0'), false FROM v_catalogue)"""


@register("normalise_mpn", """
SELECT listing_id, upper(trim(mpn_raw)) AS mpn, regexp_replace(lower(manufacturer_raw), '[^a-z0-9]', '', 'g') AS manufacturer FROM v_listing""")
def _(spark, root):
    return listings(spark, root).select(
        "listing_id", normalise_mpn(F.col("mpn_raw")).alias("mpn"), normalise_manufacturer(F.col("manufacturer_raw")).alias("manufacturer")
    )


@register("check_catalogue", f"""
SELECT 'specification_out_of_scope' AS rule, product_key AS key, '' AS detail FROM v_catalogue WHERE memory_generation <> 'DDR5' OR total_capacity_gb <> 32 OR form_factor <> 'UDIMM'
UNION ALL SELECT 'alias_with_two_owners', regexp_replace(lower(alias), '[^a-z0-9]', '', 'g'), CAST(count(DISTINCT manufacturer_key) AS VARCHAR) FROM v_alias
  GROUP BY 2 HAVING count(DISTINCT manufacturer_key) > 1
UNION ALL SELECT 'primary_mpn_count', c.product_key, CAST(count(i.product_key) FILTER (WHERE identifier_type = 'MPN' AND is_primary) AS VARCHAR)
  FROM v_catalogue c LEFT JOIN {IDENT} i ON i.product_key = c.product_key GROUP BY c.product_key HAVING count(i.product_key) FILTER (WHERE identifier_type = 'MPN' AND is_primary) <> 1""")
def _(spark, root):
    return ops.check_catalogue(catalogue(spark, root), manufacturer_aliases(spark, root), identifiers(spark, root))


LISTING_KEYED = """SELECT l.*, upper(trim(mpn_raw)) AS mpn_key, m.manufacturer_key FROM v_listing l
  LEFT JOIN (SELECT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS a, min(manufacturer_key) AS manufacturer_key FROM v_alias GROUP BY 1) m
  ON m.a = regexp_replace(lower(manufacturer_raw), '[^a-z0-9]', '', 'g')"""

NEAR_SQL = f"""
WITH k AS ({LISTING_KEYED}), w AS (SELECT DISTINCT manufacturer_key, mpn_key FROM k WHERE manufacturer_key IS NOT NULL AND mpn_key IS NOT NULL)
SELECT w.manufacturer_key, mpn_key, mpn_normalized AS near_mpn, product_key AS near_product_key, levenshtein(mpn_key, mpn_normalized) AS distance
FROM w JOIN v_catalogue c ON c.manufacturer_key = w.manufacturer_key WHERE levenshtein(mpn_key, mpn_normalized) BETWEEN 1 AND 2"""


@register("near_mpn", NEAR_SQL)
def _(spark, root):
    keyed = ops.with_manufacturer(listings(spark, root), manufacturer_aliases(spark, root))
    return ops.near_mpn(keyed, catalogue(spark, root))


MATCH_SQL = f"""
WITH k AS ({LISTING_KEYED}),
j AS (SELECT k.*, c.product_key, n.n AS number_products, n.owner AS number_owner, r.n AS maker_products,
  coalesce(k.memory_generation <> c.memory_generation, false) OR coalesce(k.form_factor <> c.form_factor, false) OR coalesce(k.module_count <> c.module_count, false)
    OR coalesce(k.total_capacity_gb <> c.total_capacity_gb, false) OR coalesce(k.ecc <> c.ecc, false) AS conflict,
  EXISTS (SELECT 1 FROM v_catalogue x WHERE x.manufacturer_key = k.manufacturer_key AND levenshtein(x.mpn_normalized, k.mpn_key) BETWEEN 1 AND 2) AS is_near
  FROM k LEFT JOIN v_catalogue c ON c.manufacturer_key = k.manufacturer_key AND c.mpn_normalized = k.mpn_key
  LEFT JOIN (SELECT mpn_normalized, count(*) AS n, min(manufacturer_key) AS owner FROM v_catalogue GROUP BY 1) n ON n.mpn_normalized = k.mpn_key
  LEFT JOIN (SELECT manufacturer_key, count(*) AS n FROM v_catalogue GROUP BY 1) r ON r.manufacturer_key = k.manufacturer_key),
d AS (SELECT *, CASE WHEN product_key IS NOT NULL AND conflict THEN 'abstain_ambiguous/specification_conflict'
  WHEN product_key IS NOT NULL AND mpn_raw = mpn_key THEN 'match/exact_mpn' WHEN product_key IS NOT NULL THEN 'match/normalized_mpn'
  WHEN memory_generation <> 'DDR5' THEN 'unsupported/unsupported_memory_type' WHEN form_factor <> 'UDIMM' THEN 'unsupported/unsupported_form_factor'
  WHEN module_count <> 2 THEN 'unsupported/unsupported_module_configuration' WHEN total_capacity_gb <> 32 THEN 'unsupported/unsupported_capacity'
  WHEN gtin_raw IS NOT NULL AND NOT regexp_full_match(gtin_raw, '[0-9]{{8}}|[0-9]{{12,14}}') THEN 'abstain_insufficient/malformed_identifier'
  WHEN mpn_key IS NULL AND regexp_matches(title, '(?i)\\b(choose|or)\\b') THEN 'abstain_ambiguous/multi_product_listing'
  WHEN mpn_key IS NULL AND gtin_raw IS NULL AND maker_products > 1 THEN 'abstain_ambiguous/multiple_candidates'
  WHEN mpn_key IS NULL THEN 'abstain_insufficient/missing_identifier'
  WHEN number_products = 1 AND number_owner IS DISTINCT FROM manufacturer_key THEN 'abstain_ambiguous/manufacturer_mismatch'
  WHEN is_near THEN 'abstain_insufficient/near_mpn_only' WHEN manufacturer_key IS NOT NULL THEN 'no_match/no_catalogue_product'
  ELSE 'abstain_insufficient/missing_identifier' END AS outcome FROM j),
matches AS (SELECT listing_id, split_part(outcome, '/', 1) AS decision, split_part(outcome, '/', 2) AS reason_code, CASE WHEN outcome LIKE 'match/%' THEN product_key END AS product_key FROM d)
"""


def matches(spark: SparkSession, root: str) -> DataFrame:
    return ops.match_listings(listings(spark, root), catalogue(spark, root), manufacturer_aliases(spark, root))


@register("match_listings", MATCH_SQL + "SELECT * FROM matches")
def _(spark, root):
    return matches(spark, root)


@register("scope_conflicts", """
SELECT listing_id, 'total_capacity_gb' AS field, CAST(total_capacity_gb AS VARCHAR) AS stated FROM v_listing WHERE total_capacity_gb <> 32
UNION ALL SELECT listing_id, 'module_count', CAST(module_count AS VARCHAR) FROM v_listing WHERE module_count <> 2
UNION ALL SELECT listing_id, 'memory_generation', memory_generation FROM v_listing WHERE memory_generation <> 'DDR5'
UNION ALL SELECT listing_id, 'form_factor', form_factor FROM v_listing WHERE form_factor <> 'UDIMM'
UNION ALL SELECT listing_id, 'ecc', CAST(ecc AS VARCHAR) FROM v_listing WHERE ecc""")
def _(spark, root):
    return ops.scope_conflicts(listings(spark, root))


@register("check_gtin", "SELECT listing_id, gtin_raw, length(gtin_raw) IN (8, 12, 13, 14) AND regexp_full_match(gtin_raw, '[0-9]+') AS well_formed FROM v_listing WHERE gtin_raw IS NOT NULL")
def _(spark, root):
    return ops.check_gtin(listings(spark, root))


@register("check_labels", MATCH_SQL + """
, labelled AS (SELECT l.listing_id, CASE WHEN l.title LIKE '%widget' THEN 'match' WHEN m.decision = 'unsupported' THEN 'no_match' ELSE m.decision END AS decision, m.reason_code, l.title LIKE '%ring' AS index_eligible
  FROM v_listing l JOIN matches m ON m.listing_id = l.listing_id)
SELECT rule, listing_id AS key, decision || '/' || reason_code AS detail FROM (
  SELECT 'label_not_supported' AS rule, m.listing_id, m.decision, m.reason_code FROM labelled x JOIN matches m ON m.listing_id = x.listing_id WHERE x.decision <> m.decision
  UNION ALL SELECT 'eligible_without_match', m.listing_id, m.decision, m.reason_code FROM labelled x JOIN matches m ON m.listing_id = x.listing_id WHERE x.index_eligible AND x.decision <> 'match')
UNION ALL SELECT 'decision_never_covered', d, '' FROM (SELECT unnest(['match', 'no_match', 'abstain_ambiguous', 'abstain_insufficient', 'unsupported']) AS d) WHERE d NOT IN (SELECT decision FROM labelled)""")
def _(spark, root):
    # Labels are made from the matches and compared with them, so these are written once.
    m = settle(matches(spark, root))
    # What is asked of titles is asked before anything moves, and moves with the prints of its listing.
    widget, ring = F.col("title").endswith("widget"), F.col("title").endswith("ring")
    one, two = ops.listing_prints(F.col("listing_id"))
    asked = listings(spark, root).where("listing_id IS NOT NULL").select(one.alias("one"), two.alias("two"), widget.alias("widget"), ring.alias("index_eligible"))
    labels = asked.join(m, ops.same_listing([F.col("one"), F.col("two")], F.col("listing_id"))).select(
        "listing_id",
        F.when(F.col("widget"), F.lit("match")).when(F.col("decision") == "unsupported", F.lit("no_match"))
        .otherwise(F.col("decision")).alias("decision"),
        "reason_code", "index_eligible",
    )
    return ops.check_labels(m, labels, DECISIONS)


@register("bind_evidence", """
WITH a AS (SELECT 'ref-' || k_part AS reference, mpn_normalized AS mpn, total_capacity_gb, module_count FROM v_catalogue WHERE k_size <> 20),
b AS (SELECT 'ref-' || k_part AS reference, mpn_normalized AS mpn, CASE WHEN k_size = 22 THEN 64 ELSE total_capacity_gb END AS total_capacity_gb, module_count FROM v_catalogue WHERE k_size <> 21
  UNION ALL SELECT 'ref-' || k_part, mpn_normalized, total_capacity_gb, module_count FROM v_catalogue WHERE k_size = 23)
SELECT 'reference_without_extract' AS rule, reference AS key, '' AS detail FROM a WHERE reference NOT IN (SELECT reference FROM b)
UNION ALL SELECT 'extract_without_reference', reference, '' FROM b WHERE reference NOT IN (SELECT reference FROM a)
UNION ALL SELECT 'extract_not_unique', reference, '' FROM b GROUP BY reference HAVING count(*) > 1
UNION ALL SELECT 'extract_facts_differ', a.reference, '' FROM a JOIN b ON a.reference = b.reference WHERE a.total_capacity_gb <> b.total_capacity_gb""")
def _(spark, root):
    c = catalogue(spark, root).select(
        F.concat(F.lit("ref-"), F.col("k_part").cast("string")).alias("reference"), F.col("mpn_normalized").alias("mpn"),
        "total_capacity_gb", "module_count", "k_size",
    )
    drifted = c.withColumn("total_capacity_gb", F.when(F.col("k_size") == 22, F.lit(64)).otherwise(F.col("total_capacity_gb")))
    held = stacked(drifted.where("k_size <> 21"), c.where("k_size = 23"))
    return ops.bind_evidence(c.where("k_size <> 20"), held)


@register("check_partition", """
SELECT 'in_both_parts' AS rule, product_key AS key, '' AS detail FROM v_catalogue WHERE k_size = 20
UNION ALL SELECT 'in_neither_part', product_key, '' FROM v_catalogue WHERE k_size = 40 UNION ALL SELECT 'not_in_whole', product_key, '' FROM v_catalogue WHERE k_size = 50""")
def _(spark, root):
    c = catalogue(spark, root)
    return ops.check_partition(c.where("k_size <> 50"), c.where("k_size <= 20"), c.where("k_size >= 20 AND k_size <> 40"), "product_key")


def memberships(spark: SparkSession, root: str) -> DataFrame:
    c = catalogue(spark, root).where("k_size <> 30")
    status = F.when(F.col("k_size") == 31, F.lit("reviewed_fixture")).otherwise(F.col("review_status"))
    blockers = (
        F.when(F.col("k_size") == 32, F.array().cast("array<string>"))
        .when(F.col("k_size") == 33, F.array(F.lit("additive-catalogue-review-pending"), F.lit("additive-catalogue-review-pending")))
        .otherwise(F.array(F.lit("additive-catalogue-review-pending"), F.lit("no-baseline")))
    )
    rows = c.select(
        "product_key", status.alias("status"), (F.col("k_size") == 34).alias("baseline_eligible"), F.lit(False).alias("reserve_candidate"),
        blockers.alias("eligibility_blockers"), "k_size",
    )
    return stacked(rows, rows.where("k_size = 35")).drop("k_size")


@register("coverage_report", """
WITH m AS (SELECT c.*, CASE WHEN k_size = 30 THEN 'none' WHEN k_size = 31 THEN 'reviewed_fixture' ELSE review_status END AS status FROM v_catalogue c)
SELECT 'manufacturer' AS layer, manufacturer_key AS key, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'family', family_key, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'speed', CAST(speed_mt_s AS VARCHAR), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'monitored_universe', 'all', count(*) FROM m""")
def _(spark, root):
    c = catalogue(spark, root)
    m = memberships(spark, root).dropDuplicates(["product_key"])
    return ops.coverage_report(c, c.select("product_key", "family_key"), m)


@register("missing_targets", "SELECT * FROM (SELECT unnest(['brand-1', 'brand-2', 'brand-77', 'lexar']) AS manufacturer_key) WHERE manufacturer_key NOT IN (SELECT manufacturer_key FROM v_catalogue)")
def _(spark, root):
    targets = literal_table(spark, "manufacturer_key string", [("brand-1",), ("brand-2",), ("brand-77",), ("lexar",)])
    return ops.missing_targets(catalogue(spark, root), targets)


@register("check_memberships", """
SELECT 'membership_missing' AS rule, product_key AS key, '' AS detail FROM v_catalogue WHERE k_size = 30
UNION ALL SELECT 'status_disagrees', product_key, '' FROM v_catalogue WHERE k_size = 31 AND review_status <> 'reviewed_fixture'
UNION ALL SELECT 'blockers_missing', product_key, '' FROM v_catalogue WHERE k_size = 32
UNION ALL SELECT 'review_blocker_missing', product_key, '' FROM v_catalogue WHERE k_size = 32 AND review_status = 'candidate_pending_review'
UNION ALL SELECT 'blockers_repeated', product_key, '' FROM v_catalogue WHERE k_size = 33
UNION ALL SELECT 'baseline_claimed', product_key, '' FROM v_catalogue WHERE k_size = 34
UNION ALL SELECT 'membership_not_unique', product_key, '2' FROM v_catalogue WHERE k_size = 35""")
def _(spark, root):
    return ops.check_memberships(catalogue(spark, root), memberships(spark, root))


# The lifecycle states each state may move to.
TRANSITIONS = [
    (None, "ACTIVE"), (None, "SUCCESSOR_CANDIDATE"),
    ("ACTIVE", "AVAILABILITY_AT_RISK"), ("ACTIVE", "IDENTITY_INVALID"),
    ("AVAILABILITY_AT_RISK", "ACTIVE"), ("AVAILABILITY_AT_RISK", "DISCONTINUED"), ("AVAILABILITY_AT_RISK", "IDENTITY_INVALID"),
    ("SUCCESSOR_CANDIDATE", "ACTIVE"), ("SUCCESSOR_CANDIDATE", "IDENTITY_INVALID"),
]
STATE = """CASE {t} WHEN 'click' THEN 'ACTIVE' WHEN 'view' THEN 'AVAILABILITY_AT_RISK' WHEN 'error' THEN 'DISCONTINUED' WHEN 'purchase' THEN 'SUCCESSOR_CANDIDATE' ELSE 'IDENTITY_INVALID' END"""


def lifecycle(spark: SparkSession, root: str) -> DataFrame:
    """Events of a user as the lifecycle of a scenario, with some broken links."""
    from pyspark.sql import Window

    e = table(spark, root, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("scenario_key"), F.col("event_id").alias("event_no"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("event_id"),
        F.expr(STATE.format(t="event_type")).alias("to_state"),
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("effective_at"),
        F.expr(STATE.format(t="lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)")).alias("guess"),
        F.lag("event_id").over(w).alias("before"),
        F.col("value"),
    ).select(
        "scenario_key", "event_no", "event_id", "to_state", "effective_at",
        F.when(F.col("value") > 20, F.lit("ACTIVE")).when(F.col("before").isNotNull(), F.col("guess")).alias("from_state"),
        F.when(F.col("value") > 30, F.lit("ev-0")).when(F.col("before").isNotNull(), F.concat(F.lit("ev-"), F.col("before").cast("string"))).alias("supersedes_event_id"),
    )


@register("check_lifecycle", f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({'NULL' if a is None else repr(a)}, {b!r})" for a, b in TRANSITIONS)}) AS t(f, g)),
e AS (SELECT 'ev-' || event_id AS event_id, {STATE.format(t='event_type')} AS to_state, lag({STATE.format(t='event_type')}) OVER w AS prior, lag(event_id) OVER w AS before,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at, lag(strftime(ts, '%Y-%m-%d %H:%M:%S')) OVER w AS prior_at, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT 'from_state_differs_from_prior' AS rule, event_id AS key, '' AS detail FROM e WHERE CASE WHEN value > 20 THEN 'ACTIVE' ELSE prior END IS DISTINCT FROM prior
UNION ALL SELECT 'transition_not_allowed', event_id, '' FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE f IS NOT DISTINCT FROM prior AND g = to_state)
UNION ALL SELECT 'effective_at_not_increasing', event_id, '' FROM e WHERE seen_at <= prior_at
UNION ALL SELECT 'supersedes_differs_from_prior', event_id, '' FROM e WHERE CASE WHEN value > 30 THEN 'ev-0' ELSE 'ev-' || before END IS DISTINCT FROM 'ev-' || before""")
def _(spark, root):
    return ops.check_lifecycle(lifecycle(spark, root), literal_table(spark, "from_state string, to_state string", TRANSITIONS))


@register("identifier_conflicts", f"""
SELECT identifier_type, CASE WHEN identifier_type = 'GTIN' THEN '(global)' ELSE manufacturer_key END AS scope, normalized_value,
  count(DISTINCT product_key) AS product_count, min(product_key) AS first_product_key FROM {IDENT} GROUP BY ALL HAVING count(DISTINCT product_key) > 1""")
def _(spark, root):
    return ops.identifier_conflicts(identifiers(spark, root))


@register("identifier_manufacturer_mismatch", f"""
SELECT identifier_type, normalized_value, i.product_key, i.manufacturer_key, c.manufacturer_key AS revision_manufacturer
FROM {IDENT} i JOIN v_catalogue c ON c.product_key = i.product_key WHERE i.manufacturer_key <> c.manufacturer_key""")
def _(spark, root):
    return ops.identifier_manufacturer_mismatch(identifiers(spark, root), catalogue(spark, root))
