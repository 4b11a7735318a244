"""Ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.periods import instant_text
from pricetrail.functions.reasons import stacked
from pricetrail.operators import ingest
from pricetrail.plans.audit import tranche_rows
from pricetrail.plans.registry import register
from pricetrail.plans.views import VIEWS
from pricetrail.sources.adapter import catalogue, evidence_ledger, observations, offer_observations, retailer_key
from pricetrail.sources.release import release_difference, release_manifest
from pricetrail.sources.tables import table

TS = "'%Y-%m-%dT%H:%M:%SZ'"

VIEWS.update({
    "v_raw": """
SELECT *, CASE WHEN k_line = 7 AND k_qty = 2 THEN strftime(observed_at, '%Y-%m-%d') ELSE strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') END AS at_text,
  CASE WHEN k_line = 2 THEN ' ' || lower(mpn) ELSE mpn END AS raw_mpn, CASE WHEN k_qty = 50 AND k_line = 2 THEN 0 ELSE amount_minor END AS raw_amount FROM v_obs
""",
    "v_reading": """
SELECT observation_id AS reading_id, seller_fine AS seller_display_name, 'https://www.' || lower(replace(seller_fine, '_', '-')) || '.example/p/' || lower(mpn) AS url,
  observed_at, strftime(observed_at, '%Y%m%d%H%M%S') AS timestamp,
  CASE WHEN k_line = 7 AND k_qty < 5 THEN NULL ELSE mpn END AS mpn,
  CASE WHEN k_line = 6 AND k_qty < 5 THEN NULL WHEN k_qty = 50 AND k_line = 1 THEN 9999999 ELSE amount_minor END AS amount_minor, vat_included,
  CASE WHEN k_qty >= 20 THEN 32 END AS capacity_gb, CASE WHEN k_qty >= 20 THEN 2 END AS module_count,
  CASE WHEN k_qty = 13 THEN 'memory kit' ELSE 'DDR5 kit' END AS title,
  CASE WHEN k_qty = 14 THEN 'PRODUCT_DISCONTINUED' WHEN k_qty < 10 THEN 'CAPACITY_NOT_VISIBLE' END AS reason,
  CASE WHEN k_part % 41 = 0 THEN mpn || 'S' ELSE mpn END AS structured_mpn,
  CASE WHEN k_part % 43 = 0 THEN amount_minor + 100 ELSE amount_minor END AS structured_price_minor,
  CAST(floor(amount_minor / 1.2 + 0.5) AS BIGINT) + CASE WHEN k_part % 47 = 0 THEN 10 ELSE 0 END AS ex_vat_minor,
  CASE WHEN k_line = 5 THEN 'Sold out' WHEN k_line < 5 THEN 'In stock' END AS availability, k_part, mpn AS true_mpn
FROM v_obs
""",
    "v_shape": """
SELECT mpn, first(reading_id ORDER BY observed_at, reading_id) AS shape_reference FROM v_reading WHERE capacity_gb = 32 AND mpn IS NOT NULL GROUP BY mpn
""",
    "v_triaged": """
SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN mpn IS NULL THEN 'MPN_NOT_VISIBLE' WHEN coalesce(amount_minor, 0) = 0 THEN 'PRICE_NOT_VISIBLE'
  WHEN amount_minor >= 999900 THEN 'SENTINEL_PLACEHOLDER_PRICE' WHEN vat_included IS NULL THEN 'VAT_DISPLAY_MODE_NOT_VISIBLE' WHEN capacity_gb IS NULL THEN 'KIT_SHAPE_NOT_VISIBLE'
  WHEN title NOT LIKE '%DDR5%' THEN 'DDR5_NOT_CONFIRMED_IN_VISIBLE_TEXT' END AS rejection FROM v_reading
""",
    "v_target": """
SELECT DISTINCT url, seller_display_name, CASE WHEN k_part % 53 = 0 THEN true_mpn || 'M' ELSE true_mpn END AS mpn_expected FROM v_reading
""",
    "v_accepted": """
SELECT *, fr = '' AND mpn IS NOT NULL AND coalesce(amount_minor > 0, false) AND coalesce(vat_included, false) AND basis IS NOT NULL AS usable FROM (
  SELECT *, CASE WHEN capacity_gb = 32 THEN 'visible_on_page' WHEN waived THEN 'established_for_mpn_from_prior_evidence' END AS basis, CASE WHEN waived THEN '' ELSE ar END AS fr
  FROM (SELECT *, capacity_gb IS NULL AND shape_reference IS NOT NULL AND ar IN ('', 'CAPACITY_NOT_VISIBLE') AS waived FROM (
    SELECT r.*, t.mpn_expected, s.shape_reference, concat_ws(',', r.reason, CASE WHEN r.mpn <> t.mpn_expected THEN 'MPN_MISMATCH_URL_MAY_HAVE_MOVED' END) AS ar
    FROM v_reading r JOIN v_target t ON t.url = r.url AND t.seller_display_name = r.seller_display_name LEFT JOIN v_shape s ON s.mpn = r.mpn)))
""",
})


def raw_observations(spark: SparkSession, root: str) -> DataFrame:
    """Observations in their nested shapes, archive and live, with some defects."""
    o = observations(spark, root)
    k, ln, q = F.col("k_part"), F.col("k_line"), F.col("k_qty")
    archived = F.col("capture_kind") == "archive_capture"
    mpn = F.when(ln == 2, F.concat(F.lit(" "), F.lower("mpn"))).otherwise(F.col("mpn"))
    amount = F.when((q == 50) & (ln == 2), F.lit(0)).otherwise(F.col("amount_minor")).cast("long")
    vat = F.when(F.col("vat_included"), F.lit("included")).when(~F.col("vat_included"), F.lit("excluded")).otherwise(F.lit("unknown"))
    return o.select(
        "observation_id", "capture_kind", F.lit("lineitem").alias("source_file"),
        F.when((ln == 7) & (q == 2), F.date_format("observed_at", "yyyy-MM-dd")).otherwise(instant_text(F.col("observed_at"))).alias("observed_at"),
        F.struct(F.col("seller_fine").alias("display_name"), F.col("seller_legal_name").alias("legal_name")).alias("seller"),
        F.when(archived, F.struct(
            mpn.alias("mpn"), F.when(k % 41 == 0, 16).otherwise(32).alias("capacity_gb"), F.when(k % 43 == 0, 1).otherwise(2).alias("module_count"),
            F.when(k % 47 == 0, F.lit("DDR4")).otherwise(F.lit("DDR5")).alias("memory_type"),
        )).alias("product"),
        F.when(archived, F.struct(amount.alias("item_price_minor"), "currency", "vat_included")).alias("price"),
        F.when(archived, F.struct((k % 19 != 0).alias("identity_exact"))).alias("eligibility"),
        F.when(~archived, F.struct(mpn.alias("mpn_observed"))).alias("identity"),
        F.when(~archived, F.struct(amount.alias("amount_minor"), "currency", vat.alias("vat_state"))).alias("item_price"),
    )


@register("normalise_observations", """
SELECT observation_id, CASE WHEN length(at_text) = 20 THEN strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') END AS observed_at, mpn, seller_fine AS seller_display_name, seller_legal_name,
  raw_amount AS amount_minor, currency, vat_included, capture_kind, 'lineitem' AS source_file,
  concat_ws(',', CASE WHEN capture_kind = 'archive_capture' AND k_part % 41 = 0 THEN 'capacity_out_of_scope' END, CASE WHEN capture_kind = 'archive_capture' AND k_part % 43 = 0 THEN 'module_count_out_of_scope' END,
    CASE WHEN capture_kind = 'archive_capture' AND k_part % 47 = 0 THEN 'memory_type_out_of_scope' END, CASE WHEN capture_kind = 'archive_capture' AND k_part % 19 = 0 THEN 'identity_not_exact' END,
    CASE WHEN length(at_text) <> 20 THEN 'observed_at_not_instant' END, CASE WHEN raw_amount <= 0 THEN 'amount_not_positive' END) AS reasons FROM v_raw""")
def _(spark, root):
    return ingest.normalise_observations(raw_observations(spark, root)).withColumns(
        {"observed_at": instant_text(F.col("observed_at")), "reasons": F.array_join("reasons", ",")}
    )


@register("observation_facts", """
SELECT observation_id, raw_mpn AS mpn, raw_amount AS amount_minor, currency, CASE WHEN vat_included THEN 'included' WHEN NOT vat_included THEN 'excluded' ELSE 'unknown' END AS vat_state,
  seller_fine AS seller_display_name, at_text AS observed_at FROM v_raw""")
def _(spark, root):
    return ingest.observation_facts(raw_observations(spark, root))


def tranches(spark: SparkSession, root: str) -> DataFrame:
    """Monthly batches with header fields."""
    t = tranche_rows(spark, root).groupBy("tranche_id").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n"))
    return t.select(
        "tranche_id", F.concat(F.lit("candidate/"), "tranche_id", F.lit(".json")).alias("source_file"), instant_text(F.col("created_at")).alias("created_at"),
        F.when(F.col("n") % 10 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(F.col("n") % 4 == 0, F.lit("candidate_only_historical_backfill")).otherwise(F.lit("candidate_only")).alias("tranche_scope"),
        F.when(F.col("n") % 5 != 1, F.lit("PRIMARY_RETAIL")).alias("channel"), "n",
    )


TRANCHES = """(SELECT tranche_id, 'candidate/' || tranche_id || '.json' AS source_file, strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') AS created_at,
  CASE WHEN count(*) % 10 = 0 THEN 2 ELSE 1 END AS schema_version, CASE WHEN count(*) % 4 = 0 THEN 'candidate_only_historical_backfill' ELSE 'candidate_only' END AS tranche_scope,
  CASE WHEN count(*) % 5 <> 1 THEN 'PRIMARY_RETAIL' END AS channel, count(*) AS n FROM v_tranche_row GROUP BY tranche_id)"""


@register("discover_prospective", f"SELECT tranche_id, source_file, created_at FROM {TRANCHES} WHERE schema_version = 1 AND tranche_scope = 'candidate_only' AND channel = 'PRIMARY_RETAIL'")
def _(spark, root):
    return ingest.discover_prospective(tranches(spark, root)).select("tranche_id", "source_file", "created_at")


def files(spark: SparkSession, root: str) -> DataFrame:
    t = tranches(spark, root)
    return t.select(
        F.col("source_file").alias("path"), F.sha2(F.concat_ws("|", "tranche_id", F.col("n").cast("string")), 256).alias("sha256"),
        F.col("schema_version").alias("file_schema_version"), F.col("tranche_scope").alias("file_scope"), F.col("channel").alias("file_channel"),
        (F.col("n") % 3 == 0).alias("all_archived_primary_retail"), F.lit(True).alias("all_archived"), "n",
    )


def manifest(spark: SparkSession, root: str) -> DataFrame:
    f = files(spark, root)
    n = F.col("n")
    entries = f.where("n % 7 <> 3").select(
        F.when(n % 11 == 5, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"),
        F.when(n % 6 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.lit(1).alias("schema_version"),
        F.lit("PRIMARY_RETAIL").alias("channel"), F.lit("prospective_capture").alias("capture_kind"),
        F.when(n % 9 == 2, F.lit("maybe")).when(n % 2 == 0, F.lit("included_private_candidate")).otherwise(F.lit("excluded_private_candidate")).alias("decision"),
        F.when(n % 8 == 3, F.lit(" ")).otherwise(F.lit("kept")).alias("reason"), "n",
    )
    return stacked(entries, entries.where("n % 10 = 4")).drop("n")


MANIFEST_SQL = f"""f AS (SELECT source_file AS path, sha256(tranche_id || '|' || n) AS sha256, schema_version AS file_schema_version, tranche_scope AS file_scope, channel AS file_channel, n FROM {TRANCHES}),
e AS (SELECT CASE WHEN n % 11 = 5 THEN path || '.old' ELSE path END AS path, CASE WHEN n % 6 = 1 THEN sha256('x') ELSE sha256 END AS sha256, 1 AS schema_version, 'PRIMARY_RETAIL' AS channel,
  'prospective_capture' AS capture_kind, CASE WHEN n % 9 = 2 THEN 'maybe' WHEN n % 2 = 0 THEN 'included_private_candidate' ELSE 'excluded_private_candidate' END AS decision,
  CASE WHEN n % 8 = 3 THEN ' ' ELSE 'kept' END AS reason, n FROM f WHERE n % 7 <> 3),
m AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE n % 10 = 4)"""


@register("classify_inputs", f"""
WITH {MANIFEST_SQL}, g AS (SELECT path, count(*) AS entries, any_value(sha256) AS s, any_value(schema_version) AS v, any_value(capture_kind) AS ck, any_value(channel) AS ch, any_value(decision) AS d, any_value(reason) AS r FROM m GROUP BY path),
j AS (SELECT coalesce(f.path, g.path) AS path, f.*EXCLUDE(path), g.* EXCLUDE(path), f.sha256 IS NOT NULL AND entries IS NOT NULL AS both_there,
  f.sha256 IS NOT NULL AND entries IS NOT NULL AND d = 'included_private_candidate' AS inc FROM f FULL JOIN g ON f.path = g.path)
SELECT rule, path AS key, '' AS detail FROM (
  SELECT 'file_not_classified' AS rule, path FROM j WHERE entries IS NULL UNION ALL SELECT 'classified_file_missing', path FROM j WHERE sha256 IS NULL
  UNION ALL SELECT 'classified_more_than_once', path FROM j WHERE entries > 1 UNION ALL SELECT 'decision_unknown', path FROM j WHERE both_there AND d = 'maybe'
  UNION ALL SELECT 'reason_blank', path FROM j WHERE both_there AND trim(r) = '' UNION ALL SELECT 'hash_mismatch', path FROM j WHERE both_there AND sha256 <> s
  UNION ALL SELECT 'schema_version_mismatch', path FROM j WHERE inc AND v <> file_schema_version
  UNION ALL SELECT 'capture_kind_mismatch', path FROM j WHERE inc AND file_scope <> 'candidate_only'
  UNION ALL SELECT 'channel_mismatch', path FROM j WHERE inc AND coalesce(file_channel, CASE WHEN n % 3 = 0 THEN 'PRIMARY_RETAIL' WHEN file_scope <> 'candidate_only' THEN 'MIXED_ARCHIVE_STOREFRONT' ELSE '?' END) <> 'PRIMARY_RETAIL')""")
def _(spark, root):
    return ingest.classify_inputs(files(spark, root), manifest(spark, root))


@register("included_inputs", f"WITH {MANIFEST_SQL} SELECT path, capture_kind FROM m WHERE decision = 'included_private_candidate'")
def _(spark, root):
    return ingest.included_inputs(manifest(spark, root))


@register("append_classification", f"""
WITH {MANIFEST_SQL} SELECT path, decision, sha256 FROM m UNION ALL
SELECT path, 'excluded_private_candidate', sha256 FROM f WHERE path NOT IN (SELECT path FROM m) AND file_schema_version = 1 AND file_scope = 'candidate_only' AND file_channel = 'PRIMARY_RETAIL'""")
def _(spark, root):
    return ingest.append_classification(manifest(spark, root), files(spark, root)).select("path", "decision", "sha256")


@register("already_classified", f"WITH {MANIFEST_SQL} SELECT 'already_classified' AS rule, path AS key, '' AS detail FROM f WHERE path IN (SELECT path FROM m)")
def _(spark, root):
    return ingest.already_classified(manifest(spark, root), files(spark, root))


def legal_names(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "nation").where("n_nationkey % 5 <> 4").select(
        F.col("n_name").alias("seller_display_name"), F.concat("n_name", F.lit(" Ltd")).alias("legal_name")
    )


@register("reissue_schema", f"""
WITH l AS (SELECT evidence_id, any_value(source_url) AS u, any_value(http_status) AS h, any_value(response_sha256) AS s FROM v_ledger GROUP BY 1)
SELECT lower(replace(seller_display_name, '_', '-')) || '-' || lower(mpn) || '-' || lower(strftime(observed_at, {TS})) AS observation_id, 'http_' || h AS supplied_url_status, u AS source_url, s AS response_sha256,
  CASE WHEN stock_text = 'In stock' THEN 'in_stock' ELSE 'other' END AS availability,
  'delivery_not_read_by_collector' || CASE WHEN CAST(split_part(seller_display_name, '_', 2) AS INT) % 5 = 4 THEN ',seller_legal_name_unresolved' ELSE '' END AS reasons, l.evidence_id IS NULL AS missing_evidence
FROM v_offer o LEFT JOIN l ON l.evidence_id = o.evidence_id WHERE archived""")
def _(spark, root):
    archive = offer_observations(spark, root).where("archived")
    entries = evidence_ledger(spark, root)
    # Of a doubled entry the least decides.
    ledger = entries.groupBy("evidence_id").agg(F.min(F.struct(*[c for c in entries.columns if c != "evidence_id"])).alias("e")).select("evidence_id", "e.*")
    return ingest.reissue_schema(archive, ledger, legal_names(spark, root)).select(
        "observation_id", "source.supplied_url_status", "source.source_url", "evidence.response_sha256",
        F.col("availability.normalised").alias("availability"), F.array_join("qualification.reasons", ",").alias("reasons"), "missing_evidence",
    )


def readings(spark: SparkSession, root: str) -> DataFrame:
    """What a collector read from each page, with the ways a reading goes wrong."""
    o = observations(spark, root)
    k, ln, q = F.col("k_part"), F.col("k_line"), F.col("k_qty")
    amount = F.col("amount_minor")
    return o.select(
        F.col("observation_id").alias("reading_id"), F.col("seller_fine").alias("seller_display_name"),
        F.concat(F.lit("https://www."), retailer_key(F.col("seller_fine")), F.lit(".example/p/"), F.lower("mpn")).alias("url"),
        "observed_at", F.date_format("observed_at", "yyyyMMddHHmmss").alias("timestamp"),
        F.when((ln == 7) & (q < 5), F.lit(None)).otherwise(F.col("mpn")).alias("mpn"),
        F.when((ln == 6) & (q < 5), F.lit(None)).when((q == 50) & (ln == 1), F.lit(9999999)).otherwise(amount).cast("long").alias("amount_minor"),
        "vat_included",
        F.when(q >= 20, F.lit(32)).cast("long").alias("capacity_gb"), F.when(q >= 20, F.lit(2)).cast("long").alias("module_count"),
        F.when(q == 13, F.lit("memory kit")).otherwise(F.lit("DDR5 kit")).alias("title"),
        F.array_compact(F.array(F.when(q == 14, F.lit("PRODUCT_DISCONTINUED")).when(q < 10, F.lit("CAPACITY_NOT_VISIBLE")))).alias("reasons"),
        F.when(k % 41 == 0, F.concat("mpn", F.lit("S"))).otherwise(F.col("mpn")).alias("structured_mpn"),
        (amount + F.when(k % 43 == 0, 100).otherwise(0)).alias("structured_price_minor"),
        (F.floor(amount / 1.2 + 0.5).cast("long") + F.when(k % 47 == 0, 10).otherwise(0)).alias("ex_vat_minor"),
        F.when(ln == 5, F.lit("Sold out")).when(ln < 5, F.lit("In stock")).alias("availability"),
        "k_part", F.col("mpn").alias("true_mpn"),
    )


@register("cross_check_sources", """
SELECT reading_id, concat_ws(',', reason, CASE WHEN mpn <> structured_mpn THEN 'MPN_SOURCES_DISAGREE' END, CASE WHEN structured_price_minor <> amount_minor THEN 'PRICE_SOURCES_DISAGREE' END,
  CASE WHEN vat_included AND abs(CAST(floor(ex_vat_minor * CAST(1.2 AS DOUBLE) + 0.5) AS BIGINT) - amount_minor) > 3 THEN 'VAT_ARITHMETIC_INCONSISTENT' END) AS reasons FROM v_reading""")
def _(spark, root):
    return ingest.cross_check_sources(readings(spark, root)).select("reading_id", F.array_join("reasons", ",").alias("reasons"))


def targets(r: DataFrame) -> DataFrame:
    return r.select(
        "url", "seller_display_name", F.when(F.col("k_part") % 53 == 0, F.concat("true_mpn", F.lit("M"))).otherwise(F.col("true_mpn")).alias("mpn")
    ).distinct()


def accepted(spark: SparkSession, root: str) -> DataFrame:
    r = readings(spark, root)
    return ingest.accept_readings(r, targets(r), ingest.established_shapes(r))


@register("accept_readings", "SELECT reading_id, mpn_expected, fr AS reasons, basis AS capacity_basis, CASE WHEN waived THEN shape_reference END AS capacity_basis_reference, usable FROM v_accepted")
def _(spark, root):
    return accepted(spark, root).select(
        "reading_id", "mpn_expected", F.array_join("reasons", ",").alias("reasons"), "capacity_basis", "capacity_basis_reference", "usable"
    )


@register("to_prospective", f"""
SELECT lower(replace(seller_display_name, '_', '-')) || '-' || lower(mpn) || '-' || lower(strftime(observed_at, {TS})) AS observation_id, strftime(observed_at, {TS}) AS observed_at, lower(mpn) AS product_key,
  mpn_expected, amount_minor, CASE availability WHEN 'In stock' THEN 'in_stock' WHEN 'Sold out' THEN 'other' ELSE 'unknown' END AS availability, url AS source_url FROM v_accepted WHERE usable""")
def _(spark, root):
    return ingest.to_prospective(accepted(spark, root), legal_names(spark, root)).select(
        "observation_id", "observed_at", "product_key", "identity.mpn_expected", "item_price.amount_minor",
        F.col("availability.normalised").alias("availability"), "source.source_url",
    )


@register("thin_captures", "SELECT split_part(url, '?', 1) AS url, substring(timestamp, 1, 6) AS month, min(timestamp) AS timestamp FROM v_reading GROUP BY ALL")
def _(spark, root):
    captures = readings(spark, root).withColumn("url", F.when(F.col("k_part") % 2 == 0, F.concat("url", F.lit("?s=1"))).otherwise(F.col("url")))
    return ingest.thin_captures(captures)


@register("pending_captures", """
SELECT reading_id, seller_display_name, url, timestamp FROM v_reading WHERE (seller_display_name, url, timestamp) NOT IN (SELECT (seller_display_name, url, timestamp) FROM v_reading WHERE title = 'memory kit' OR reason IS NOT NULL)""")
def _(spark, root):
    r = readings(spark, root)
    done = r.where((F.col("title") == "memory kit") | (F.size("reasons") > 0))
    return ingest.pending_captures(r, done).select("reading_id", "seller_display_name", "url", "timestamp")


@register("triage_readings", "SELECT reading_id, rejection FROM v_triaged")
def _(spark, root):
    return ingest.triage_readings(readings(spark, root)).select("reading_id", "rejection")


@register("propagate_kit_shape", """
SELECT reading_id, CASE WHEN capacity_gb = 32 THEN 'visible_on_page' WHEN shape_reference IS NOT NULL THEN 'established_from_sibling_capture' END AS capacity_basis,
  CASE WHEN capacity_gb IS NULL THEN shape_reference END AS capacity_basis_reference, CASE WHEN capacity_gb = 32 OR shape_reference IS NOT NULL THEN 32 END AS capacity_gb
FROM v_reading r LEFT JOIN v_shape s ON s.mpn = r.mpn""")
def _(spark, root):
    return ingest.propagate_kit_shape(readings(spark, root)).select("reading_id", "capacity_basis", "capacity_basis_reference", "capacity_gb")


RETAINED = """SELECT t.reading_id, seller_display_name, coalesce(rejection, CASE WHEN (seller_display_name, mpn, observed_at) IN (SELECT (seller_fine, mpn, observed_at) FROM v_obs WHERE capture_kind = 'archive_capture')
  THEN 'ALREADY_RETAINED_BY_EARLIER_WAVE' END) AS rejection FROM v_triaged t"""


def triaged(spark: SparkSession, root: str) -> DataFrame:
    old = observations(spark, root).where("capture_kind = 'archive_capture'").select(F.col("seller_fine").alias("seller_display_name"), "mpn", "observed_at")
    return ingest.drop_already_retained(ingest.triage_readings(readings(spark, root)), old)


@register("drop_already_retained", RETAINED)
def _(spark, root):
    return triaged(spark, root).select("reading_id", "seller_display_name", "rejection")


@register("triage_summary", f"SELECT coalesce(rejection, 'KEPT') AS code, seller_display_name, count(*) AS n FROM ({RETAINED}) GROUP BY ALL")
def _(spark, root):
    return ingest.triage_summary(triaged(spark, root))


REGISTRY = """SELECT x.mpn, seller_display_name, b.url AS url, strftime(b.at, '%Y-%m-%dT%H:%M:%SZ') AS last_observed_at, CASE WHEN b.act THEN 'active_collection' ELSE 'archived_capture' END AS provenance,
  c.mpn IS NOT NULL AS in_reviewed_catalogue, h AS retailers_holding_this_mpn, b.at >= TIMESTAMP '2001-06-01' AS recently_seen,
  CASE WHEN b.act THEN 1 WHEN c.mpn IS NOT NULL AND b.at >= TIMESTAMP '2001-06-01' THEN 2 WHEN b.at >= TIMESTAMP '2001-06-01' AND h >= 2 THEN 3 WHEN b.at >= TIMESTAMP '2001-06-01' THEN 4 WHEN h >= 2 THEN 5 ELSE 6 END AS collection_priority
FROM (SELECT *, count(*) OVER (PARTITION BY mpn) AS h FROM (SELECT mpn, seller_fine AS seller_display_name, max(struct_pack(act, at := observed_at, url)) AS b
  FROM (SELECT *, k_part % 10 = 0 AND capture_kind = 'prospective_capture' AS act, 'https://www.' || lower(replace(seller_fine, '_', '-')) || '.example/p/' || lower(mpn) AS url FROM v_obs) GROUP BY 1, 2)) x
LEFT JOIN (SELECT mpn_normalized AS mpn FROM v_catalogue WHERE review_status = 'reviewed_fixture') c ON c.mpn = x.mpn"""


def registry(spark: SparkSession, root: str) -> DataFrame:
    o = observations(spark, root).select(
        "mpn", F.col("seller_fine").alias("seller_display_name"), F.col("observed_at").alias("last_observed_at"), "capture_kind", "k_part",
        F.concat(F.lit("https://www."), retailer_key(F.col("seller_fine")), F.lit(".example/p/"), F.lower("mpn")).alias("url"),
    )
    live = (F.col("k_part") % 10 == 0) & (F.col("capture_kind") == "prospective_capture")
    reviewed = catalogue(spark, root).where("review_status = 'reviewed_fixture'").select(F.col("mpn_normalized").alias("mpn"))
    return ingest.build_target_registry(o.where(live), o.where(~live), reviewed, "2001-06-01 00:00:00")


@register("build_target_registry", REGISTRY)
def _(spark, root):
    return registry(spark, root).withColumn("last_observed_at", instant_text(F.col("last_observed_at")))


@register("select_targets", f"SELECT mpn, seller_display_name, collection_priority FROM ({REGISTRY}) WHERE collection_priority <= 4 ORDER BY collection_priority, mpn, seller_display_name LIMIT 45")
def _(spark, root):
    return ingest.select_targets(registry(spark, root), 4, 45).select("mpn", "seller_display_name", "collection_priority")


RULES = [("*", False, "/en/"), ("*", True, "/en/7"), ("*", False, "/fr/"), ("*", True, ""), ("otherbot", False, "/")]
BLOG_RULES = [("pricetrail", False, "/es/"), ("pricetrail", True, "/es/5"), ("pricetrail", False, "/es/5")]


def page_paths(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "pages")
    url = F.regexp_replace("url", r"[?#].*$", "")
    return p.select(F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/]+(/.*)?$", 1).alias("path"))


@register("resolve_crawl_rules", f"""
WITH p AS (SELECT DISTINCT regexp_extract(u, '^https?://([^/]+)', 1) AS host, regexp_extract(u, '^https?://[^/]+(/.*)?$', 1) AS path FROM (SELECT regexp_replace(url, '[?#].*$', '') AS u FROM pages)),
r AS (SELECT host, g, allow, rp FROM (SELECT DISTINCT host FROM p), (VALUES {", ".join(f"('{g}', {str(a).lower()}, '{x}')" for g, a, x in RULES)}) AS v(g, allow, rp)
  UNION ALL SELECT host, g, allow, rp FROM (SELECT DISTINCT host FROM p WHERE host LIKE 'blog.%'), (VALUES {", ".join(f"('{g}', {str(a).lower()}, '{x}')" for g, a, x in BLOG_RULES)}) AS v(g, allow, rp)),
s AS (SELECT * FROM r WHERE g = CASE WHEN host LIKE 'blog.%' THEN 'pricetrail' ELSE '*' END AND rp <> '')
SELECT p.host, p.path, coalesce((SELECT allow FROM s WHERE s.host = p.host AND starts_with(p.path, rp) ORDER BY length(rp) DESC, allow DESC LIMIT 1), true) AS allowed FROM p""")
def _(spark, root):
    p = page_paths(spark, root)

    def written(rules: list[tuple]) -> F.Column:
        return F.array(*[F.struct(F.lit(g).alias("agent_group"), F.lit(a).alias("allow"), F.lit(x).alias("path")) for g, a, x in rules])

    held = F.when(F.col("host").startswith("blog."), written(RULES + BLOG_RULES)).otherwise(written(RULES))
    rules = p.select("host").distinct().select("host", F.explode(held).alias("r")).select("host", "r.*")
    return ingest.resolve_crawl_rules(p, rules, "pricetrail-collector")


@register("page_titles", """
SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&pound;', '£'), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS title FROM pages""")
def _(spark, root):
    return ingest.page_titles(table(spark, root, "pages"))


def site(name: str, heading: str, number: str) -> ingest.SiteRules:
    return ingest.SiteRules(
        site=name, title=heading, mpn=number, price='id="price-box"', tax_included=r"(?i)inc\.?\s*VAT", tax_excluded=r"(?i)ex\.?\s*VAT",
        in_stock="schema.org/InStock", out_of_stock="schema.org/OutOfStock", structured_mpn=r'"mpn"\s*:\s*"([^"]{5,60})"',
        structured_price=r'"price"\s*:\s*([0-9.]+)', discontinued=r"(?i)Discontinued\s*-\s*Contact Us",
    )


SITES = [
    site("AFRICA", r"(?s)<h1[^>]*>(.*?)</h1>", r'id="number"[^>]*>\s*([A-Z0-9][A-Z0-9._/-]{4,})\s*<'),
    site("AMERICA", r"(?s)<h1[^>]*>(.*?)</h1>", r'id="number"[^>]*>\s*([A-Z0-9][A-Z0-9._/-]{4,})\s*<'),
    site("ASIA", r'(?s)<div class="name">(.*?)</div>', r'<dd class="part">([^<]+)</dd>'),
    site("EUROPE", r'(?s)<div class="name">(.*?)</div>', r'<dd class="part">([^<]+)</dd>'),
]


def product_pages(spark: SparkSession, root: str) -> DataFrame:
    """Observations written out as product pages of two layouts.

    The narrow rows are spread first: a table of one file would otherwise be
    parsed by one task.
    """
    o = observations(spark, root).repartition("observation_id")
    k, ln, q, a = F.col("k_part"), F.col("k_line"), F.col("k_qty"), F.col("amount_minor")
    kit = F.when(q >= 20, F.lit("32GB (2x16GB)")).when(q >= 10, F.lit("32 GB Kit (16GB x 2)")).otherwise(F.lit("32GB"))
    name = F.concat(F.when(q == 13, F.lit("Fast ")).otherwise(F.lit("DDR5 ")), kit, F.lit(" <b>Red &amp; Blue</b>\n kit"))
    number = F.when((ln == 7) & (q < 30), F.lit("")).otherwise(F.col("mpn"))
    price = F.concat(F.lit("&pound;<i>"), F.format_number(F.floor(a / 100), 0), F.lit("</i> ."), F.lpad((a % 100).cast("string"), 2, "0"))
    shown = F.when((ln == 6) & (q < 5), F.lit("call")).otherwise(price)
    label = F.when(F.col("vat_included"), F.lit("inc. VAT")).when(~F.col("vat_included"), F.lit("ex VAT")).otherwise(F.lit(""))
    stock = F.when(ln == 5, F.lit("OutOfStock")).otherwise(F.lit("InStock"))
    late = F.col("seller").isin("ASIA", "EUROPE")
    head = F.when(late, F.concat(F.lit('<div class="name">'), name, F.lit('</div><dl><dt>Part</dt><dd class="part">'), number, F.lit("</dd></dl>"))).otherwise(
        F.concat(F.lit('<h1 class="t">'), name, F.lit('</h1><span id="number">'), number, F.lit("</span>"))
    )
    structured = F.when(k % 41 == 0, F.lit("")).otherwise(F.concat(F.lit('{"mpn": "'), F.lower("mpn"), F.lit('", "price": '), F.format_string("%d.%02d", F.floor(a / 100), a % 100), F.lit("}")))
    html = F.concat(
        F.lit("<html><body><p>Delivery £4.99 inc. VAT</p>"), head, F.lit('<div id="price-box" class="p">'), shown, F.lit(" <span>"), label, F.lit("</span></div>"),
        F.lit('<link href="https://schema.org/'), stock, F.lit('"/><script>'), structured, F.lit("</script>"),
        F.when(q == 14, F.lit("<p>Discontinued - Contact Us</p>")).otherwise(F.lit("")), F.lit("<div>Also bought £19.99 ex VAT</div></body></html>"),
    )
    return o.select(F.col("observation_id").alias("page_id"), F.col("seller").alias("site"), F.lit("https://x.example/").alias("url"), html.alias("html"))


@register("extract_page_facts", """
WITH o AS (SELECT *, seller <> 'MIDDLE EAST' AS known, NOT (k_line = 7 AND k_qty < 30) AS has_number, k_part % 41 <> 0 AS has_structured, NOT (k_line = 6 AND k_qty < 5) AS has_price FROM v_obs)
SELECT observation_id AS page_id, CASE WHEN known THEN CASE WHEN k_qty = 13 THEN 'Fast ' ELSE 'DDR5 ' END || CASE WHEN k_qty >= 20 THEN '32GB (2x16GB)' WHEN k_qty >= 10 THEN '32 GB Kit (16GB x 2)' ELSE '32GB' END || ' Red & Blue kit' END AS title,
  CASE WHEN known AND (has_number OR has_structured) THEN upper(mpn) END AS mpn, CASE WHEN known AND has_price THEN amount_minor END AS amount_minor,
  CASE WHEN known AND has_structured THEN amount_minor END AS structured_price_minor, CASE WHEN known THEN vat_included END AS vat_included,
  CASE WHEN known AND k_qty >= 10 THEN 32 END AS capacity_gb, CASE WHEN known THEN CASE WHEN k_line = 5 THEN 'Out of stock' ELSE 'In stock' END END AS availability,
  CASE WHEN NOT known THEN 'NO_EXTRACTOR_FOR_SELLER' ELSE concat_ws(',', CASE WHEN k_qty < 10 THEN 'CAPACITY_NOT_VISIBLE' END, CASE WHEN k_qty = 13 THEN 'DDR5_NOT_CONFIRMED' END,
    CASE WHEN NOT has_number AND NOT has_structured THEN 'MPN_NOT_VISIBLE' END, CASE WHEN NOT has_number AND has_structured THEN 'MPN_NOT_VISIBLE_ONLY_STRUCTURED' END,
    CASE WHEN NOT has_price THEN 'PRICE_NOT_VISIBLE' END, CASE WHEN vat_included IS NULL THEN 'VAT_DISPLAY_MODE_NOT_VISIBLE' END, CASE WHEN k_qty = 14 THEN 'PRODUCT_DISCONTINUED' END) END AS reasons FROM o""")
def _(spark, root):
    facts = ingest.extract_page_facts(product_pages(spark, root), SITES)
    return facts.select(
        "page_id", "title", "mpn", "amount_minor", "structured_price_minor", "vat_included", "capacity_gb", "availability", F.array_join("reasons", ",").alias("reasons")
    )


PAGE_RULES = [
    ingest.SiteRules(
        site="web", title=r"(?s)<h1[^>]*>(.*?)</h1>", mpn=r'data-part="([^"]+)"', price='class="ad"', tax_included=r"(?i)inc\.?\s*VAT", tax_excluded=r"(?i)ex\.?\s*VAT",
        in_stock="schema.org/InStock", out_of_stock="schema.org/OutOfStock",
    ),
]


@register("extract_web_pages", """
SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&pound;', '£'), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS title,
  CASE WHEN page_id % 4 = 0 THEN 100 * page_id + 99 END AS amount_minor, CASE WHEN page_id % 8 = 0 THEN true WHEN page_id % 4 = 0 THEN false END AS vat_included,
  concat_ws(',', 'CAPACITY_NOT_VISIBLE', CASE WHEN NOT regexp_matches(html, '(?i)<h1[^>]*>[^<]*DDR5') THEN 'DDR5_NOT_CONFIRMED' END, 'MPN_NOT_VISIBLE',
    CASE WHEN page_id % 4 <> 0 THEN 'PRICE_NOT_VISIBLE' END, CASE WHEN page_id % 4 <> 0 THEN 'VAT_DISPLAY_MODE_NOT_VISIBLE' END) AS reasons FROM pages""")
def _(spark, root):
    # Prices set into the marked box of some pages, behind it or into a box that never ends in others.
    i = F.col("page_id")
    figure = F.concat(F.lit("<div><b>£"), i.cast("string"), F.lit(".99</b></div> "), F.when(i % 8 == 0, F.lit("inc VAT")).otherwise(F.lit("ex VAT")))
    box = '<div class="ad">'
    html = (
        F.when(i % 4 == 0, F.replace("html", F.lit(box), F.concat(F.lit(f"{box}<div>from</div>"), figure)))
        .when(i % 4 == 1, F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), figure)))
        .when(i % 4 == 2, F.concat(F.split_part("html", F.lit(box), F.lit(1)), F.lit(box), figure, F.lit("<div>"), F.regexp_extract("html", "(?s)<h1.*?</h1>", 0)))
        .otherwise(F.col("html"))
    )
    pages = table(spark, root, "pages").select("page_id", F.lit("web").alias("site"), "url", html.alias("html"))
    facts = ingest.extract_page_facts(pages, PAGE_RULES)
    return facts.select("page_id", "title", "amount_minor", "vat_included", F.array_join("reasons", ",").alias("reasons"))


@register("release_difference", """
SELECT mpn, n, CASE WHEN n % 3 = 0 THEN 'only_derived' END AS side, 1 AS surplus FROM (SELECT mpn, count(*) AS n FROM v_lines GROUP BY 1) WHERE n % 3 = 0
UNION ALL SELECT mpn, n + 1, 'only_recorded', 1 FROM (SELECT mpn, count(*) AS n FROM v_lines GROUP BY 1) WHERE n % 3 = 0""")
def _(spark, root):
    derived = observations(spark, root).groupBy("mpn").agg(F.count(F.lit(1)).alias("n"))
    recorded = derived.withColumn("n", F.col("n") + F.when(F.col("n") % 3 == 0, 1).otherwise(0))
    return release_difference(recorded, derived)


LANES = ", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 16 * i}, 16) AS UBIGINT)) AS VARCHAR)" for i in range(4))


@register("release_manifest", f"""
WITH t AS (SELECT 'suppliers' AS dataset, '{{"s_name":"' || s_name || '","s_suppkey":' || s_suppkey || '}}' AS j FROM supplier
  UNION ALL SELECT 'votes', '{{"month":"' || strftime(month, '%Y-%m') || '","mpn":"' || mpn || '","price_minor":' || coalesce(CAST(median_minor AS VARCHAR), 'null') || '}}' FROM v_points)
SELECT dataset, count(*) AS row_count, CAST(sum(octet_length(encode(j))) AS BIGINT) AS byte_count, sha256(concat_ws(':', {LANES})) AS sha256 FROM (SELECT *, sha256(j) AS h FROM t) GROUP BY dataset""")
def _(spark, root):
    from pricetrail.functions.periods import month_label
    from pricetrail.operators.series import per_product_month_series

    points = per_product_month_series(observations(spark, root)).select("mpn", month_label(F.col("month")).alias("month"), F.col("median_minor").alias("price_minor"))
    return release_manifest({"suppliers": table(spark, root, "supplier").select("s_suppkey", "s_name"), "votes": points})
