"""Declared schemas of the nested inputs. Nothing here is inferred.

An observation comes in two shapes that share one read schema: the struct
family a row does not use is null.
"""

from __future__ import annotations

GOVERNANCE = """STRUCT<production_import_allowed: BOOLEAN, production_activation_allowed: BOOLEAN,
  index_eligibility: BOOLEAN, methodology_approval: BOOLEAN, publication_allowed: BOOLEAN>"""

OBSERVATION = f"""STRUCT<
  observation_id: STRING, status: STRING, scope: STRING, observed_at: STRING, product_key: STRING,
  source: STRUCT<source_key: STRING, source_name: STRING, display_name: STRING, source_class: STRING, evidence_id: STRING,
    source_url: STRING, archive_url: STRING, supplied_url_status: STRING, collection_method: STRING,
    source_approved_for_production: BOOLEAN>,
  identity: STRUCT<mpn_expected: STRING, mpn_observed: STRING, match_basis: STRING>,
  product: STRUCT<manufacturer: STRING, mpn: STRING, capacity_gb: INT, module_count: INT, memory_type: STRING, speed_mt_s: INT,
    capacity_basis: STRING, capacity_basis_reference: STRING>,
  seller: STRUCT<display_name: STRING, legal_name: STRING, legal_name_state: STRING, relationship: STRING>,
  item_price: STRUCT<amount_minor: BIGINT, currency: STRING, vat_state: STRING>,
  price: STRUCT<item_price_minor: BIGINT, currency: STRING, vat_included: BOOLEAN, delivery_minor: BIGINT, landed_price_minor: BIGINT>,
  availability: STRUCT<normalised: STRING, state: STRING, raw_text: STRING, schema: STRING, display: STRING, eligibility_semantics: STRING>,
  delivery: STRUCT<amount_minor: BIGINT, currency: STRING, claim: STRING, destination_basis: STRING, destination_verified: BOOLEAN>,
  landed_price: STRUCT<amount_minor: BIGINT, currency: STRING, eligibility: STRING>,
  eligibility: STRUCT<identity_exact: BOOLEAN, capacity_basis: STRING, capacity_basis_reference: STRING,
    historical_item_price_retained: BOOLEAN, landed_price_eligible: BOOLEAN, reason_codes: ARRAY<STRING>>,
  qualification: STRUCT<status: STRING, reasons: ARRAY<STRING>>,
  evidence: STRUCT<extract_path: STRING, extract_sha256: STRING, response_sha256: STRING, response_bytes: BIGINT,
    response_bytes_retained: BOOLEAN, source_url: STRING>,
  governance: {GOVERNANCE}>"""

TRANCHE = f"""schema_version INT, tranche_id STRING, status STRING, scope STRING, region STRING, channel STRING,
  created_at STRING, evidence_ledger STRING, governance {GOVERNANCE}, observations ARRAY<{OBSERVATION}>"""

LEDGER = """entries ARRAY<STRUCT<evidence_id: STRING, seller_display_name: STRING, source_url: STRING, final_url: STRING,
  archive_url: STRING, original_url: STRING, retrieved_at: STRING, archive_captured_at: STRING, http_status: INT,
  response_bytes: BIGINT, response_sha256: STRING, vat_determination: STRING, identity_determination: STRING,
  capacity_determination: STRING, minimal_quote: STRING,
  facts: STRUCT<mpn: STRING, capacity_gb: INT, module_count: INT, item_price_minor: BIGINT, currency: STRING, vat_included: BOOLEAN>>>"""

MANIFEST = """entries ARRAY<STRUCT<path: STRING, sha256: STRING, schema_version: INT, channel: STRING,
  capture_kind: STRING, decision: STRING, reason: STRING>>"""

RUN_LEDGER = """runs ARRAY<STRUCT<run_id: STRING, collector_version: INT, started_at: STRING, completed_at: STRING, outcome: STRING,
    targets_attempted: BIGINT, observations_retained: BIGINT, abstentions: BIGINT, abstention_reasons: MAP<STRING, BIGINT>,
    tranche_file: STRING, evidence_ledger: STRING>>,
  missed_slots ARRAY<STRUCT<scheduled_for: STRING, state: STRING, detected_at: STRING, detected_by_run: STRING,
    operator_acknowledged: BOOLEAN, note: STRING>>,
  acknowledgements ARRAY<STRUCT<scheduled_for: STRING, acknowledged_by: STRING, acknowledged_at: STRING, note: STRING, effect: STRING>>"""
