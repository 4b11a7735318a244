from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pricetrail.functions.reasons import require_empty
from pricetrail.operators import audit, catalogue, realseries
from pricetrail.sources.tables import literal_table
from tests.helpers import obs, rows


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_mpn_equals_brute_force(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("AB1") for _ in range(rng.randint(1, 7))) for _ in range(90)})
    listed, held = words[::2], words[1::2]
    listings = spark.createDataFrame([("m", w) for w in listed], "manufacturer_key string, mpn_key string")
    products = spark.createDataFrame([("m", w, f"p-{w}") for w in held], "manufacturer_key string, mpn_normalized string, product_key string")
    got = set(rows(catalogue.near_mpn(listings, products), "mpn_key", "near_mpn", "distance"))
    want = {(a, b, distance(a, b)) for a, b in itertools.product(listed, held) if 1 <= distance(a, b) <= 2}
    assert got == want


def test_listing_decisions(spark):
    products = literal_table(
        spark, "manufacturer_key string, mpn_normalized string, product_key string, memory_generation string, form_factor string",
        [("acme", "AX-100", "p1", "DDR5", "UDIMM"), ("acme", "AX-200", "p2", "DDR5", "UDIMM"), ("zen", "ZZ-9", "p3", "DDR5", "UDIMM")],
    )
    aliases = literal_table(spark, "manufacturer_key string, alias string", [("acme", "A.C.M.E"), ("zen", "Zen")])
    listings = literal_table(
        spark, "listing_id string, title string, manufacturer_raw string, mpn_raw string, gtin_raw string, memory_generation string, form_factor string",
        [
            ("exact", "kit", "acme", "AX-100", None, None, None), ("normal", "kit", "ACME", " ax-100", None, None, None),
            ("conflict", "kit", "acme", "AX-100", None, "DDR4", None), ("near", "kit", "acme", "AX-101", None, None, None),
            ("unknown", "kit", "acme", "QQQQQQ", None, None, None), ("moved", "kit", "zen", "AX-100", None, None, None),
            ("ddr4", "kit", "acme", "QQQQQQ", None, "DDR4", None), ("sodimm", "kit", "acme", None, None, None, "SODIMM"),
            ("gtin", "kit", "acme", None, "123", None, None), ("choose", "Choose one or two", "acme", None, None, None, None),
            ("many", "kit", "acme", None, None, None, None), ("nothing", "kit", "zen", None, None, None, None),
        ],
    )
    got = {r["listing_id"]: (r["decision"], r["reason_code"]) for r in catalogue.match_listings(listings, products, aliases).collect()}
    assert got == {
        "exact": ("match", "exact_mpn"), "normal": ("match", "normalized_mpn"), "conflict": ("abstain_ambiguous", "specification_conflict"),
        "near": ("abstain_insufficient", "near_mpn_only"), "unknown": ("no_match", "no_catalogue_product"), "moved": ("abstain_ambiguous", "manufacturer_mismatch"),
        "ddr4": ("unsupported", "unsupported_memory_type"), "sodimm": ("unsupported", "unsupported_form_factor"), "gtin": ("abstain_insufficient", "malformed_identifier"),
        "choose": ("abstain_ambiguous", "multi_product_listing"), "many": ("abstain_ambiguous", "multiple_candidates"), "nothing": ("abstain_insufficient", "missing_identifier"),
    }


def test_coverage_layers(spark):
    counts = {"corsair": 1, "crucial": 4, "gskill": 2}
    data = [(f"{m}-{i}", m, 5600 if i % 2 else 6000) for m, n in counts.items() for i in range(n)]
    products = spark.createDataFrame(data, "product_key string, manufacturer_key string, speed_mt_s long")
    family = products.select("product_key", F.concat("manufacturer_key", F.lit("-f")).alias("family_key"))
    member = products.select("product_key", F.lit("reviewed_fixture").alias("status"))
    got = {(r["layer"], r["key"]): r["n"] for r in catalogue.coverage_report(products, family, member).collect()}
    assert {k: got[("manufacturer", k)] for k in counts} == counts
    assert (got[("speed", "5600")], got[("speed", "6000")], got[("monitored_universe", "all")]) == (3, 4, 7)
    targets = literal_table(spark, "manufacturer_key string", [("corsair",), ("lexar",)])
    assert rows(catalogue.missing_targets(products, targets)) == [("lexar",)]


def test_partition_check(spark):
    def keys(*ks):
        return literal_table(spark, "k string", [(k,) for k in ks])

    assert rows(catalogue.check_partition(keys("a", "b"), keys("a"), keys("b"), "k")) == []
    assert rows(catalogue.check_partition(keys("a", "b", "c"), keys("a", "b"), keys("b", "x"), "k"), "rule", "key") == [
        ("in_both_parts", "b"), ("in_neither_part", "c"), ("not_in_whole", "x")
    ]
    with pytest.raises(ValueError, match="partition"):
        require_empty(catalogue.check_partition(keys("a"), keys("b"), keys("b"), "k"), "partition")


def test_revision_chain(spark):
    log = literal_table(
        spark, "id string, revision bigint, revision_hash string, supersedes_revision_hash string",
        [("a", 1, "h1", None), ("a", 2, "h2", "h1"), ("b", 1, "h3", "h9"), ("c", 2, "h4", "h0"), ("d", 1, "h5", None), ("d", 2, "h6", "hx"), ("e", 1, "h6", None)],
    )
    assert rows(audit.check_revision_chain(log, "id"), "rule", "key") == [
        ("first_revision_has_parent", "b@1"), ("parent_hash_differs", "d@2"), ("revision_gap", "c@2"), ("revision_hash_not_unique", "h6")
    ]
    assert rows(audit.current_revisions(log, "id"), "id", "revision") == [("a", 2), ("b", 1), ("c", 2), ("d", 2), ("e", 1)]
    doubled = literal_table(spark, "id string, revision bigint, revision_hash string", [("a", 1, "h2"), ("a", 1, "h1"), ("a", 2, "h3")])
    assert rows(audit.with_prior_revision(doubled, "id", ["revision_hash"]).where("has_prior"), "id", "prior_revision_hash") == [("a", "h1")]


def test_missed_slots(spark):
    runs = spark.sql("SELECT 'r' AS run_id, TIMESTAMP'2026-08-10 09:00:00' AS started_at")
    got = audit.missed_slots(runs, "2026-08-13 12:00:00", 11, 30)
    # The day of the last run counts when it ran before the slot; today never does.
    assert rows(got, "scheduled_for") == [("2026-08-10T11:30:00",), ("2026-08-11T11:30:00",), ("2026-08-12T11:30:00",)]
    assert rows(audit.missed_slots(runs.where("false"), "2026-08-13 12:00:00", 11, 30)) == []


def test_collisions(spark):
    o = obs(spark, [("A", "x", "2026-08-10 09:00", 1, True), ("A", "x", "2026-08-10 23:00", 2, True), ("A", "x", "2026-08-11 09:00", 2, True), ("B", "x", "2026-08-10 09:00", 1, True)])
    t = o.withColumnRenamed("seller", "seller_display_name").withColumns({"seller_legal_name": F.lit(None).cast("string"), "tranche_id": F.lit("t1")})
    c = audit.collision_audit(t)
    assert rows(c, "mpn", "observation_count", "seller_identity_basis") == [("A", 2, "display_name_legal_entity_unresolved")]
    assert rows(audit.collision_members(t), "observation_id") == [("o-000",), ("o-001",)]
    assert rows(audit.collision_verdict(c), "date_level_diagnostic_integration_allowed") == [(False,)]


def test_coupled_columns(spark):
    df = spark.createDataFrame([], "a string, b struct<price: long, c: array<struct<weight: int>>>, m map<string, struct<gap_fill: int>>")
    assert audit.coupled_columns(df) == ["b.price", "b.c[].weight", "m{}.gap_fill"]


def test_fixed_base_is_exact(spark):
    q = obs(spark, [
        ("A", "s", "2026-08-09", 10000, True), ("B", "s", "2026-08-09", 20000, True), ("A", "s", "2026-08-10", 11000, True), ("B", "s", "2026-08-10", 18000, True),
        ("A", "s", "2026-08-11", 11000, True), ("C", "s", "2026-08-11", 5, True),
    ]).withColumns({"status": F.lit("eligible"), "reasons": F.array().cast("array<string>")})
    daily = realseries.dated_lines(q)
    got = rows(realseries.fixed_base_relative(daily, "2026-08-09").select(F.col("date").cast("string"), "eligible_line_count", "level_num", "level_den", "level_micros"))
    assert got == [("2026-08-09", 2, "100", "1", 100000000), ("2026-08-10", 2, "100", "1", 100000000)]
    by_date = rows(realseries.base_coverage_by_date(realseries.base_coverage(daily, "2026-08-09")).select(F.col("date").cast("string"), "coverage_basis_points", "quality_state"))
    assert by_date[2] == ("2026-08-11", 5000, "abstain_incomplete_base_basket_coverage")
    status = {(r["mpn"], str(r["date"])): (r["status"], r["stale_days"]) for r in realseries.base_coverage(daily, "2026-08-09").collect()}
    assert status[("B", "2026-08-11")] == ("missing_current_observation_no_imputation", 1)
    assert status[("C", "2026-08-11")] == ("no_baseline_observation", None)


def test_exact_thirds(spark):
    q = obs(spark, [(m, "s", d, p, True) for d, ps in (("2026-08-09", (3, 7, 11)), ("2026-08-10", (1, 2, 3))) for m, p in zip("ABC", ps)]).withColumns(
        {"status": F.lit("eligible"), "reasons": F.array().cast("array<string>")}
    )
    r = realseries.fixed_base_relative(realseries.dated_lines(q), "2026-08-09").orderBy(F.desc("date")).first()
    from fractions import Fraction

    level = (Fraction(1, 3) + Fraction(2, 7) + Fraction(3, 11)) / 3 * 100
    assert (r["level_num"], r["level_den"]) == (str(level.numerator), str(level.denominator))
    assert r["level_micros"] == int(level * 1000000 + Fraction(1, 2))


def test_linked_vintage(spark):
    def points(data):
        return literal_table(spark, "d string, state string, value bigint", data).select(F.to_date("d").alias("date"), "state", "value")

    prior = points([("2026-01-01", "AVAILABLE", 100_000_000), ("2026-01-02", "GAP", None)]).withColumn("segment_no", F.lit(1).cast("long"))
    candidate = points([("2026-01-02", "AVAILABLE", 1), ("2026-01-03", "AVAILABLE", 50_000_000), ("2026-01-04", "GAP", None)])
    overlap = literal_table(spark, "d string, quality_state string, prior_value bigint, candidate_value bigint", [
        ("2026-01-02", "AVAILABLE", 3, 1), ("2026-01-01", "AVAILABLE", 2, 3),
    ]).withColumn("date", F.to_date("d"))
    got = rows(realseries.link_vintage(prior, candidate, overlap, "2026-01-03").select("segment_no", F.col("date").cast("string"), "value"))
    assert got == [(1, "2026-01-01", 100000000), (1, "2026-01-02", None), (2, "2026-01-03", 33333333), (2, "2026-01-04", None)]


def test_month_needs_every_date(spark):
    daily = spark.sql("SELECT * FROM VALUES (DATE'2026-01-01', 10.0), (DATE'2026-01-02', 20.0), (DATE'2026-02-01', 5.0) AS t(date, value)").select(
        "date", F.col("value").cast("decimal(38,10)").alias("value")
    )
    contracts = spark.sql("SELECT * FROM VALUES ('2026-01', DATE'2026-01-01'), ('2026-01', DATE'2026-01-02'), ('2026-02', DATE'2026-02-01'), ('2026-02', DATE'2026-02-02') AS t(month, required_date)")
    months = realseries.monthly_complete_mean(daily, contracts)
    assert [(r["month"], r["quality_state"], None if r["value"] is None else float(r["value"])) for r in months.orderBy("month").collect()] == [
        ("2026-01", "AVAILABLE", 15.0), ("2026-02", "UNAVAILABLE_MONTH_INCOMPLETE", None)
    ]
    level = realseries.reference_level(months, months.select("month"))
    assert level.first()["quality_state"] == "UNAVAILABLE_HISTORICAL_REFERENCE_INPUT"
    deflator = literal_table(spark, "month string, value double", [("2026-01", 2.0)])
    assert [(r["value"], r["unavailable_reason"]) for r in realseries.constant_price(months, deflator, "2026-01").orderBy("month").collect()] == [
        (15.0, None), (None, "monthly_nominal_unavailable")
    ]


def test_unknown_facts_agree_with_nothing(spark):
    """Unknown tax on both sides, or values that change columns around a null, are no agreement."""
    from pricetrail.operators.qualify import match_evidence

    o = spark.sql("""SELECT * FROM VALUES ('o1', true, 'e1', 'u', TIMESTAMP'2026-01-01', 's', 'A', 5L, 'GBP', CAST(NULL AS STRING)),
      ('o2', true, 'e2', 'u', TIMESTAMP'2026-01-01', 's', 'A', 5L, 'GBP', 'included') AS
      t(observation_id, archived, evidence_id, source_url, observed_at, seller_display_name, mpn, amount_minor, currency, vat_state)""")
    ledger = spark.sql("""SELECT *, 200 AS http_status, repeat('a', 64) AS response_sha256, 9L AS response_bytes FROM VALUES
      ('e1', 's', 'u', TIMESTAMP'2026-01-01', 'A', 5L, 'GBP', CAST(NULL AS BOOLEAN)), ('e2', 's', 'u', TIMESTAMP'2026-01-01', 'A', 5L, 'GBP', true) AS
      t(evidence_id, seller_display_name, source_url, retrieved_at, fact_mpn, fact_amount_minor, fact_currency, fact_vat_included)""")
    got = {r["observation_id"]: r["facts_equal"] for r in match_evidence(o, ledger).collect()}
    assert got == {"o1": False, "o2": True}


def test_restrictions_are_read_in_values_not_names(spark):
    from pricetrail.operators.qualify import restriction_reasons

    df = spark.sql("SELECT * FROM VALUES ('none', 'x'), ('Rejected by review', NULL), (NULL, NULL) AS t(rejection, note)")
    assert [len(r[0]) for r in df.select(restriction_reasons(["rejection", "note"], [])).collect()] == [0, 1, 0]


def test_coverage_divides_by_the_whole_base(spark):
    from pricetrail.operators.realseries import base_coverage, base_coverage_by_date

    daily = spark.sql("""SELECT mpn, 's' AS seller, CAST(d AS DATE) AS date, true AS eligible FROM VALUES
      ('A', '2026-01-01'), ('A', '2026-01-02'), ('B', '2026-01-02'), ('A', '2026-01-03') AS t(mpn, d)""")
    got = {str(r["date"])[-1]: (r["baseline_eligible_line_count"], r["coverage_basis_points"]) for r in base_coverage_by_date(base_coverage(daily, "2026-01-02")).collect()}
    assert got == {"1": (2, 5000), "2": (2, 10000), "3": (2, 5000)}


def test_nested_values_are_searched_for_leaks(spark):
    from pricetrail.operators.publish import assert_public_safe, secret_columns

    df = spark.sql("""SELECT named_struct('price', 1L, 'note', 'ok') AS a, array('fine', 'GBP 1.23', NULL) AS b,
      map('k', array(named_struct('v', 2.5D))) AS c, CAST(NULL AS ARRAY<STRING>) AS d, 1L AS n""")
    found = {(r["rule"], r["key"]) for r in assert_public_safe(df, ["a", "b", "c", "d", "n", "note", "v"]).collect()}
    assert found == {
        ("not_in_public_schema", "a.price"), ("money_bearing_name", "a.price"), ("non_integer_number", "c.v"),
        ("currency_text", "b"), ("two_decimal_text", "b"),
    }
    assert assert_public_safe(df.select("n", "d"), ["n", "d"]).count() == 0
    assert secret_columns(spark.sql("SELECT 1 AS accessToken, 2 AS clientSecret, 3 AS tokenise, 4 AS plain")) == ["accessToken", "clientSecret"]
