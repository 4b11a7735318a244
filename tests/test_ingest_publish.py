from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import ingest, publish
from pricetrail.sources.release import check_release, release_difference, release_manifest, write_release
from pricetrail.sources.tables import literal_table
from pricetrail.sources.tranches import input_files, read_ledger, read_manifest, read_run_ledger, read_tranches
from tests.helpers import rows

LIVE = {
    "observation_id": "live-1", "observed_at": "2026-08-12T12:00:00Z", "identity": {"mpn_expected": "AX-1", "mpn_observed": " ax-1", "match_basis": "exact_mpn"},
    "item_price": {"amount_minor": 9999, "currency": "GBP", "vat_state": "included"}, "seller": {"display_name": "Shop", "legal_name": None},
    "landed_price": {"amount_minor": None, "currency": "GBP", "eligibility": "abstain"}, "surprise": {"secret": 1},
}
OLD = {
    "observation_id": "old-1", "observed_at": "2026-08-10T12:00:00Z", "product": {"mpn": "AX-2", "capacity_gb": 32, "module_count": 2, "memory_type": "DDR5"},
    "price": {"item_price_minor": 5000, "currency": "GBP", "vat_included": None}, "seller": {"display_name": "Shop"}, "eligibility": {"identity_exact": True},
    "source": {"source_class": "archived_primary_retail_storefront", "evidence_id": "e1"},
}


def tranche(scope, observations, **extra):
    return {"schema_version": 1, "tranche_id": "t", "status": "candidate_private_immutable", "scope": scope, "channel": "PRIMARY_RETAIL",
            "created_at": "2026-08-12T13:00:00Z", "observations": observations, **extra}


@pytest.fixture
def batch_files(tmp_path):
    (tmp_path / "live.json").write_text(json.dumps(tranche("candidate_only", [LIVE]), indent=1))
    (tmp_path / "old.json").write_text(json.dumps(tranche("candidate_only_historical_backfill", [OLD, {**OLD, "observation_id": "old-2", "product": {**OLD["product"], "capacity_gb": 64}}]), indent=1))
    return str(tmp_path)


def test_tranches_of_both_shapes(spark, batch_files):
    raw = read_tranches(spark, batch_files)
    assert "surprise" not in raw.columns
    kind = F.when(F.col("tranche_scope") == "candidate_only", F.lit("prospective_capture")).otherwise(F.lit("archive_capture"))
    flat = ingest.normalise_observations(raw.withColumn("capture_kind", kind))
    got = {r["observation_id"]: r for r in flat.collect()}
    assert (got["live-1"]["mpn"], got["live-1"]["amount_minor"], got["live-1"]["vat_included"], got["live-1"]["reasons"]) == ("AX-1", 9999, True, [])
    assert (got["old-1"]["mpn"], got["old-1"]["vat_included"], got["old-1"]["reasons"]) == ("AX-2", None, [])
    assert got["old-2"]["reasons"] == ["capacity_out_of_scope"]
    heads = raw.select("schema_version", "tranche_scope", "channel", "created_at", "source_file").distinct()
    assert ingest.discover_prospective(heads).count() == 1
    facts = {r["observation_id"]: r["vat_state"] for r in ingest.observation_facts(raw).collect()}
    assert facts == {"live-1": "included", "old-1": "unknown", "old-2": "unknown"}


def test_every_file_is_classified_once(spark, batch_files):
    files = input_files(spark, batch_files)
    seen = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert seen["old.json"]["all_archived_primary_retail"] and not seen["live.json"]["all_archived"]

    def entry(name, **change):
        r = seen[name]
        base = {"path": r["path"], "sha256": r["sha256"], "schema_version": 1, "channel": "PRIMARY_RETAIL", "capture_kind": "prospective_capture",
                "decision": "included_private_candidate", "reason": "fine"}
        return tuple({**base, **change}.values())

    columns = "path string, sha256 string, schema_version int, channel string, capture_kind string, decision string, reason string"
    good = literal_table(spark, columns, [entry("live.json"), entry("old.json", capture_kind="archive_capture")])
    assert rows(ingest.classify_inputs(files, good)) == []
    bad = literal_table(spark, columns, [entry("live.json", sha256="00"), entry("live.json", sha256="00"), entry("live.json", path="gone.json")])
    assert [r["rule"] for r in ingest.classify_inputs(files, bad).orderBy("rule").collect()] == [
        "classified_file_missing", "classified_more_than_once", "file_not_classified", "hash_mismatch"
    ]
    one = literal_table(spark, columns, [entry("old.json")])
    assert ingest.append_classification(one, files).where("decision = 'excluded_private_candidate'").count() == 1
    assert ingest.already_classified(one, files).count() == 1


def test_other_batch_files(spark, tmp_path):
    (tmp_path / "ledger.json").write_text(json.dumps({"entries": [{"evidence_id": "e1", "http_status": 200, "facts": {"mpn": "AX-2"}}]}))
    assert rows(read_ledger(spark, str(tmp_path / "ledger.json")), "evidence_id", "fact_mpn") == [("e1", "AX-2")]
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"path": "a", "decision": "included_private_candidate", "capture_kind": "archive_capture"}]}))
    assert rows(ingest.included_inputs(read_manifest(spark, str(tmp_path / "m.json")))) == [("a", "archive_capture")]
    (tmp_path / "runs.json").write_text(json.dumps({"runs": [{"run_id": "r", "abstention_reasons": {"HTTP_403": 2}}], "missed_slots": [{"scheduled_for": "s"}], "acknowledgements": []}))
    runs, slots, acks = read_run_ledger(spark, str(tmp_path / "runs.json"))
    assert (runs.first()["abstention_reasons"], slots.count(), acks.count()) == ({"HTTP_403": 2}, 1, 0)


def test_crawl_rules(spark):
    rules = literal_table(spark, "host string, agent_group string, allow boolean, path string", [
        ("a", "*", False, "/shop"), ("a", "*", True, "/shop/open"), ("a", "*", False, ""), ("b", "*", False, "/"), ("b", "collector", True, "/x"),
        ("c", "*", False, "/same"), ("c", "*", True, "/same"), ("d", "other", False, "/"),
    ])
    targets = literal_table(spark, "host string, path string", [("a", "/shop/1"), ("a", "/shop/open/1"), ("a", "/"), ("b", "/anything"), ("c", "/same/1"), ("d", "/q"), ("e", "/q")])
    got = {(r["host"], r["path"]): r["allowed"] for r in ingest.resolve_crawl_rules(targets, rules, "my-collector").collect()}
    assert got == {("a", "/shop/1"): False, ("a", "/shop/open/1"): True, ("a", "/"): True, ("b", "/anything"): True, ("c", "/same/1"): True, ("d", "/q"): True, ("e", "/q"): True}


def test_shape_is_waived_only_when_it_is_the_sole_problem(spark):
    columns = "reading_id string, url string, seller_display_name string, mpn string, amount_minor bigint, vat_included boolean, capacity_gb bigint, module_count bigint, observed_at string"
    readings = literal_table(spark, columns, [
        ("seen", "u1", "s", "AX-1", 100, True, 32, 2, "2026-01-01"), ("waived", "u2", "s", "ax-1", 100, True, None, None, "2026-01-02"),
        ("other", "u3", "s", "AX-1", 100, True, None, None, "2026-01-03"), ("moved", "u4", "s", "AX-9", 100, True, 32, 2, "2026-01-04"),
    ]).withColumn("reasons", F.when(F.col("reading_id") == "waived", F.array(F.lit("CAPACITY_NOT_VISIBLE"))).when(F.col("reading_id") == "other", F.array(F.lit("CAPACITY_NOT_VISIBLE"), F.lit("HTTP_404"))).otherwise(F.array().cast("array<string>")))
    targets = literal_table(spark, "url string, seller_display_name string, mpn string", [(f"u{i}", "s", "AX-1") for i in range(1, 5)])
    got = {r["reading_id"]: (r["usable"], r["capacity_basis"], r["reasons"]) for r in ingest.accept_readings(readings, targets, ingest.established_shapes(readings)).collect()}
    assert got["seen"] == (True, "visible_on_page", [])
    assert got["waived"] == (True, "established_for_mpn_from_prior_evidence", [])
    assert got["other"] == (False, None, ["CAPACITY_NOT_VISIBLE", "HTTP_404"])
    assert got["moved"] == (False, "visible_on_page", ["MPN_MISMATCH_URL_MAY_HAVE_MOVED"])


def test_release_round_trip(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    path = str(tmp_path / "release")
    write_release(df, path, ["k"], files=3)
    assert rows(check_release(spark, df, path)) == []
    changed = df.withColumn("v", F.when(F.col("k") == 5, 99).otherwise(F.col("v")))
    assert rows(release_difference(df, changed), "k", "v", "side") == [(5, 5, "only_recorded"), (5, 99, "only_derived")]
    assert rows(release_difference(df, df.union(df.where("k = 3"))), "k", "surplus", "side") == [(3, 1, "only_derived")]
    one, other = release_manifest({"a": df}).first(), release_manifest({"a": df.repartition(5).orderBy(F.desc("k"))}).first()
    assert one == other and one["row_count"] == 100
    assert release_manifest({"a": changed}).first()["sha256"] != one["sha256"]


def test_projection_is_closed(spark):
    index = spark.sql("""SELECT '2024Q1' AS period_id, 'observed' AS state, 103.568D AS index_value, 1.1D AS link, 3L AS matched_product_count,
        4L AS distinct_products_in_period, false AS reference_period, 'poison' AS private_field, 12345 AS amount_minor""")
    out = publish.project_index(index)
    assert out.columns == ["period_id", "state", "index_milli", "link_permille", "change_permille", "matched_product_count", "distinct_products_in_period", "is_reference"]
    assert (out.first()["index_milli"], out.first()["change_permille"]) == (103568, 100)
    assert rows(publish.assert_public_safe(out, out.columns)) == []


def test_unsafe_tables_are_reported(spark):
    df = spark.sql("SELECT 1.5D AS ratio, 'costs £5' AS note, 'at 12.34 each' AS text, 1 AS item_price, 'A' AS mpn_expected, 'B' AS mpn_observed")
    found = {(r["rule"], r["key"]) for r in publish.assert_public_safe(df, ["note", "text", "ratio"]).collect()}
    assert {("currency_text", "note"), ("two_decimal_text", "text"), ("money_bearing_name", "item_price"), ("not_in_public_schema", "mpn_observed"),
            ("non_integer_number", "ratio"), ("identity_comparison", "mpn_expected,mpn_observed")} <= found


def test_leak_scan_equals_brute_force(spark):
    texts = ["the offer-123456 costs GBP 99.99 today", "https://shop.example/p/ax-1", "nothing here", "é中文 token x", "https://shop.example/p/ax-2 and 9.9", ""]
    tokens = ["offer-123456", "99.99", "https://shop.example/p/ax-1", "https://shop.example/p/ax-2", "中文", "x", "absent-token", "9"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    k = spark.createDataFrame([(x,) for x in tokens], "token string")
    assert set(rows(publish.leak_scan(t, k))) == {(i, x) for i, text in enumerate(texts) for x in tokens if x in text}
    assert rows(publish.leak_scan(t, k.where("false"))) == []


def test_secret_shapes(spark):
    planted = ["Bearer abcdefghijkl0123", "AKIA" + "A" * 16, "https://user:pass@host/", "api_key = 'abcdefghijklmnop'", "plain text", "-----BEGIN RSA PRIVATE KEY-----"]
    t = spark.createDataFrame(list(enumerate(planted)), "text_id long, text string")
    assert rows(publish.secret_scan(t), "text_id", "kind") == [(0, "bearer"), (1, "vendor_key"), (2, "url_credentials"), (3, "named_field"), (5, "private_key")]
    assert publish.secret_columns(spark.createDataFrame([], "a int, api_key string, tokens int, set_cookie string")) == ["api_key", "set_cookie"]


def test_tokens(spark):
    df = spark.sql("SELECT 'o-1' AS observation_id, 'A' AS mpn, 12345L AS amount UNION ALL SELECT 'o-2', 'A', 99L")
    assert rows(publish.private_tokens(df, "amount")) == [("123.45",), ("GBP 123.45",), ("o-1",), ("o-2",), ("£123.45",)]
    codes = spark.sql("SELECT array('HTTP_404', 'lower', 'SHORT') AS reasons, 'PRICE_NOT_VISIBLE' AS code")
    assert rows(publish.reason_tokens(codes, ["reasons", "code"])) == [("HTTP_404",), ("PRICE_NOT_VISIBLE",)]


def test_price_far_behind_its_anchor_is_found(spark):
    from pricetrail.operators.ingest import SiteRules, extract_page_facts

    rule = SiteRules("s", r"<h1>(.*?)</h1>", r"MPN: (\S+)", r"class=.price", r"(?i)inc\.? vat", r"(?i)ex\.? vat", "In stock", "Out of stock")
    far = "<h1>32GB (2x16GB) DDR5</h1> MPN: AB-1 <p class='price'>" + "<i></i>" * 400 + "£12.34 ex VAT</p> <footer>inc VAT</footer>"
    pages = spark.createDataFrame([("p", "s", "u", far)], "page_id string, site string, url string, html string")
    got = extract_page_facts(pages, [rule]).first()
    assert (got["amount_minor"], got["vat_included"], got["reasons"]) == (1234, False, [])


def test_price_is_read_inside_its_element_only(spark):
    from pricetrail.operators.ingest import SiteRules, extract_page_facts

    rule = SiteRules("s", r"<h1>(.*?)</h1>", r"MPN: (\S+)", 'id="box"', r"(?i)inc\.? vat", r"(?i)ex\.? vat", "In stock", "Out of stock")
    bodies = {
        "delivery": '<div id="box">call</div><p>Delivery £4.99 inc VAT</p>', "other": '<div id="box">call</div><div>Also bought £19.99 ex VAT</div>',
        "before": '<p>£1.00</p><div id="box"></div>', "nested": '<DIV class="a" id="box"><div>was</div><div><div>£1,234.50</div> ex VAT</div></DIV><div>£9.99 inc VAT</div>',
        "open": '<div id="box">£5.00 inc VAT', "inner": '<div id="box"><div>£5.00 inc VAT</div><p>£6.00</p>', "far": '<div id="box">' + "<i></i>" * 2000 + "£7.00 inc VAT</div>",
        "none": "<p>£3.00 inc VAT</p>", "void": '<input id="box" value="£2.00"><p>£8.00</p>',
    }
    pages = spark.createDataFrame([(k, "s", "u", f"<h1>32GB (2x16GB) DDR5</h1> MPN: AB-1 {v}") for k, v in bodies.items()], "page_id string, site string, url string, html string")
    got = {r["page_id"]: (r["amount_minor"], r["vat_included"]) for r in extract_page_facts(pages, [rule]).collect()}
    assert got == {"nested": (123450, False), "far": (700, True), **{k: (None, None) for k in ("delivery", "other", "before", "open", "inner", "none", "void")}}
    reasons = {r["page_id"]: r["reasons"] for r in extract_page_facts(pages, [rule]).collect()}
    assert reasons["delivery"] == reasons["other"] == ["PRICE_NOT_VISIBLE", "VAT_DISPLAY_MODE_NOT_VISIBLE"]


def test_readings_without_id_stay_apart(spark):
    readings = spark.sql("""SELECT *, 's' AS seller_display_name, 'm' AS mpn, TIMESTAMP'2026-01-01' AS observed_at, CAST(NULL AS STRING) AS rejection FROM VALUES
      (CAST(NULL AS STRING), 1), (NULL, 1), (NULL, 2), ('r', 4), ('r', 3) AS t(reading_id, amount_minor)""")
    held = readings.select("seller_display_name", "mpn", "observed_at").where("false")
    assert rows(ingest.drop_already_retained(readings, held), "reading_id", "amount_minor") == [("r", 3), (None, 1), (None, 1), (None, 2)]


def test_json_is_walked_at_any_depth(spark):
    from pricetrail.operators import audit

    body = ('{"a": {"reasons": ["ABSENT_THING", "x"], "abstention_reasons": {"HTTP_404": 3, "LOW": {"z": 1}}}, "item_price": {"amount_minor": 12345}, '
            '"w": [{"weight": null, "source_url": "https://u"}], "s": "{[\\"", "source_url": ["https://in-array"], "tranche_id": 7, "code": "TOP_LEVEL", "note": "NOT_A_REASON"}')
    deep = "[" * 30 + '{"observation_id": "deep", "gap_fill": 1}' + "]" * 30
    docs = spark.createDataFrame([(1, body), (2, "nope{"), (3, None), (4, "5"), (5, "{}"), (6, deep)], "id int, body string")
    assert rows(publish.private_json_tokens(docs, "body")) == [("123.45",), ("GBP 123.45",), ("deep",), ("https://u",), ("£123.45",)]
    assert rows(publish.reason_json_tokens(docs, "body")) == [("ABSENT_THING",), ("HTTP_404",), ("TOP_LEVEL",)]
    assert rows(audit.check_numeric_coupling(docs, "id", "body")) == [
        ("json_malformed", "2", ""), ("numeric_key_present", "1", "amount_minor"), ("numeric_key_present", "1", "weight"), ("numeric_key_present", "6", "gap_fill")]
    assert rows(audit.check_numeric_coupling(docs.limit(0), "id", "body")) == []
    typed = spark.sql("""SELECT 'o-9' AS observation_id, named_struct('page', array(named_struct('source_url', 'https://n', 'x', 'y'))) AS nested, map('review_id', 'r-1', 'k', 'v') AS m""")
    assert rows(publish.private_tokens(typed)) == [("https://n",), ("o-9",), ("r-1",)]
    counts = spark.sql("SELECT named_struct('abstention_reasons', map('PRICE_GONE', 2, 'low', 1)) AS run")
    assert rows(publish.reason_tokens(counts, ["run"])) == [("PRICE_GONE",)]


def test_public_rows_hold_no_private_token(spark):
    df = spark.sql("SELECT named_struct('label', 'see o-771-x') AS item UNION ALL SELECT named_struct('label', 'fine')")
    token = lambda *t: spark.createDataFrame([(x,) for x in t], "token string")
    assert rows(publish.assert_public_safe(df, ["item", "label"], token("o-771", "o-772"), token("FINE_CODE"))) == [("private_token", "o-771", "1")]
    assert rows(publish.assert_public_safe(df, ["item", "label"], token(), token())) == []


def test_leaks_in_many_scripts_and_short_tokens(spark):
    rng = random.Random(9)
    letters = "abé漢\U0001f600 \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    tokens = list({"".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 4, 6, 9, 12) for _ in range(12)}) + [""]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    k = spark.createDataFrame([(x,) for x in tokens], "token string")
    assert set(rows(publish.leak_scan(t, k))) == {(i, x) for i, text in enumerate(texts) if text for x in tokens if x and x in text}


def test_names_without_separators_tell(spark):
    df = spark.createDataFrame([], "usertoken int, DBPassword int, tokens int, secretary int, privateKey int, private_key int, key int, authToken int, x_auth int, author int, myapikey int")
    assert publish.secret_columns(df) == ["usertoken", "DBPassword", "privateKey", "private_key", "authToken", "x_auth", "myapikey"]
