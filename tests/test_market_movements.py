from __future__ import annotations

from pyspark.sql import functions as F

from pricetrail.operators import market, movements, qualify
from tests.helpers import obs, rows


def offers(spark, data):
    """(mpn, retailer, instant, price, availability, kind)"""
    full = [(f"p{i:02d}", *r) for i, r in enumerate(data)]
    df = spark.createDataFrame(full, "public_observation_id string, mpn string, retailer_id string, t string, item_price_minor long, availability string, observation_kind string")
    return df.withColumn("observed_at", F.to_timestamp("t")).drop("t")


def declared(spark, *mpns):
    return spark.createDataFrame([(m,) for m in mpns], "mpn string")


D, S = "direct_retail_observation", "in_stock"


def test_daily_example(spark):
    o = offers(spark, [
        ("A", "r1", "2026-08-13 09:00:00", 10000, S, D), ("A", "r1", "2026-08-13 12:00:00", 11000, S, D),
        ("A", "r2", "2026-08-13 09:00:00", 13000, S, D), ("B", "r1", "2026-08-13 09:00:00", 20000, S, D),
    ])
    day = market.daily_offers(o, [9999999])
    r = market.daily_market(day, declared(spark, "A", "B")).first()
    assert (r["typical_minor"], r["low_minor"], r["high_minor"], r["observation_count"], r["coverage_permille"]) == (16000, 11000, 20000, 3, 1000)
    assert rows(market.daily_products(day), "mpn", "median_minor") == [("A", 12000), ("B", 20000)]
    assert r["capture_basis"] == "direct"


def test_quarantine_counts(spark):
    o = spark.createDataFrame([("available_to_order", 100), ("in_stock", 9999999), ("in_stock", 5), (None, 5)], "availability string, amount_minor long")
    kept, counts = qualify.quarantine_sentinels(o, [9999999])
    assert rows(kept) == [("in_stock", 5)] and rows(counts) == [(2, 1, 1)]


def test_coverage_is_floor(spark):
    o = offers(spark, [("A", "r", "2026-08-13 09:00:00", 100, S, D)])
    day = market.daily_offers(o, [])
    assert market.daily_market(day, declared(spark, "A", "B", "C")).first()["coverage_permille"] == 333


def test_london_day_and_ranges(spark):
    o = offers(spark, [("A", "r", "2026-08-16 23:30:00", 100, S, D), ("A", "r", "2026-08-10 23:30:00", 100, S, D), ("A", "r", "2026-08-09 22:00:00", 100, S, D)])
    points = market.daily_market(market.daily_offers(o, []), declared(spark, "A"))
    assert rows(points.select(F.col("date").cast("string"))) == [("2026-08-09",), ("2026-08-11",), ("2026-08-17",)]
    assert rows(market.range_points(points, "7D").select(F.col("date").cast("string"))) == [("2026-08-11",), ("2026-08-17",)]


def test_islands_and_change(spark):
    prices = {"13": 10000, "14": 10000, "16": 12000, "17": 13000}
    o = offers(spark, [("A", "r", f"2026-08-{d} 09:00:00", p, S, D) for d, p in prices.items()])
    day = market.daily_offers(o, [])
    points, products = market.daily_market(day, declared(spark, "A")), market.daily_products(day)
    assert rows(market.day_segments(points), "point_count") == [(2,), (2,)]
    change = {str(r["date"]): r["change_permille"] for r in market.previous_day_change(points, products).collect()}
    assert change == {"2026-08-13": None, "2026-08-14": 0, "2026-08-16": None, "2026-08-17": 83}


def test_product_set_guard(spark):
    o = offers(spark, [
        ("A", "r", "2026-08-13 09:00:00", 10000, S, D), ("B", "r", "2026-08-13 09:00:00", 10000, S, D),
        ("B", "r", "2026-08-14 09:00:00", 11000, S, D), ("A", "r", "2026-08-14 09:30:00", 11000, S, D),
        ("B", "r", "2026-08-15 09:00:00", 11000, S, D), ("C", "r", "2026-08-15 09:00:00", 11000, S, D),
    ])
    day = market.daily_offers(o, [])
    change = market.previous_day_change(market.daily_market(day, declared(spark, "A", "B", "C")), market.daily_products(day))
    assert [r["change_permille"] for r in change.orderBy("date").collect()] == [None, 100, None]


def test_monthly_mean(spark):
    o = offers(spark, [("A", "r", "2026-01-05 09:00:00", 10000, S, D), ("A", "r", "2026-01-06 09:00:00", 20000, S, D), ("A", "r", "2026-03-06 09:00:00", 30000, S, D)])
    day = market.daily_offers(o, [])
    monthly = market.monthly_average(market.daily_market(day, declared(spark, "A")), market.daily_products(day))
    assert rows(monthly, "month", "typical_minor", "daily_point_count") == [("2026-01", 15000, 2), ("2026-03", 30000, 1)]


def test_public_offers_keep_copies_once_and_drop_conflicts(spark):
    base = offers(spark, [("A", "r1", "2026-08-13 09:00:00", 100, S, D)] * 3 + [("B", "r1", "2026-08-13 09:00:00", 100, S, D), ("B", "r1", "2026-08-13 09:00:00", 101, S, D)])
    c = base.select(
        F.concat(F.lit("offer-"), "mpn", F.col("item_price_minor").cast("string")).alias("public_observation_id"), "observed_at", "observation_kind", "mpn", "retailer_id",
        F.lit("R").alias("retailer_name"), "item_price_minor", F.lit("GBP").alias("currency"), F.lit("included").alias("vat_state"), "availability",
        F.lit("excluded_not_verified").alias("delivery_state"), F.lit("https://x").alias("source_url"), F.col("public_observation_id").alias("observation_id"),
    )
    assert rows(market.public_offers(c), "mpn", "item_price_minor") == [("A", 100)]
    refused = c.select("observation_id", "mpn", "observed_at", F.array().cast("array<string>").alias("reasons"))
    held = market.offer_exceptions(refused, c)
    assert rows(held, "observation_id", "disposition") == [
        ("p01", "excluded_exact_duplicate"), ("p02", "excluded_exact_duplicate"), ("p03", "excluded_conflicting_duplicate"), ("p04", "excluded_conflicting_duplicate"),
    ]


def landed(spark, **change):
    row = {
        "observation_id": "o-1", "observed_at": "2026-08-13 09:00:00", "product_key": "a", "mpn_expected": "A", "mpn_observed": "A", "match_basis": "exact_mpn",
        "channel": "PRIMARY_RETAIL", "retailer_key": "r", "retailer_name": "R", "seller_relationship": "retailer_owned", "item_price_minor": 9000, "currency": "GBP",
        "vat_state": "included", "availability": "in_stock", "delivery_state": "mandatory_cost_known", "delivery_amount_minor": 999,
        "landed_eligibility": "eligible", "landed_price_minor": 9999,
    }
    row.update(change)
    types = ", ".join(f"{k} {'long' if k.endswith('minor') else 'string'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], types).withColumn("observed_at", F.to_timestamp("observed_at"))


def test_landed_reason_codes(spark):
    cases = [
        ({}, []),
        ({"mpn_observed": None}, ["exact_mpn_unresolved"]),
        ({"mpn_observed": "B", "channel": "MARKETPLACE"}, ["exact_mpn_unresolved", "channel_not_primary_retail"]),
        ({"seller_relationship": "third_party"}, ["retailer_owned_seller_unresolved"]),
        ({"item_price_minor": 0}, ["item_price_not_positive"]),
        ({"vat_state": "unknown"}, ["vat_inclusion_unresolved"]),
        ({"availability": "unknown"}, ["availability_unresolved"]),
        ({"availability": "out_of_stock"}, ["not_available_to_purchase"]),
        ({"delivery_amount_minor": None}, ["mandatory_delivery_unresolved"]),
        ({"delivery_state": "free_delivery_explicit"}, ["mandatory_delivery_unresolved"]),
        ({"landed_eligibility": "unresolved"}, ["landed_price_eligibility_unresolved"]),
        ({"landed_price_minor": 1}, ["landed_price_arithmetic_mismatch"]),
        ({"landed_price_minor": 1, "vat_state": "excluded"}, ["vat_inclusion_unresolved"]),
    ]
    for change, expected in cases:
        assert qualify.qualify_landed(landed(spark, **change)).first()["reasons"] == expected, change


def test_contract_flags_each_bad_field(spark):
    for change, rule in [
        ({"observation_id": "Bad Id"}, "observation_id_not_slug"), ({"mpn_expected": "lower"}, "mpn_expected_not_normalised"), ({"channel": "SHOP"}, "channel_unknown"),
        ({"item_price_minor": -1}, "item_price_negative"), ({"currency": "EUR"}, "currency_not_gbp"), ({"delivery_state": "?"}, "delivery_state_unknown_value"),
        ({"retailer_name": " R"}, "retailer_name_blank"), ({"vat_state": None}, "vat_state_unknown"),
    ]:
        assert [r["rule"] for r in qualify.check_contract(landed(spark, **change)).collect()] == [rule]
    assert qualify.check_columns(landed(spark).withColumn("extra", F.lit(1)).drop("channel"), landed(spark).columns) == ["missing channel", "unknown extra"]


def qualified_lines(spark, data):
    df = spark.createDataFrame(
        [(f"o{i}", *r) for i, r in enumerate(data)], "observation_id string, product_key string, retailer_key string, t string, landed_price_minor long, status string"
    )
    return df.withColumn("observed_at", F.to_timestamp("t"))


def test_line_movements_example(spark):
    q = qualified_lines(spark, [
        ("a", "r", "2026-08-01 09:00:00", 9999, "eligible"), ("a", "r", "2026-08-02 09:00:00", 1, "abstain"), ("a", "r", "2026-08-03 09:00:00", 9498, "eligible"),
        ("b", "r", "2026-08-01 09:00:00", 11000, "eligible"), ("b", "r", "2026-08-02 09:00:00", 11000, "eligible"),
        ("c", "r", "2026-08-01 09:00:00", 5, "eligible"), ("d", "r", "2026-08-01 09:00:00", 5, "abstain"),
        ("e", "r", "2026-08-01 09:00:00", 5, "eligible"), ("e", "r", "2026-08-01 10:00:00", 6, "eligible"),
    ])
    assert rows(movements.line_movements(q), "product_key", "change_minor", "change_basis_points", "direction") == [("a", -501, -501, "down"), ("b", 0, 0, "flat")]
    assert rows(movements.line_conflicts(q), "product_key", "eligible_count") == [("e", 2)]
    assert rows(movements.insufficient_history(q), "product_key", "eligible_date_count") == [("c", 1), ("d", 0), ("e", 1)]


def test_widest_prefers_one_seller(spark):
    o = obs(spark, [
        ("A", "s1", "2024-01-01", 100, True), ("A", "s1", "2024-02-01", 150, None), ("A", "s2", "2023-01-01", 10, True),
        ("B", "s1", "2024-01-01", 100, True), ("B", "s2", "2024-03-01", 90, False), ("C", "s1", "2024-01-01", 1, True),
    ])
    assert rows(movements.widest_movements(o), "mpn", "delta_minor", "delta_basis_points", "comparison_basis", "vat_state_to", "vat_disclosure_required") == [
        ("A", 50, 5000, "within_seller", "unresolved", True), ("B", -10, -1000, "cross_seller", "excluded", False),
    ]


def test_widest_tie_goes_to_first_seller(spark):
    o = obs(spark, [("A", "z", "2024-01-01", 1, True), ("A", "z", "2024-01-11", 2, True), ("A", "a", "2024-02-01", 5, True), ("A", "a", "2024-02-11", 9, True)])
    assert movements.widest_movements(o).first()["from_seller"] == "a"


def test_source_addresses_are_parsed(spark):
    from pricetrail.operators.qualify import check_source_url

    good = ["https://www.shop.example/p/1", "https://shop.example", "https://shop.example:443/p", "https://shop.example:/p", "HTTPS://SHOP.Example/p", "https://shop.example/p?", "https://shop.example/p#"]
    bad = ["http://shop.example/p", "https://shop.example:444/p", "https://me@shop.example/p", "https://shop.example/p?x=1", "https://shop.example/p#top", "https://shop.example.evil/p",
           "https://evil.example/shop.example", "https://", "shop.example/p", "https://shop.example/a b", "https://shop.example\\\\@evil.example/", None, ""]
    stamp = "https://web.archive.org/web/20260102030405id_/"
    archived_good = [stamp + u for u in good[:5] if u.startswith("https")] + ["https://WEB.archive.org:443/web/20260102030405id_/https://shop.example/p"]
    archived_bad = [stamp + u for u in bad[:7]] + [stamp, good[0], stamp.replace("id_", "") + good[0], stamp.replace("0405", "0406") + good[0], stamp.replace("web.", "www.") + good[0]]
    cases = [(u, False, True) for u in good] + [(u, False, False) for u in bad] + [(u, True, True) for u in archived_good] + [(u, True, False) for u in archived_bad]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, archived boolean, want boolean")
    hosts = F.array(F.lit("www.shop.example"), F.lit("shop.example"))
    ok = check_source_url(F.col("url"), F.col("archived"), F.lit("2026-01-02 03:04:05").cast("timestamp"), hosts)
    got = {r["i"]: r["ok"] for r in df.select("i", ok.alias("ok")).collect()}
    assert [(u, a) for i, (u, a, want) in enumerate(cases) if got[i] != want] == []
    assert not df.select(check_source_url(F.col("url"), F.col("archived"), F.lit(None).cast("timestamp"), F.lit(None).cast("array<string>")).alias("ok")).where("ok").count()


def test_evidence_must_show_the_kit_on_both_sides(spark):
    from pricetrail.operators.qualify import match_evidence

    row = {"observation_id": "o", "archived": True, "evidence_id": "e", "source_url": "u", "seller_display_name": "s", "mpn": "A", "amount_minor": 5, "currency": "GBP", "vat_state": "included",
           "capacity_gb": 32, "module_count": 2, "memory_type": "DDR5", "response_sha256": None, "response_bytes": None, "archive_url": None}
    entry = {"evidence_id": "e", "seller_display_name": "s", "source_url": "u", "http_status": 200, "response_sha256": "a" * 64, "response_bytes": 9, "fact_mpn": "A", "fact_amount_minor": 5,
             "fact_currency": "GBP", "fact_vat_included": True, "fact_capacity_gb": 32, "fact_module_count": 2, "archive_url": "w"}
    cases = [({}, {}, True), ({"capacity_gb": 16}, {}, False), ({"module_count": None}, {}, False), ({"memory_type": "DDR4"}, {}, False), ({}, {"fact_capacity_gb": 16}, False), ({}, {"fact_module_count": None}, False),
             ({"capacity_gb": 16}, {"fact_capacity_gb": 16}, False), ({"response_sha256": "a" * 64}, {}, True), ({"response_sha256": "b" * 64}, {}, False), ({"response_bytes": 9}, {}, True), ({"response_bytes": 8}, {}, False),
             ({"response_bytes": 0}, {}, True), ({"archive_url": "w"}, {}, True), ({"archive_url": "x"}, {}, False), ({"archive_url": "x", "archived": False}, {}, True), ({}, {"archive_captured_at": "2026-01-02"}, False),
             ({}, {"retrieved_at": "2026-01-02"}, True), ({"archived": False}, {"archive_captured_at": "2026-01-02"}, True)]
    obs_rows = [row | {"observation_id": f"o{i}", "evidence_id": f"e{i}", "source_url": f"u{i}", "observed_at": "2026-01-01"} | o for i, (o, _, _) in enumerate(cases)]
    entries = [entry | {"evidence_id": f"e{i}", "source_url": f"u{i}", "retrieved_at": "2026-01-01", "archive_captured_at": "2026-01-01"} | e for i, (_, e, _) in enumerate(cases)]
    obs_df = spark.createDataFrame(obs_rows, "observation_id string, archived boolean, evidence_id string, source_url string, seller_display_name string, mpn string, amount_minor long, currency string, vat_state string, "
                                   "capacity_gb int, module_count int, memory_type string, response_sha256 string, response_bytes long, archive_url string, observed_at string").withColumn("observed_at", F.to_timestamp("observed_at"))
    ledger = spark.createDataFrame(entries, "evidence_id string, seller_display_name string, source_url string, http_status int, response_sha256 string, response_bytes long, fact_mpn string, fact_amount_minor long, fact_currency string, "
                                   "fact_vat_included boolean, fact_capacity_gb int, fact_module_count int, archive_url string, retrieved_at string, archive_captured_at string").withColumns({c: F.to_timestamp(c) for c in ("retrieved_at", "archive_captured_at")})
    got = {r["observation_id"]: r["facts_equal"] for r in match_evidence(obs_df, ledger).collect()}
    assert [(i, c) for i, c in enumerate(cases) if got[f"o{i}"] != c[2]] == []
