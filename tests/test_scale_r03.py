"""Steps that grew faster than their input, each on rows built here."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from pricetrail.functions.reasons import reason_codes
from pricetrail.functions.sieve import PrintSieve, may_be_in
from pricetrail.operators import catalogue, market, publish
from pricetrail.operators.qualify import match_evidence
from pricetrail.session import settle
from pricetrail.sources.adapter import evidence_ledger
from pricetrail.streaming import live


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_are_not_broadcast(spark):
    listings = spark.createDataFrame([("m", "AX-100Z"), ("n", "AX-100Z")], "manufacturer_key string, mpn_key string")
    products = spark.createDataFrame([("m", "AX-100", "p1")], "manufacturer_key string, mpn_normalized string, product_key string")
    near = catalogue.near_mpn(listings, products)
    assert "SortMergeJoin" in plan_of(near) and "variant" in plan_of(near)
    assert not [line for line in plan_of(near).splitlines() if "BroadcastHashJoin" in line and "variant" in line]
    assert [tuple(r) for r in near.collect()] == [("m", "AX-100Z", "AX-100", "p1", 1)]


def test_no_pair_of_characters_is_removed_twice(spark):
    text = "ABCDEFGH"
    df = spark.createDataFrame([(text,)], "t string")
    once = {text[:i] + text[i + 1:] for i in range(8)}
    want = {text} | once | {s[:i] + s[i + 1:] for s in once for i in range(7)}
    got = df.select(catalogue.deletions(df["t"]).alias("d")).first()["d"]
    assert set(got) == want and len(got) == len(want)


def test_leak_scan_moves_what_surrounds_a_piece(spark):
    assert publish._windows(b"0123456789abcdef", np.array([2, 5, 14]), 2) == [b"0123456", b"cdef"]
    tokens = ["needle-in-hay", "é-needle-twice", "short"]
    texts = ["x" * 5000 + "needle-in-hay" + "y" * 5000, "é-needle-twice, é-needle-twice", "needle-in-hat", None, "", "a short needle-in-haystack"]
    held = spark.createDataFrame([(0, t) for t in texts], "text_id long, text string")
    found = publish.leak_scan(held, spark.createDataFrame([(t,) for t in tokens], "token string"))
    want = sorted((0, t) for x in texts if x for t in tokens if t in x)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "parts" in plan_of(found) and "text_id#" in plan_of(found)


def test_evidence_meets_by_prints(spark):
    at = datetime(2026, 1, 2, 3, 4, 5)
    obs = spark.createDataFrame(
        [("o1", True, "e1", "u1", at, "s", "m", 5, "GBP", "included"), ("o2", False, None, "u2", at, "s", "m", 5, "GBP", "included"), ("o3", True, None, "u1", at, "s", "m", 5, "GBP", "included")],
        "observation_id string, archived boolean, evidence_id string, source_url string, observed_at timestamp, seller_display_name string, mpn string, amount_minor long, currency string, vat_state string",
    )
    ledger = spark.createDataFrame(
        [("e1", "s", "u1", at, 200, "0" * 64, 9, "m", 5, "GBP", True), (None, "s", "u2", at, 200, "0" * 64, 9, "m", 6, "GBP", True)],
        "evidence_id string, seller_display_name string, source_url string, retrieved_at timestamp, http_status int, response_sha256 string, response_bytes long, fact_mpn string, fact_amount_minor long, fact_currency string, fact_vat_included boolean",
    )
    found = match_evidence(obs, ledger)
    assert sorted(tuple(r) for r in found.collect()) == [("o1", 1, True), ("o2", 1, False), ("o3", 0, None)]
    assert "hashpartitioning(key_a" in plan_of(found) and "hashpartitioning(source_url" not in plan_of(found)


def test_a_line_is_followed_over_plain_rows():
    class Newest:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    follower = live.line_follower(("created_at", "tranche_id"))
    follower.newest = Newest()
    line = Row("mpn", "seller", "observation_id", "at", "amount_minor", "created_at", "tranche_id")
    first = [line("m", "s", "b", 20, 7, "1", "t1"), line("m", "s", "a", 10, 5, "1", "t1"), line("m", "s", "c", 20, 9, "2", None), line("m", "s", "d", None, 9, "2", None)]
    out = list(follower.handleInputRows(("m", "s"), iter(first), None))
    assert [(r["observation_id"], r["side"], r["from_observation_id"], r["from_minor"]) for r in out] == [
        ("a", "accepted", None, None), ("b", "accepted", "a", 5), ("d", "refused", None, None), ("c", "refused", None, None)]
    out = list(follower.handleInputRows(("m", "s"), iter([line("m", "s", "e", 30, None, "3", "t3")]), None))
    assert [(r["side"], r["from_observation_id"], r["from_minor"]) for r in out] == [("accepted", "b", 7)]
    assert follower.newest.value == (30, "e", None)


def _offer_tables(spark):
    at = datetime(2026, 1, 2, 3, 4, 5)
    names = ["observation_id", "mpn", "archived", "evidence_id", "source_url", "stock_state", "vat_state", "publication_allowed"]
    rows = [("o1", "m", False, "e1", "https://www.s.example/p", "in_stock", "included", False), ("o2", "m", False, "e2", "https://www.s.example/q", "in_stock", "excluded", None),
            ("o3", "other", False, "e3", "https://www.s.example/r", "in_stock", "included", False), ("o4", "m", True, "e4", "https://www.s.example/p", "unknown", "included", True),
            ("o5", "m", False, "e5", "https://www.s.example/t", "in_stock", "included", False), ("o1", "m", False, "e1", "https://www.s.example/p", "in_stock", "included", False)]
    same = {"observed_at": at, "seller_display_name": "s", "seller_relationship": "retailer_owned", "amount_minor": 500, "currency": "GBP", "stock_text": None, "stock_semantics": None,
            "review_note": None, "identity_exact": True, "match_basis": "exact_mpn"}
    obs = spark.createDataFrame(
        [Row(**dict(zip(names, r, strict=True)), mpn_expected=r[1], **same) for r in rows],
        "observation_id string, mpn string, archived boolean, evidence_id string, source_url string, stock_state string, vat_state string, publication_allowed boolean, mpn_expected string, observed_at timestamp, "
        "seller_display_name string, seller_relationship string, amount_minor long, currency string, stock_text string, stock_semantics string, review_note string, identity_exact boolean, match_basis string",
    )
    ledger = spark.createDataFrame(
        [(f"e{i}", "s", u, at, 200, "0" * 64, 9, "m", 500, "GBP", v) for i, u, v in ((1, "https://www.s.example/p", True), (2, "https://www.s.example/q", False), (4, "https://x", True))],
        "evidence_id string, seller_display_name string, source_url string, retrieved_at timestamp, http_status int, response_sha256 string, response_bytes long, fact_mpn string, fact_amount_minor long, fact_currency string, fact_vat_included boolean",
    )
    retailers = spark.createDataFrame([("r", "R", "s", "www.s.example")], "retailer_id string, retailer_name string, accepted_name string, https_host string")
    return obs, spark.createDataFrame([("m",)], "mpn string"), ledger, retailers


def test_offers_are_judged_before_they_move(spark):
    obs, products, ledger, retailers = _offer_tables(spark)
    q = market.qualify_offer(obs, products, ledger, retailers)
    got = sorted((r["observation_id"], ",".join(r["reasons"]), r["facts_clear"]) for r in q.collect())
    clear, bad = ("o1", "", True), "availability_not_explicitly_orderable,source_url_contract_mismatch,record_authority_drift"
    assert got == [clear] * 4 + [("o2", "vat_not_explicitly_included", False), ("o4", bad, False), ("o5", "missing_evidence_ledger_entry", True)]
    # The ledger is read once for both kinds of row, and what a row's own facts refuse stays behind.
    offers = market.offer_candidates(q)
    plan = plan_of(offers)
    assert plan.count("hashpartitioning(key_a") == 2
    judged = plan.split("Exchange hashpartitioning(observation_id", 2)[1]
    assert any("Filter" in line and "size(" in line for line in judged.split("Exchange hashpartitioning(mpn", 1)[1].splitlines())
    assert [r["observation_id"] for r in offers.collect()] == ["o1"] * 4


def test_accepted_offers_go_to_their_evidence_themselves(spark):
    obs, products, ledger, retailers = _offer_tables(spark)
    # Neither archived nor live, or without id: no evidence to meet, as in the outcomes of all rows.
    loose = obs.where("observation_id = 'o5'")
    odd = [loose.withColumns({"observation_id": F.lit("o6"), "archived": F.lit(None).cast("boolean")}), loose.withColumn("observation_id", F.lit(None).cast("string"))]
    # Two entries; an entry with other facts.
    twin = loose.withColumns({"observation_id": F.lit("o7"), "source_url": F.lit("https://www.s.example/u")})
    dear = loose.withColumns({"observation_id": F.lit("o8"), "source_url": F.lit("https://www.s.example/v")})
    entry = ledger.where("evidence_id = 'e1'")
    held = [entry.withColumn("source_url", F.lit("https://www.s.example/u"))] * 2 + [entry.withColumns({"source_url": F.lit("https://www.s.example/v"), "fact_amount_minor": F.lit(501).cast("long")})]
    for more in [*odd, twin, dear]:
        obs = obs.unionByName(more)
    for more in held:
        ledger = ledger.unionByName(more)
    every = market.offer_candidates(market.qualify_offer(obs, products, ledger, retailers))
    accepted = market.offer_candidates(market.qualify_offer(obs, products, ledger, retailers, accepted_only=True))
    want = {tuple(r) for r in every.collect()}
    got = [tuple(r) for r in accepted.collect()]
    assert {r[-1] for r in got} == {"o1", "o6", None} and set(got) == want and len(got) == 4
    public = market.public_offers(accepted)
    assert sorted(map(str, public.collect())) == sorted(map(str, market.public_offers(every).collect()))
    # As planned, before sizes are known: no outcome meets its row again by id, and the fold uses the rows as they lie by product.
    plan = plan_of(market.public_offers(accepted))
    assert "hashpartitioning(observation_id" not in plan and "hashpartitioning(mpn" in plan and "retailer_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_entries_that_no_offer_asks_for_stay_behind(spark):
    obs, products, ledger, retailers = _offer_tables(spark)
    entry = ledger.where("evidence_id = 'e1'")
    idle = entry.crossJoin(spark.range(3000).select("id")).withColumns({"evidence_id": F.concat(F.lit("x"), "id"), "source_url": F.concat(F.lit("https://idle/"), "id")})
    many = ledger.unionByName(idle.drop("id"))
    few, all_entries = (market.offer_candidates(market.qualify_offer(obs, products, t, retailers, accepted_only=True)) for t in (ledger, many))
    assert sorted(map(str, all_entries.collect())) == sorted(map(str, few.collect())) and few.count() == 2
    # The entries are sieved before they are dealt out by key.
    dealt = [x.split("FileScan")[0] for x in plan_of(all_entries).split("Exchange hashpartitioning(key_a")[1:]]
    assert any("Filter" in line and "shiftrightunsigned" in line for part in dealt for line in part.splitlines())


def test_sieve_of_prints_lets_every_print_through(spark):
    prints = settle(spark.range(5000).select(F.xxhash64("id").alias("p")))
    sieve = PrintSieve(prints, "p")
    rows = spark.range(40000).select("id", F.xxhash64("id").alias("p"))
    passed = {r["id"] for r in rows.where(sieve.may_hold(F.col("p"))).collect()}
    assert set(range(5000)) <= passed and len(passed) < 5000 + 35000 // 10
    assert rows.where(PrintSieve(prints.limit(0), "p").may_hold(F.col("p"))).count() == 0
    assert rows.where(sieve.may_hold(F.lit(None).cast("long"))).count() == 0


def test_day_rows_are_written_once_for_their_folds(spark, root):
    from pricetrail.plans.market import daily

    points, products = daily(spark, root)
    assert all("retailer_name" not in plan_of(x) and "source_url" not in plan_of(x) and "observed_at" not in plan_of(x) for x in (points, products))


def test_reason_codes_are_compiled(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, b boolean")
    codes = df.select("i", reason_codes([("x", F.col("b")), ("y", F.col("i") > 1), ("x", F.col("i") == 2)]).alias("codes"))
    assert {r["i"]: r["codes"] for r in codes.collect()} == {1: [], 2: ["x", "y", "x"], 3: ["y"]}
    assert "lambda" not in plan_of(codes)


def test_sieve_lets_every_key_through(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)] + [(None,)], "k string")
    rows = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "v string")
    passed = {r["v"] for r in rows.where(may_be_in(F.col("v"), keys, "k")).collect()}
    assert {f"k{i}" for i in range(500)} <= passed and len(passed) < 520
    assert rows.where(may_be_in(F.col("v"), keys.limit(0), "k")).count() == 0


def test_the_ledger_meets_orders_before_texts_are_written(spark, root):
    plan = plan_of(evidence_ledger(spark, root))
    met = plan[plan.index("o_orderkey"):]
    assert "sha2" not in met and "web.archive.org" not in met and "sha2" in plan
