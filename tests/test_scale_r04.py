"""Steps that moved more than they had to on large tables, each on rows built here."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from pricetrail.operators import catalogue, market, publish
from tests.helpers import rows
from tests.test_scale_r03 import _offer_tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def distance(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def numbers_of(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("A0é😀") for _ in range(rng.randint(0, 6))) for _ in range(120)})
    return words[::2], words[1::2] + words[:8]


def test_near_numbers_move_without_their_texts(spark):
    listed, held = numbers_of(3)
    listings = spark.createDataFrame([("m", w) for w in listed] + [(None, "A0"), ("n", None), ("x", "A0"), ("m", "A" * 4200)], "manufacturer_key string, mpn_key string")
    products = spark.createDataFrame([("m", w, f"p-{w}") for w in held] + [("n", None, "p"), (None, "A0", "q"), ("m", "A0", None)], "manufacturer_key string, mpn_normalized string, product_key string")
    near = catalogue.near_mpn(listings, products)
    join = next(line for line in plan_of(near).splitlines() if "SortMergeJoin" in line and "variant" in line)
    assert "mpn" not in join and "number" not in join
    want = {("m", a, b, p, distance(a, b)) for a in listed for b, p in [*((w, f"p-{w}") for w in held), ("A0", None)] if 1 <= distance(a, b) <= 2}
    assert sorted(map(str, near.collect())) == sorted(str(r) for r in near.collect())
    got = [tuple(r) for r in near.collect()]
    assert set(got) == want and len(got) == len(want)


def test_long_numbers_are_near_at_any_place(spark):
    """Places beyond those a variant can tell apart are counted in rounds."""
    rng = random.Random(5)
    text = "".join(rng.choice("ABCDEFGH") for _ in range(70))
    changed = [text[:i] + "x" + text[i + 1:j] + "y" * k + text[j + 1:] for i, j in itertools.combinations((0, 9, 20, 21, 69), 2) for k in (0, 1, 2)]
    full, catalogue.PLACES = catalogue.PLACES, 7
    try:
        numbers = spark.createDataFrame([(i, "m", t) for i, t in enumerate([text, *changed])], "id long, manufacturer_key string, number string")
        met = catalogue._met(numbers.where("id > 0"), numbers.where("id = 0")).collect()
    finally:
        catalogue.PLACES = full
    near = {i for i, t in enumerate(changed, 1) if distance(t, text) <= 2}
    assert near <= {r["wanted_id"] for r in met} and len(near) > 15


def test_matching_deals_out_no_titles_and_no_missing_numbers_together(spark):
    listed, held = numbers_of(4)
    products = spark.createDataFrame([("acme", w, f"p-{w}", True) for w in held] + [("acme", "A0", None, True), ("acme", "A0", "again", True)], "manufacturer_key string, mpn_normalized string, product_key string, ecc boolean")
    aliases = spark.createDataFrame([("acme", "Acme"), ("zen", "Zen")], "manufacturer_key string, alias string")
    data = [(f"l{i}", "a title", m, w, None, None) for i, (m, w) in enumerate(itertools.product(("acme", "zen", "who"), [*listed, None]))]
    listings = spark.createDataFrame(data, "listing_id string, title string, manufacturer_raw string, mpn_raw string, gtin_raw string, ecc boolean")
    done = catalogue.match_listings(listings, products, aliases)
    exchanges = [line for line in plan_of(done).splitlines() if "Exchange hashpartitioning" in line]
    assert any("lies" in line for line in exchanges) and not any("title" in line for line in exchanges)
    upper = {w.strip().upper() for w in held}
    reasons = {r["listing_id"]: r["reason_code"] for r in done.collect()}
    for id_, _, m, w, *_ in data:
        if w is not None and m == "acme" and w.upper() not in held and not (w.upper() in upper):
            near = any(1 <= distance(w.upper(), h) <= 2 for h in held)
            assert reasons[id_] == ("near_mpn_only" if near else "no_catalogue_product"), w


def test_labels_meet_matches_by_one_shuffle_of_each(spark):
    matches = spark.createDataFrame([("a", "match", "exact_mpn"), ("b", "no_match", "x"), ("b", "match", "y"), (None, "match", "z")], "listing_id string, decision string, reason_code string")
    labels = spark.createDataFrame([("a", "match", "exact_mpn", True), ("b", "match", "y", True), (None, "match", "z", False), ("c", "match", "q", True)], "listing_id string, decision string, reason_code string, index_eligible boolean")
    found = rows(catalogue.check_labels(matches, labels, ["match", "never"]), "rule", "key", "detail")
    assert found == sorted([
        ("decision_never_covered", "never", ""), ("label_not_supported", "b", "no_match/x"), ("label_not_supported", None, ""), ("label_not_supported", "c", ""),
    ], key=lambda r: tuple((v is None, str(v)) for v in r))
    # Prints of the ids are what both are dealt out by.
    plan = plan_of(catalogue.check_labels(matches, labels, ["match"]).hint("merge"))
    assert "xxhash64(listing_id" in plan


def test_pieces_of_texts_that_are_hashed_together(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    tokens = ["a", "é", "ab", "é a", "ab a", "x" * 70, "bbabbabbabb", *(t[5:5 + n] for n, t in zip((1, 3, 8, 9, 17, 33, 40, 64, 65, 70), texts)), texts[11][-3:] + texts[12][:3], ""]
    data = [None, *texts, "y" * 300_000 + "x" * 70, "", None]
    held = spark.createDataFrame(list(enumerate(data)), "text_id long, text string").coalesce(1)
    found = publish.leak_scan(held, spark.createDataFrame([(t,) for t in tokens], "token string").coalesce(1))
    want = sorted((i, t) for i, x in enumerate(data) if x for t in set(tokens) if t and t in x)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_few_pieces_pass_beside_those_of_tokens(spark):
    tokens = spark.createDataFrame([("the price of the kit was seen by everyone who had asked",)], "token string")
    sieve, sizes = publish._sieve(publish._anchors(tokens))
    assert sizes == [32]
    near = [b"the price of the kit was not seen by anyone who had asked for the price of the kit"] * 50
    assert list(publish._passing(near, sieve, sizes)) == []


def test_rows_of_offers_move_slim(spark):
    obs, products, ledger, retailers = _offer_tables(spark)
    loose = obs.where("observation_id = 'o5'")
    odd = [loose.withColumns({"observation_id": F.lit("o6"), "archived": F.lit(None).cast("boolean")}), loose.withColumn("observation_id", F.lit(None).cast("string")), loose.withColumn("mpn", F.lit(None).cast("string"))]
    for more in odd:
        obs = obs.unionByName(more)
    every, slim = market.qualify_offer(obs, products, ledger, retailers), market.qualify_offer(obs, products, ledger, retailers, slim=True)
    told = ["observation_id", "mpn", "observed_at", F.array_join("reasons", ",").alias("reasons"), "facts_clear"]
    assert rows(slim, *told) == rows(every, *told) and slim.count() == 9
    assert rows(market.offer_candidates(slim)) == rows(market.offer_candidates(every))
    # Not even twice the same mpn: held back rows keep none of an offer's texts, and none is dealt out by product.
    assert {r["source_url"] for r in slim.collect() if not r["facts_clear"]} == {None}
    dealt = [x for x in plan_of(slim).splitlines() if "Exchange hashpartitioning" in x]
    assert not any("hashpartitioning(mpn" in x or "hashpartitioning(observation_id" in x for x in dealt)


def test_products_are_picked_exactly_without_dealing_rows_out(spark):
    products = spark.createDataFrame([(f"k{i}",) for i in range(9000)] + [(None,)], "mpn string")
    seen = spark.range(200_000).select(F.when(F.col("id") != 7, F.concat(F.lit("k"), "id")).alias("mpn"))
    kept = market.with_products(seen, products)
    assert "hashpartitioning(mpn" not in plan_of(kept)
    assert sorted(r["mpn"] for r in kept.collect()) == sorted(f"k{i}" for i in range(9000) if i != 7)
