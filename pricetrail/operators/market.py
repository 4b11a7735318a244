"""Publishable offers and the daily market built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions.money import grouped_median, half_up, mean_minor, median_by_rank
from pricetrail.functions.periods import london_date, month_label, month_of
from pricetrail.functions.reasons import duplicated, failed, reason_codes, stacked, violations
from pricetrail.functions.sieve import PrintSieve, may_be_in
from pricetrail.operators.qualify import check_source_url, classify_availability, hosts_of, match_evidence, restriction_reasons, with_evidence
from pricetrail.operators.series import contiguous_segments
from pricetrail.session import settle

OFFER_KEY = ["mpn", "retailer_id", "observed_at"]
OFFER_FACTS = [
    "observed_at", "observation_kind", "mpn", "retailer_id", "retailer_name", "item_price_minor",
    "currency", "vat_state", "availability", "delivery_state", "source_url",
]
# Columns of a row that are read of accepted rows only.
OFFER_TEXTS = ["retailer_id", "retailer_name", "amount_minor", "currency", "vat_state", "stock", "source_url"]
# Fixed value: the separator inside a content id.
UNIT = "\u001f"


def approved_products(catalogue: DataFrame, policy: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products the policy names, covered by the named review and inside the scope.

    `policy` is (mpn, review_id); `reviews` is (review_id, product_key), one row
    per covered product.
    """
    named = catalogue.join(policy, F.col("mpn_normalized") == F.col("mpn"))
    covered = named.join(reviews, ["review_id", "product_key"], "left_semi")
    scope = (
        (F.col("memory_generation") == "DDR5") & (F.col("total_capacity_gb") == 32)
        & (F.col("module_count") == 2) & (F.col("form_factor") == "UDIMM")
    )
    return covered.where(scope).select(
        "mpn", F.col("manufacturer_name").alias("manufacturer"), "model",
        F.col("memory_generation").alias("memory_type"), F.col("total_capacity_gb").alias("capacity_gb"),
        "module_count", "speed_mt_s", "form_factor",
    )


def check_approvals(catalogue: DataFrame, policy: DataFrame, reviews: DataFrame) -> DataFrame:
    """Policy entries without product, without review cover, out of scope, or doubled."""
    c = catalogue.select(
        F.col("mpn_normalized").alias("mpn"), "product_key", "memory_generation", "total_capacity_gb", "module_count", "form_factor"
    )
    r = reviews.withColumn("covered", F.lit(True))
    j = policy.join(c, "mpn", "left").join(r, ["review_id", "product_key"], "left")
    known = F.col("product_key").isNotNull()
    in_scope = (
        (F.col("memory_generation") == "DDR5") & (F.col("total_capacity_gb") == 32)
        & (F.col("module_count") == 2) & (F.col("form_factor") == "UDIMM")
    )
    return stacked(
        violations(j, F.col("mpn"), [
            ("approved_product_not_in_catalogue", ~known),
            ("approved_product_not_reviewed", known & F.col("covered").isNull()),
            ("approved_product_out_of_scope", known & failed(~in_scope)),
        ]),
        duplicated(policy, ["mpn"], "approved_product_doubled"),
    )


def with_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """The rows whose `mpn` is that of a product, without dealing the rows out by it.

    They pass a sieve of the products; the few numbers that pass it and are no
    product's are found, each once, and their rows dropped.
    """
    prints = settle(products.where("mpn IS NOT NULL").select(F.xxhash64("mpn").alias("print")))
    passed = rows.where(F.col("mpn").isNotNull() & PrintSieve(prints, "print").may_hold(F.xxhash64("mpn")))
    strays = settle(passed.select("mpn").distinct().join(products.select("mpn"), "mpn", "left_anti"))
    return passed.join(strays, "mpn", "left_anti")


def qualify_offer(obs: DataFrame, products: DataFrame, ledger: DataFrame, retailers: DataFrame, accepted_only: bool = False, slim: bool = False) -> DataFrame:
    """Publication predicates of rows whose product is approved.

    Products are picked twice: by a sieve of fixed size before anything is
    computed, and exactly once a row is judged by itself, so that outcomes and
    prints move instead of texts. Where `obs`
    has them, `created_at` (of the row's tranche) bounds its time, `product_mpn`
    is held against the number of an archived row, `mpn_observed` against that of
    a direct one, and `source_class` tells whether a row without a seller
    relationship comes from a primary retailer. `retailers` has a row per
    accepted name, with `https_hosts` or one `https_host`. `facts_clear` tells
    that a row gives no reason apart from its evidence.

    With `accepted_only`, the rows without any reason. What a row's own facts
    refuse stays behind, the others go to their evidence themselves, and only
    what that accepts is dealt out by product, where offers are folded next.
    Rows that share an id are then held each against its own evidence, and come
    once each.

    With `slim`, every row with its reasons, but only the columns of an offer,
    and these without those of OFFER_TEXTS where a row's own facts refuse it:
    nothing is published of such a row. Rows move once, by a print of their id, and
    reasons as bits.
    """
    seen = with_products(obs, products) if slim else obs.where(may_be_in(F.col("mpn"), products, "mpn"))
    named = seen.join(retailers, F.col("seller_display_name") == F.col("accepted_name"), "left").drop("accepted_name")
    availability = classify_availability(F.col("stock_state"), F.col("stock_text"), F.col("stock_semantics"))
    archived = F.col("archived")
    known_retailer = F.col("retailer_id").isNotNull()
    url_ok = check_source_url(F.col("source_url"), archived, F.col("observed_at"), hosts_of(retailers))
    has = set(obs.columns)
    archived_bad = failed(~F.col("identity_exact"))
    if "product_mpn" in has:
        archived_bad = archived_bad | failed(F.col("product_mpn") != F.col("mpn"))
    direct_bad = failed((F.col("match_basis") != "exact_mpn") | (F.col("mpn_expected") != F.col("mpn")))
    if "mpn_observed" in has:
        direct_bad = direct_bad | failed(F.col("mpn_observed") != F.col("mpn"))
    untimely = F.col("observed_at").isNull()
    if "created_at" in has:
        untimely = untimely | failed(F.col("observed_at") > F.col("created_at"))
    relationship = F.col("seller_relationship")
    if "source_class" in has:
        foreign = relationship.isNotNull() & (relationship != "retailer_owned")
        unproven = relationship.isNull() & failed(F.col("source_class") != "archived_primary_retail_storefront")
    else:
        foreign, unproven = failed(relationship != "retailer_owned"), F.lit(False)
    # What a row tells about itself is judged before it moves, so that only the outcome does.
    own_rules = [
        ("archived_identity_not_exact", archived & archived_bad),
        ("direct_identity_not_exact_mpn", ~archived & direct_bad),
        ("invalid_or_future_observed_at", untimely),
        ("invalid_item_price", failed(F.col("amount_minor") <= 0)),
        ("currency_not_gbp", failed(F.col("currency") != "GBP")),
        ("vat_not_explicitly_included", failed(F.col("vat_state") != "included")),
        ("availability_not_explicitly_orderable", F.col("stock").isNull()),
        ("retailer_not_recognised", ~known_retailer),
        ("seller_not_retailer_owned", foreign),
        ("primary_retail_relationship_not_established", unproven),
    ]
    own = reason_codes(own_rules)
    evidence = reason_codes([
        ("missing_evidence_ledger_entry", F.col("entry_count") == 0),
        ("ambiguous_evidence_ledger_entry", F.col("entry_count") > 1),
        ("evidence_facts_mismatch", F.coalesce(~F.col("facts_equal"), F.lit(False))),
    ])
    address = reason_codes([("source_url_contract_mismatch", known_retailer & ~url_ok)])
    restricted = restriction_reasons(["review_note", "stock_semantics"], ["publication_allowed"])
    judged = named.withColumn("stock", availability).withColumns({"_own": own, "_last": F.concat(address, restricted)}).withColumn(
        "facts_clear", F.size("_own") + F.size("_last") == 0
    )
    if accepted_only:
        clear = judged.where("facts_clear").drop("_own", "_last").withColumns({"facts_clear": F.lit(True), "reasons": F.array().cast("array<string>")})
        # Not a semi-join: Spark would move it below the evidence, and every clear row with it.
        # Rules on plain facts are enough to tell which entries may be asked for; what they let through beyond the clear rows is little.
        plain = reason_codes([rule for rule in own_rules if rule[0] != "availability_not_explicitly_orderable"])
        asking = named.where(F.size(plain) == 0)
        return with_evidence(obs, ledger, clear, asking).join(products.select("mpn").distinct(), "mpn")
    if slim:
        bits = sum((F.when(cond, 1 << i).otherwise(0) for i, (_, cond) in enumerate(own_rules)), F.lit(0))
        texts = [F.when(F.col("facts_clear"), F.col(c)).alias(c) for c in OFFER_TEXTS]
        rows = judged.select("observation_id", "mpn", "observed_at", "archived", *texts, "facts_clear", bits.alias("_bits"), "_last")
        # Two halves of a print, null where the id is.
        known = F.col("observation_id").isNotNull()
        print_of = F.when(known, F.struct(F.xxhash64("observation_id").alias("a"), F.xxhash64(F.lit("id"), "observation_id").alias("b")))
        outcomes = match_evidence(seen.withColumn("observation_id", print_of), ledger).withColumnRenamed("observation_id", "_print")
        told = reason_codes([(code, F.col("_bits").bitwiseAND(1 << i) != 0) for i, (code, _) in enumerate(own_rules)])
        bound = rows.join(outcomes, print_of == F.col("_print"), "left")
        return bound.withColumn("reasons", F.array_distinct(F.concat(told, evidence, "_last"))).drop("_bits", "_last", "_print", "entry_count", "facts_equal")
    mine = judged.join(products.select("mpn"), "mpn", "left_semi")
    bound = mine.join(match_evidence(seen, ledger, products), "observation_id", "left")
    return bound.withColumn("reasons", F.array_distinct(F.concat("_own", evidence, "_last"))).drop("_own", "_last")


def offer_candidates(qualified: DataFrame) -> DataFrame:
    """Accepted rows in published shape, with a content id over their facts.

    `facts_clear` follows from the empty reasons; stated on its own, Spark drops
    what a row's own facts refuse before the row moves to its evidence.
    """
    identity = F.concat_ws(
        UNIT, "mpn", "retailer_id", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.col("amount_minor").cast("string"), "currency", "source_url",
    )
    accepted = qualified.where("facts_clear") if "facts_clear" in qualified.columns else qualified
    return accepted.where(F.size("reasons") == 0).select(
        F.concat(F.lit("offer-"), F.substring(F.sha2(identity, 256), 1, 24)).alias("public_observation_id"),
        "observed_at",
        F.when(F.col("archived"), F.lit("archived_retail_observation")).otherwise(F.lit("direct_retail_observation")).alias("observation_kind"),
        "mpn", "retailer_id", "retailer_name",
        F.col("amount_minor").alias("item_price_minor"),
        "currency", "vat_state",
        F.col("stock").alias("availability"),
        F.lit("excluded_not_verified").alias("delivery_state"),
        "source_url",
        "observation_id",
    )


def _folded_keys(candidates: DataFrame) -> DataFrame:
    """One row per offer key: its smallest and largest fact set, kept row and size.

    A key is free of conflict when both ends are equal. Everything folds
    map-side, so a mass of copies of one offer, or of conflicts on one key,
    reaches the shuffle as one row per task.
    """
    rest = [c for c in ["public_observation_id", *OFFER_FACTS] if c not in OFFER_KEY]
    facts = F.struct(*rest)
    folded = candidates.groupBy(*OFFER_KEY).agg(
        F.min(facts).alias("facts"), F.max(facts).alias("other_facts"),
        F.min("observation_id").alias("kept_observation_id"), F.count(F.lit(1)).alias("row_count"),
    )
    return folded.withColumn("conflict", F.col("facts") != F.col("other_facts"))


def public_offers(candidates: DataFrame) -> DataFrame:
    """Identical duplicates keep one row; conflicting rows of a key all drop."""
    clean = _folded_keys(candidates).where(~F.col("conflict"))
    return clean.select(*OFFER_KEY, "facts.*").select("public_observation_id", *OFFER_FACTS)


def offer_exceptions(qualified: DataFrame, candidates: DataFrame) -> DataFrame:
    """Everything held back, with disposition and reasons."""
    refused = qualified.where(F.size("reasons") > 0).select(
        "observation_id", "mpn", "observed_at", F.lit("excluded_pending_review").alias("disposition"),
        F.array_join("reasons", ",").alias("reasons"),
    )
    crowded = _folded_keys(candidates).where("row_count > 1").select(*OFFER_KEY, "kept_observation_id", "conflict")
    conflict = F.col("conflict")
    held = candidates.join(crowded, OFFER_KEY).where(conflict | (F.col("observation_id") != F.col("kept_observation_id"))).select(
        "observation_id", "mpn", "observed_at",
        F.when(conflict, F.lit("excluded_conflicting_duplicate")).otherwise(F.lit("excluded_exact_duplicate")).alias("disposition"),
        F.when(conflict, F.lit("conflicting_same_retailer_timestamp")).otherwise(F.lit("duplicate_fact")).alias("reasons"),
    )
    return stacked(refused, held)


def assert_public_offers(offers: DataFrame, products: DataFrame, retailers: DataFrame) -> DataFrame:
    """Closed contract of the published table, integrity in both directions."""
    # One row per retailer, whatever the number of names it is accepted under.
    roster = retailers.select("retailer_id", F.col("retailer_name").alias("roster_name"), hosts_of(retailers).alias("hosts")).distinct()
    o = offers.join(roster, "retailer_id", "left").join(
        products.select("mpn", F.lit(True).alias("known_product")), "mpn", "left"
    )
    archived = F.col("observation_kind") == "archived_retail_observation"
    url_ok = check_source_url(F.col("source_url"), archived, F.col("observed_at"), F.col("hosts"))
    rows = violations(o, F.col("public_observation_id"), [
        ("id_shape", failed(~F.col("public_observation_id").rlike("^offer-[0-9a-f]{24}$"))),
        ("product_unknown", F.col("known_product").isNull()),
        ("retailer_unknown", F.col("roster_name").isNull()),
        ("retailer_name_differs", F.col("roster_name").isNotNull() & (F.col("roster_name") != F.col("retailer_name"))),
        ("price_basis", failed((F.col("item_price_minor") <= 0) | (F.col("currency") != "GBP")
                               | (F.col("vat_state") != "included") | (F.col("delivery_state") != "excluded_not_verified"))),
        ("availability", failed(~F.col("availability").isin("in_stock", "available_to_order"))),
        ("kind", failed(~F.col("observation_kind").isin("archived_retail_observation", "direct_retail_observation"))),
        ("url_kind", ~url_ok),
    ])
    unused = products.join(offers, "mpn", "left_anti").select(
        F.lit("product_without_offer").alias("rule"), F.col("mpn").alias("key"), F.lit("").alias("detail")
    )
    silent = retailers.select("retailer_id").distinct().join(offers, "retailer_id", "left_anti").select(
        F.lit("retailer_without_offer").alias("rule"), F.col("retailer_id").alias("key"), F.lit("").alias("detail")
    )
    return stacked(
        rows, unused, silent,
        duplicated(offers, ["public_observation_id"], "id_not_unique"),
        duplicated(offers, ["mpn", "retailer_id", "observed_at"], "key_not_unique"),
    )


def release_counts(offers: DataFrame) -> DataFrame:
    per = offers.groupBy("mpn", "retailer_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi")
    )
    return per.agg(
        F.sum("n").alias("observation_count"), F.count_distinct("mpn").alias("product_count"),
        F.count_distinct("retailer_id").alias("retailer_count"), F.min("lo").alias("oldest_at"), F.max("hi").alias("latest_at"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by the ordering columns, folded map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, "last.*")


def latest_offers(offers: DataFrame) -> DataFrame:
    """Most recent offer of every product."""
    return latest_per_key(offers, ["mpn"], ["observed_at", "retailer_id", "item_price_minor", "source_url"])


def offer_history(offers: DataFrame, mpn: str) -> DataFrame:
    return offers.where(F.col("mpn") == mpn).orderBy("observed_at", "retailer_id")


def daily_offers(offers: DataFrame, sentinels: list[int]) -> DataFrame:
    """The day's last in-stock offer per (London date, product, retailer)."""
    kept = offers.where((F.col("availability") == "in_stock") & ~F.col("item_price_minor").isin(sentinels))
    rows = kept.select(
        london_date(F.col("observed_at")).alias("date"), "mpn", "retailer_id", "observed_at",
        "public_observation_id", "item_price_minor", "observation_kind",
    )
    return latest_per_key(rows, ["date", "mpn", "retailer_id"], ["observed_at", "public_observation_id"])


def daily_products(day_rows: DataFrame) -> DataFrame:
    """Median, low, high and retailers of each product on each day."""
    keys = ["date", "mpn"]
    counted = day_rows.groupBy(*keys, "item_price_minor").agg(F.count(F.lit(1)).alias("n"))
    return median_by_rank(
        counted, keys, "item_price_minor", "n", "median_minor",
        F.min("item_price_minor").alias("low_minor"),
        F.max("item_price_minor").alias("high_minor"),
        F.sum("n").alias("retailer_count"),
    )


def daily_market(day_rows: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per day: typical is the median of product medians."""
    products = daily_products(day_rows)
    typical = grouped_median(products, ["date"], "median_minor", "typical_minor")
    spread = products.groupBy("date").agg(
        F.min("low_minor").alias("low_minor"), F.max("high_minor").alias("high_minor"),
        F.count(F.lit(1)).alias("product_count"), F.sum("retailer_count").alias("observation_count"),
    )
    sellers = day_rows.groupBy("date", "retailer_id").agg(
        F.bool_or(F.col("observation_kind") == "direct_retail_observation").alias("direct"),
        F.bool_or(F.col("observation_kind") != "direct_retail_observation").alias("archive"),
    ).groupBy("date").agg(
        F.count(F.lit(1)).alias("retailer_count"), F.bool_or("direct").alias("direct"), F.bool_or("archive").alias("archive")
    )
    total = declared.agg(F.count_distinct("mpn")).scalar()
    basis = F.when(F.col("direct") & F.col("archive"), F.lit("mixed")).when(F.col("direct"), F.lit("direct")).otherwise(F.lit("archive"))
    return typical.join(spread, "date").join(sellers, "date").select(
        "date", "typical_minor", "low_minor", "high_minor", "product_count",
        total.alias("declared_product_count"), "retailer_count", "observation_count",
        F.floor(F.col("product_count") * 1000 / total).cast("long").alias("coverage_permille"),
        basis.alias("capture_basis"),
    )


def daily_evidence(day_rows: DataFrame) -> DataFrame:
    """Offers standing at the day's low or high price, as rows."""
    ends = day_rows.groupBy("date").agg(F.min("item_price_minor").alias("low"), F.max("item_price_minor").alias("high"))
    rows = day_rows.join(ends, "date")
    sides = F.array_compact(F.array(
        F.when(F.col("item_price_minor") == F.col("low"), F.lit("low")),
        F.when(F.col("item_price_minor") == F.col("high"), F.lit("high")),
    ))
    return rows.select("date", F.explode(sides).alias("side"), "public_observation_id", "mpn", "retailer_id", "item_price_minor", "observed_at")


def range_start(latest: Column, range_name: str) -> Column:
    """First day of a named range. Month steps clamp to the month's last day."""
    return {
        "7D": F.date_sub(latest, 6),
        "30D": F.date_sub(latest, 29),
        "3M": F.add_months(latest, -3),
        "1Y": F.add_months(latest, -12),
        "ALL": F.lit("0001-01-01").cast("date"),
    }[range_name]


def range_points(points: DataFrame, range_name: str) -> DataFrame:
    """Days of a range anchored on the latest day present.

    `points` is one row per calendar day, so the unpartitioned window is small
    and spares a second run of everything behind the table.
    """
    anchored = points.withColumn("latest_date", F.max("date").over(Window.partitionBy()))
    return anchored.where(F.col("date") >= range_start(F.col("latest_date"), range_name)).drop("latest_date")


def monthly_average(points: DataFrame, products: DataFrame) -> DataFrame:
    """Mean of daily typical prices per month with the products behind it."""
    days = points.groupBy(month_of(F.col("date")).alias("month")).agg(
        F.max("date").alias("date"), mean_minor("typical_minor").alias("typical_minor"),
        F.count(F.lit(1)).alias("daily_point_count"), F.max("declared_product_count").alias("declared_product_count"),
    )
    named = products.join(points.select("date"), "date", "left_semi").select(month_of(F.col("date")).alias("month"), "mpn").distinct()
    return days.join(named.groupBy("month").agg(F.count(F.lit(1)).alias("product_count")), "month").select(
        month_label(F.col("month")).alias("month"), "date", "typical_minor", "daily_point_count", "product_count", "declared_product_count"
    )


def range_view(points: DataFrame, products: DataFrame, range_name: str) -> DataFrame:
    """Daily rows for short ranges, monthly averages for long ones."""
    chosen = range_points(points, range_name)
    if range_name in ("7D", "30D"):
        return chosen.select(F.col("date").cast("string").alias("label"), "typical_minor", "product_count")
    return monthly_average(chosen, products).select(F.col("month").alias("label"), "typical_minor", "product_count")


def first_direct_day(points: DataFrame) -> DataFrame:
    return points.agg(F.min(F.when(F.col("capture_basis").isin("direct", "mixed"), F.col("date"))).alias("first_direct_date"))


def day_segments(points: DataFrame) -> DataFrame:
    """Islands of consecutive days of the whole market."""
    return contiguous_segments(points.withColumn("market", F.lit("all")), ["market"], "date", "day")


def previous_day_change(points: DataFrame, products: DataFrame) -> DataFrame:
    """Permille against the day before; null unless adjacent with the same products.

    Product sets are compared by counting shared products of adjacent days, so
    no day's product list is ever gathered.
    """
    carried = products.select("mpn", F.date_add("date", 1).alias("date")).join(products.select("date", "mpn"), ["date", "mpn"])
    shared = carried.groupBy("date").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.orderBy("date")
    rows = points.select(
        "date", "typical_minor", "product_count",
        F.lag("date").over(w).alias("previous_date"),
        F.lag("typical_minor").over(w).alias("previous_minor"),
        F.lag("product_count").over(w).alias("previous_count"),
    ).join(shared, "date", "left")
    adjacent = F.col("previous_date") == F.date_sub("date", 1)
    same = (F.col("shared") == F.col("product_count")) & (F.col("shared") == F.col("previous_count"))
    change = half_up((F.col("typical_minor") - F.col("previous_minor")).cast("double") * 1000 / F.col("previous_minor"))
    return rows.select("date", F.when(adjacent & same, change).alias("change_permille"))


def validate_daily(points: DataFrame, evidence: DataFrame, offers: DataFrame, sentinels: list[int]) -> DataFrame:
    """Bounds, coverage and evidence of the daily table against the published offers."""
    bounds = violations(points, F.col("date"), [
        ("price_bounds", ~((F.col("low_minor") <= F.col("typical_minor")) & (F.col("typical_minor") <= F.col("high_minor")))),
        ("coverage", F.col("product_count") > F.col("declared_product_count")),
    ])
    source = offers.select(
        "public_observation_id", F.col("item_price_minor").alias("p"), F.col("mpn").alias("m"),
        F.col("retailer_id").alias("r"), F.col("observed_at").alias("t"),
    )
    traced = evidence.join(source, "public_observation_id", "left")
    drift = (F.col("item_price_minor") != F.col("p")) | (F.col("mpn") != F.col("m")) | (F.col("retailer_id") != F.col("r")) | (F.col("observed_at") != F.col("t"))
    proof = violations(traced, F.col("public_observation_id"), [
        ("evidence_not_published", F.col("p").isNull()),
        ("evidence_drifted", F.coalesce(drift, F.lit(False))),
        ("sentinel_evidence", F.col("item_price_minor").isin(sentinels)),
    ])
    return stacked(bounds, proof, duplicated(points, ["date"], "date_not_unique"))
