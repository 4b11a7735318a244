"""Observation views over the star schema.

`lineitem` is read as dated price observations, `supplier`/`nation`/`region` as
seller names at three levels, `orders` as the evidence ledger, `part` as the
product catalogue. Every derived value is a pure column expression, so scans
prune columns and joins keep their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.sources.tables import table

# Speeds written into part numbers.
SPEEDS = [4800, 5200, 5600, 6000, 6200, 6400, 6600, 7200, 7600, 8000]


def mpn_of(partkey: Column) -> Column:
    """Part number text of a part key; three spellings, two without a speed."""
    key = partkey.cast("string")
    slot = (partkey % 13).cast("int")
    speed = F.element_at(F.array(*[F.lit(str(s)) for s in SPEEDS]), slot + 1)
    return (
        F.when(slot < 10, F.concat(F.lit("KX-"), key, F.lit("-"), speed))
        .when(slot == 10, F.concat(F.lit("CT2K16G56C"), key))
        .otherwise(F.concat(F.lit("ZZ-"), key))
    )


def lines(spark: SparkSession, root: str, src: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Line items with short driver columns and the observation fields they give.

    `src` is the line items already joined with something, whose columns `keep` stay.
    """
    src = table(spark, root, "lineitem") if src is None else src
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long")
    minutes = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 131) % 1440
    at = F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + minutes * 60)
    return src.select(
        F.col("l_orderkey").alias("k_order"),
        F.col("l_partkey").alias("k_part"),
        F.col("l_suppkey").alias("k_supp"),
        F.col("l_linenumber").cast("long").alias("k_line"),
        F.col("l_quantity").cast("long").alias("k_qty"),
        F.col("l_tax").alias("k_tax"),
        F.col("l_discount").alias("k_disc"),
        F.concat_ws(
            "-",
            F.col("l_orderkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.date_format(F.col("l_shipdate"), "yyyyMMdd"),
            F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").cast("string"),
        ).alias("observation_id"),
        at.alias("observed_at"),
        mpn_of(F.col("l_partkey")).alias("mpn"),
        cents.alias("amount_minor"),
        F.lit("GBP").alias("currency"),
        F.when(F.col("l_returnflag") != "R", F.lit(True))
        .when(F.col("l_linestatus") == "O", F.lit(False))
        .alias("vat_included"),
        F.when(F.col("l_linestatus") == "F", F.lit("archive_capture"))
        .otherwise(F.lit("prospective_capture"))
        .alias("capture_kind"),
        *keep,
    )


def _seller_columns() -> list[Column]:
    return [
        F.col("s_name").alias("seller_observed"),
        F.col("n_name").alias("seller_fine"),
        F.col("r_name").alias("seller"),
        F.when(F.col("n_nationkey") % 5 != 4, F.concat(F.col("n_name"), F.lit(" Ltd"))).alias("seller_legal_name"),
    ]


def _with_sellers(rows: DataFrame, spark: SparkSession, root: str, key: str = "k_supp") -> DataFrame:
    """Join the seller dimensions one by one onto `rows`.

    Left-deep, so that each join sees one table whose size is known: a joined
    pair of dimensions is estimated at the product of both and would push the
    facts to the broadcast side.
    """
    supplier = table(spark, root, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, root, "nation")
    region = table(spark, root, "region")
    return (
        rows.join(supplier, F.col(key) == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def sellers(spark: SparkSession, root: str) -> DataFrame:
    """Supplier -> observed name, country-level seller, region-level seller."""
    keys = table(spark, root, "supplier").select(F.col("s_suppkey").alias("k_supp"))
    return _with_sellers(keys, spark, root).select("k_supp", *_seller_columns())


def observations(spark: SparkSession, root: str, src: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The flat observation table most operators start from; `src` (which may have its sellers) and `keep` as for `lines`."""
    if src is not None and "n_name" in src.columns:
        rows = lines(spark, root, src, (*keep, "s_name", "n_nationkey", "n_name", "r_name"))
        return rows.select(*[c for c in rows.columns if c not in ("s_name", "n_nationkey", "n_name", "r_name")], *_seller_columns())
    rows = lines(spark, root, src, keep)
    return _with_sellers(rows, spark, root).select(*rows.columns, *_seller_columns())


def retailer_key(name: Column) -> Column:
    return F.lower(F.translate(name, "_", "-"))


def landed_observations(spark: SparkSession, root: str) -> DataFrame:
    """Observations with identity, delivery and landed-price fields."""
    o = observations(spark, root)
    k, ln, q = F.col("k_part"), F.col("k_line"), F.col("k_qty")
    item = F.when((q == 50) & (ln == 2), F.lit(0)).otherwise(F.col("amount_minor")).cast("long")
    delivery_state = (
        F.when(F.col("k_tax") < 0.005, F.lit("free_delivery_explicit"))
        .when(F.col("k_tax") > 0.075, F.lit("unknown"))
        .otherwise(F.lit("mandatory_cost_known"))
    )
    delivery = (
        F.when(F.col("k_tax") < 0.005, F.when(ln == 7, F.lit(100)).otherwise(F.lit(0)))
        .when(F.col("k_tax") > 0.075, F.lit(None))
        .otherwise(F.floor(F.col("k_tax") * 10000 + 0.5))
        .cast("long")
    )
    eligible = F.col("k_disc") < 0.095
    landed = F.when(eligible, item + delivery + F.when((k % 97 == 0) & (ln == 1), F.lit(1)).otherwise(F.lit(0)))
    return o.select(
        "observation_id",
        "observed_at",
        "capture_kind",
        F.lower("mpn").alias("product_key"),
        F.col("mpn").alias("mpn_expected"),
        F.when((ln == 6) & (k % 11 == 0), F.lit(None))
        .when((ln == 5) & (k % 17 == 0), F.concat(F.col("mpn"), F.lit("X")))
        .otherwise(F.col("mpn"))
        .alias("mpn_observed"),
        F.when((ln == 6) & (k % 11 == 0), F.lit("unresolved")).otherwise(F.lit("exact_mpn")).alias("match_basis"),
        F.when((ln == 7) & (q > 45), F.lit("MARKETPLACE")).otherwise(F.lit("PRIMARY_RETAIL")).alias("channel"),
        retailer_key(F.col("seller_fine")).alias("retailer_key"),
        F.col("seller_fine").alias("retailer_name"),
        F.col("seller_legal_name"),
        F.when(k % 23 == 0, F.lit("third_party"))
        .when(k % 23 == 1, F.lit("unresolved"))
        .otherwise(F.lit("retailer_owned"))
        .alias("seller_relationship"),
        item.alias("item_price_minor"),
        F.when((ln == 7) & (q == 49), F.lit("EUR")).otherwise(F.lit("GBP")).alias("currency"),
        F.when(F.col("vat_included"), F.lit("included"))
        .when(~F.col("vat_included"), F.lit("excluded"))
        .otherwise(F.lit("unknown"))
        .alias("vat_state"),
        F.when((ln == 5) & (q < 10), F.lit("out_of_stock"))
        .when((ln == 6) & (q < 5), F.lit("unknown"))
        .otherwise(F.lit("in_stock"))
        .alias("availability"),
        delivery_state.alias("delivery_state"),
        delivery.alias("delivery_amount_minor"),
        F.when(eligible, F.lit("eligible")).otherwise(F.lit("unresolved")).alias("landed_eligibility"),
        landed.cast("long").alias("landed_price_minor"),
    )


def offer_observations(spark: SparkSession, root: str, src: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Observations with the seller, stock, source and review fields of an offer; `src` and `keep` as for `lines`."""
    o = observations(spark, root, src, keep)
    k, ln, q = F.col("k_part"), F.col("k_line"), F.col("k_qty")
    archived = F.col("capture_kind") == "archive_capture"
    host = F.concat(F.lit("www."), retailer_key(F.col("seller_fine")), F.lit(".example"))
    scheme = F.when((ln == 6) & (q < 10), F.lit("http://")).otherwise(F.lit("https://"))
    tail = F.when((ln == 7) & (q < 10), F.lit("?ref=x")).when((ln == 7) & (q < 20), F.lit("#top")).otherwise(F.lit(""))
    page = F.concat(scheme, host, F.lit("/p/"), F.lower("mpn"), tail)
    stamp = F.date_format("observed_at", "yyyyMMddHHmmss")
    url = F.when(archived, F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit("id_/"), page)).otherwise(page)
    return o.select(
        "observation_id",
        "observed_at",
        "capture_kind",
        archived.alias("archived"),
        F.col("mpn"),
        F.when((ln == 5) & (k % 17 == 0), F.concat(F.col("mpn"), F.lit("X"))).otherwise(F.col("mpn")).alias("mpn_expected"),
        F.col("mpn").alias("mpn_observed"),
        (k % 19 != 0).alias("identity_exact"),
        F.lit("exact_mpn").alias("match_basis"),
        F.col("seller_fine").alias("seller_display_name"),
        F.when(k % 23 == 0, F.lit("third_party")).otherwise(F.lit("retailer_owned")).alias("seller_relationship"),
        F.when((q == 50) & (ln == 1), F.lit(9999999)).otherwise(F.col("amount_minor")).cast("long").alias("amount_minor"),
        F.when((ln == 7) & (q == 49), F.lit("EUR")).otherwise(F.lit("GBP")).alias("currency"),
        F.when(F.col("vat_included"), F.lit("included"))
        .when(~F.col("vat_included"), F.lit("excluded"))
        .otherwise(F.lit("unknown"))
        .alias("vat_state"),
        F.when((ln == 4) & (q < 5), F.lit("available_to_order"))
        .when((ln == 5) & (q < 5), F.lit("out_of_stock"))
        .when(ln == 3, F.lit("stated_at_capture"))
        .otherwise(F.lit("in_stock"))
        .alias("stock_state"),
        F.when((ln == 3) & (q < 20), F.lit("Hurry, only 3 left"))
        .when((ln == 3) & (q < 25), F.lit("Available to order"))
        .when((ln == 3) & (q < 30), F.lit("call us"))
        .when((ln == 2) & (q < 4), F.lit("Sold out"))
        .otherwise(F.lit("In stock"))
        .alias("stock_text"),
        F.when((ln == 1) & (q == 7), F.lit("ambiguous")).otherwise(F.lit("explicit")).alias("stock_semantics"),
        url.alias("source_url"),
        F.concat(F.lit("ev-"), F.col("observation_id")).alias("evidence_id"),
        F.when((ln == 2) & (q == 9), F.lit("IDENTITY_MISMATCH_NOTED")).otherwise(F.lit("retained")).alias("review_note"),
        ((ln == 2) & (q == 11)).alias("publication_allowed"),
        F.col("k_order"),
        F.col("k_part"),
        *keep,
    )


def evidence_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One entry per retained capture; some missing, some doubled, some drifted.

    Line items meet their orders before ids and addresses are written out, so
    that only short columns move, and after their sellers, so that what is asked
    of ids and addresses is asked before anything moves.
    """
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    sold = _with_sellers(table(spark, root, "lineitem").where("l_partkey % 29 <> 0"), spark, root, "l_suppkey")
    retained = sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    o = offer_observations(spark, root, retained, ("o_orderstatus",))
    copies = F.when(F.col("k_part") % 31 == 0, F.lit(2)).otherwise(F.lit(1))
    return (
        o.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies)))
        .select(
            "evidence_id",
            "seller_display_name",
            "source_url",
            F.col("observed_at").alias("retrieved_at"),
            F.when(F.col("o_orderstatus") == "P", F.lit(404)).otherwise(F.lit(200)).alias("http_status"),
            F.sha2(F.col("evidence_id"), 256).alias("response_sha256"),
            F.length("source_url").cast("long").alias("response_bytes"),
            F.col("mpn").alias("fact_mpn"),
            F.when(F.col("k_part") % 37 == 0, F.col("amount_minor") + 1)
            .otherwise(F.col("amount_minor"))
            .alias("fact_amount_minor"),
            F.col("currency").alias("fact_currency"),
            (F.col("vat_state") == "included").alias("fact_vat_included"),
        )
    )


def retailers(spark: SparkSession, root: str) -> DataFrame:
    """Publication roster: most countries are known retailers, with one host each."""
    return (
        table(spark, root, "nation")
        .where("n_nationkey % 12 != 11")
        .select(
            retailer_key(F.col("n_name")).alias("retailer_id"),
            F.concat(F.lit("Retailer "), F.col("n_nationkey").cast("string")).alias("retailer_name"),
            F.col("n_name").alias("accepted_name"),
            F.concat(F.lit("www."), retailer_key(F.col("n_name")), F.lit(".example")).alias("https_host"),
        )
    )


def stated_offers(spark: SparkSession, root: str) -> DataFrame:
    """Offers with everything a row can state about itself, and rows that break each rule on it."""
    o, k = offer_observations(spark, root), F.col("k_part")
    direct = ~F.col("archived")
    url, key = F.col("source_url"), retailer_key(F.col("seller_display_name"))
    host = F.concat(F.lit("https://www."), key, F.lit(".example/"))
    told = (
        F.when(direct & (k % 97 == 0), F.replace(url, host, F.concat(F.lit("HTTPS://WWW."), F.upper(key), F.lit(".EXAMPLE:443/"))))
        .when(direct & (k % 97 == 1), F.replace(url, host, F.concat(F.lit("https://www."), key, F.lit(".example:8443/"))))
        .when(k % 7 == 0, F.replace(url, host, F.concat(F.lit("https://shop."), key, F.lit(".example/"))))
        .when(direct & (k % 97 == 2), F.replace(url, host, F.concat(F.lit("https://me@www."), key, F.lit(".example/")))).otherwise(url)
    )
    evidence = F.sha2("evidence_id", 256)
    return o.withColumn("source_url", told).withColumns({
        "created_at": F.col("observed_at") + F.when(k % 59 == 0, F.expr("INTERVAL -1 SECOND")).otherwise(F.expr("INTERVAL 86400 SECOND")),
        "source_class": F.when(direct, F.lit("primary_retail_storefront")).otherwise(F.lit("archived_primary_retail_storefront")),
        "seller_relationship": F.when(k % 61 != 0, F.col("seller_relationship")),
        "product_mpn": F.when(k % 67 == 0, F.concat("mpn", F.lit("P"))).otherwise(F.col("mpn")),
        "capacity_gb": F.when(k % 71 == 0, 16).otherwise(32), "module_count": F.when(k % 71 == 1, 1).when(k % 71 != 3, 2),
        "memory_type": F.when(k % 71 == 2, F.lit("DDR4")).otherwise(F.lit("DDR5")),
        "response_sha256": F.when(k % 79 == 0, F.sha2(F.lit("x"), 256)).when(k % 79 > 40, evidence),
        "response_bytes": F.when(k % 83 == 0, F.lit(1)).when(k % 83 > 40, F.length("source_url")).cast("long"),
        "archive_url": F.when(k % 89 == 0, F.concat("source_url", F.lit("x"))).when(k % 89 > 40, F.col("source_url")),
    })


def stated_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Entries of those offers with the kit's shape, the archive address and its capture time."""
    o, k = stated_offers(spark, root).where("k_part % 29 <> 0"), F.col("k_part")
    late = F.when(F.col("archived"), F.expr("INTERVAL 3 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    return o.select(
        "evidence_id", "seller_display_name", "source_url", (F.col("observed_at") + late).alias("retrieved_at"), F.lit(200).alias("http_status"),
        F.sha2("evidence_id", 256).alias("response_sha256"), F.length("source_url").cast("long").alias("response_bytes"),
        F.col("mpn").alias("fact_mpn"), F.col("amount_minor").alias("fact_amount_minor"), F.col("currency").alias("fact_currency"), (F.col("vat_state") == "included").alias("fact_vat_included"),
        F.when(k % 73 == 0, 16).when(k % 73 != 1, 32).alias("fact_capacity_gb"), F.when(k % 73 == 2, 4).otherwise(2).alias("fact_module_count"),
        F.col("source_url").alias("archive_url"), (F.col("observed_at") + F.when(k % 101 == 0, F.expr("INTERVAL 1 SECOND")).otherwise(F.expr("INTERVAL 0 SECOND"))).alias("archive_captured_at"),
    )


def stated_retailers(spark: SparkSession, root: str) -> DataFrame:
    """The roster with two hosts each, every third retailer accepted under a second name."""
    r = retailers(spark, root)
    names = F.when(F.length("accepted_name") % 3 == 0, F.array(F.col("accepted_name"), F.concat("accepted_name", F.lit(" Ltd")))).otherwise(F.array("accepted_name"))
    hosts = F.array("https_host", F.replace("https_host", F.lit("www."), F.lit("shop.")))
    return r.select("retailer_id", "retailer_name", F.explode(names).alias("accepted_name"), hosts.alias("https_hosts"))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue products with manufacturer, specification and review state."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, root, "part").select(
        F.concat(F.lit("part-"), k.cast("string")).alias("product_key"),
        F.lower(F.regexp_replace("p_brand", "#", "-")).alias("manufacturer_key"),
        F.col("p_brand").alias("manufacturer_name"),
        F.col("p_name").alias("model"),
        mpn_of(k).alias("mpn_raw"),
        mpn_of(k).alias("mpn_normalized"),
        F.lower("p_type").alias("family_key"),
        F.when(size == 49, F.lit("DDR4")).otherwise(F.lit("DDR5")).alias("memory_generation"),
        F.when(size == 50, F.lit(16)).otherwise(F.lit(32)).cast("long").alias("total_capacity_gb"),
        F.lit(2).cast("long").alias("module_count"),
        F.when(size == 48, F.lit("SODIMM")).otherwise(F.lit("UDIMM")).alias("form_factor"),
        F.lit(False).alias("ecc"),
        F.lit(False).alias("registered"),
        (4800 + (size % 8) * 400).cast("long").alias("speed_mt_s"),
        F.when(k % 3 == 0, F.lit("reviewed_fixture")).otherwise(F.lit("candidate_pending_review")).alias("review_status"),
        k.alias("k_part"),
        size.cast("long").alias("k_size"),
    )


def manufacturer_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Accepted spellings per manufacturer; one spelling is claimed twice."""
    brands = table(spark, root, "part").select(F.col("p_brand").alias("manufacturer_name")).distinct()
    key = F.lower(F.regexp_replace("manufacturer_name", "#", "-"))
    spellings = F.array(
        F.col("manufacturer_name"),
        F.upper("manufacturer_name"),
        F.regexp_replace("manufacturer_name", "Brand#", "The Brand "),
        F.when(key.isin("brand-3", "brand-4"), F.lit("Shared Brand")),
    )
    return brands.select(
        key.alias("manufacturer_key"), "manufacturer_name", F.explode(F.array_compact(spellings)).alias("alias")
    )


def listings(spark: SparkSession, root: str) -> DataFrame:
    """Marketplace listings to match: true, respelled, near, unknown and missing numbers."""
    # Line items meet their parts before ids and numbers are written out, so that only short columns move.
    part = table(spark, root, "part").select("p_partkey", "p_brand", "p_name")
    sold = table(spark, root, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    o = lines(spark, root, sold, ("p_brand", "p_name"))
    k, ln, q = F.col("k_part"), F.col("k_line"), F.col("k_qty")
    mpn = F.col("mpn")
    return o.select(
        F.col("observation_id").alias("listing_id"),
        F.concat(F.when((ln == 4) & (q % 2 == 1), F.lit("Choose 16GB or ")).otherwise(F.lit("Kit ")), F.col("p_name")).alias("title"),
        F.when((ln == 7) & (q % 2 == 0), F.lit("Brand#99"))
        .when(ln == 7, F.when(F.col("p_brand") == "Brand#1", F.lit("Brand#2")).otherwise(F.lit("Brand#1")))
        .otherwise(F.col("p_brand"))
        .alias("manufacturer_raw"),
        F.when(ln == 1, mpn)
        .when(ln == 2, F.concat(F.lit(" "), F.lower(mpn)))
        .when(ln == 3, F.concat(mpn, F.lit("Z")))
        .when(ln == 6, F.concat(F.lit("NOPE-"), F.col("k_order").cast("string")))
        .when(ln == 7, mpn)
        .alias("mpn_raw"),
        F.when(ln == 5, F.when(q % 3 == 0, F.lit("12AB")).when(q % 3 == 1, F.lit("5012345678900"))).alias("gtin_raw"),
        F.when(q == 1, F.lit("DDR4")).when(q < 20, F.lit("DDR5")).alias("memory_generation"),
        F.when(q == 2, F.lit("SODIMM")).alias("form_factor"),
        F.when(q == 3, F.lit(1)).when(q > 30, F.lit(2)).cast("long").alias("module_count"),
        F.when(q == 4, F.lit(16)).when(q > 40, F.lit(32)).cast("long").alias("total_capacity_gb"),
        F.when(q == 5, F.lit(True)).alias("ecc"),
    )
