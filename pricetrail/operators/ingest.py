"""From batch files, captured pages and readings to observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.money import half_up
from pricetrail.functions.periods import valid_instant
from pricetrail.functions.reasons import duplicated, failed, first_reason, reason_codes, stacked, violations
from pricetrail.functions.text import normalise_mpn, pounds_to_minor, slug, strip_markup


def discover_prospective(tranches: DataFrame) -> DataFrame:
    """Batches whose content says prospective retail, oldest first."""
    return tranches.where("schema_version = 1 AND tranche_scope = 'candidate_only' AND channel = 'PRIMARY_RETAIL'").orderBy(
        "created_at", "source_file"
    )


def _tax_basis(state: Column) -> Column:
    return F.when(state == "included", F.lit(True)).when(state == "excluded", F.lit(False))


def normalise_observations(raw: DataFrame) -> DataFrame:
    """Both nested shapes as one flat row, with the rules it fails in `reasons`."""
    archive = F.col("price").isNotNull()
    live = ~archive & F.col("item_price").isNotNull()
    mpn = F.when(archive, F.col("product.mpn")).when(live, F.col("identity.mpn_observed"))
    amount = F.when(archive, F.col("price.item_price_minor")).when(live, F.col("item_price.amount_minor"))
    currency = F.when(archive, F.col("price.currency")).when(live, F.col("item_price.currency"))
    vat = F.when(archive, F.col("price.vat_included")).when(live, _tax_basis(F.col("item_price.vat_state")))

    def blank(c: Column) -> Column:
        return failed(F.length(F.trim(c)) == 0)

    reasons = reason_codes([
        ("observation_id_blank", blank(F.col("observation_id"))),
        ("capture_kind_unknown", failed(~F.col("capture_kind").isin("archive_capture", "prospective_capture"))),
        ("schema_unrecognised", ~archive & ~live),
        ("capacity_out_of_scope", archive & failed(F.col("product.capacity_gb") != 32)),
        ("module_count_out_of_scope", archive & failed(F.col("product.module_count") != 2)),
        ("memory_type_out_of_scope", archive & failed(F.col("product.memory_type") != "DDR5")),
        ("identity_not_exact", archive & failed(~F.col("eligibility.identity_exact"))),
        ("observed_at_not_instant", ~valid_instant(F.col("observed_at"))),
        ("mpn_blank", blank(mpn)),
        ("amount_not_positive", failed(amount <= 0)),
        ("currency_not_gbp", failed(currency != "GBP")),
        ("seller_blank", blank(F.col("seller.display_name"))),
    ])
    return raw.select(
        "observation_id",
        F.try_to_timestamp("observed_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("observed_at"),
        normalise_mpn(mpn).alias("mpn"),
        F.col("seller.display_name").alias("seller_display_name"),
        F.col("seller.legal_name").alias("seller_legal_name"),
        amount.alias("amount_minor"), currency.alias("currency"), vat.alias("vat_included"),
        "capture_kind", "source_file", reasons.alias("reasons"),
    )


def observation_facts(raw: DataFrame) -> DataFrame:
    """Looser view: first stated value of each fact, nothing rejected."""
    flag = F.col("price.vat_included")
    return raw.select(
        "observation_id",
        F.coalesce("identity.mpn_observed", "product.mpn").alias("mpn"),
        F.coalesce("item_price.amount_minor", "price.item_price_minor").alias("amount_minor"),
        F.coalesce("item_price.currency", "price.currency").alias("currency"),
        F.coalesce(
            F.col("item_price.vat_state"),
            F.when(flag, F.lit("included")).when(~flag, F.lit("excluded")).otherwise(F.lit("unknown")),
        ).alias("vat_state"),
        F.col("seller.display_name").alias("seller_display_name"),
        "observed_at",
    )


def classify_inputs(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file classified exactly once and in agreement with its content."""
    said = ("sha256", "schema_version", "channel", "capture_kind", "decision", "reason")
    # Of a doubled path, which is reported as such, the least entry is compared.
    folded = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("entries"), F.min(F.struct(*said)).alias("said")).select(
        "path", "entries", *[F.col(f"said.{c}").alias(f"said_{c}") for c in said]
    )
    j = files.join(folded, "path", "full")
    there = F.col("sha256").isNotNull() & F.col("entries").isNotNull()
    included = there & (F.col("said_decision") == "included_private_candidate")
    kind = F.when(F.col("file_scope") == "candidate_only_historical_backfill", F.lit("archive_capture")).when(
        F.col("file_scope") == "candidate_only", F.lit("prospective_capture")
    )
    channel = F.coalesce(
        F.col("file_channel"),
        F.when(F.col("all_archived_primary_retail"), F.lit("PRIMARY_RETAIL")).when(
            (F.col("file_scope") == "candidate_only_historical_backfill") & F.col("all_archived"), F.lit("MIXED_ARCHIVE_STOREFRONT")
        ),
    )
    return violations(j, F.col("path"), [
        ("file_not_classified", F.col("entries").isNull()),
        ("classified_file_missing", F.col("sha256").isNull()),
        ("classified_more_than_once", F.coalesce(F.col("entries") > 1, F.lit(False))),
        ("decision_unknown", there & failed(~F.col("said_decision").isin("included_private_candidate", "excluded_private_candidate"))),
        ("reason_blank", there & failed(F.length(F.trim("said_reason")) == 0)),
        ("hash_mismatch", there & failed(F.col("sha256") != F.col("said_sha256"))),
        ("schema_version_mismatch", included & ~F.col("said_schema_version").eqNullSafe(F.col("file_schema_version"))),
        ("capture_kind_mismatch", included & failed(F.col("said_capture_kind") != kind)),
        ("channel_mismatch", included & failed(F.col("said_channel") != channel)),
    ])


def included_inputs(manifest: DataFrame) -> DataFrame:
    return manifest.where("decision = 'included_private_candidate'").select("path", "capture_kind")


def append_classification(manifest: DataFrame, new_files: DataFrame) -> DataFrame:
    """Files not yet classified join the manifest as excluded."""
    fresh = new_files.join(manifest.select("path"), "path", "left_anti").where(
        "file_schema_version = 1 AND file_scope = 'candidate_only' AND file_channel = 'PRIMARY_RETAIL'"
    )
    rows = fresh.select(
        "path", "sha256", F.col("file_schema_version").alias("schema_version"), F.col("file_channel").alias("channel"),
        F.lit("prospective_capture").alias("capture_kind"), F.lit("excluded_private_candidate").alias("decision"),
        F.lit("Kept as evidence; not part of this calculation until reviewed.").alias("reason"),
    )
    return manifest.select(*rows.columns).unionByName(rows)


def already_classified(manifest: DataFrame, new_files: DataFrame) -> DataFrame:
    return new_files.join(manifest.select("path"), "path", "left_semi").select(
        F.lit("already_classified").alias("rule"), F.col("path").alias("key"), F.lit("").alias("detail")
    )


def reissue_schema(archive: DataFrame, ledger: DataFrame, legal_names: DataFrame) -> DataFrame:
    """Archive-shaped rows in the live shape, addresses and digests from the ledger.

    Rows whose evidence entry is missing come out with `missing_evidence` set.
    """
    entry = ledger.select(
        "evidence_id", F.col("source_url").alias("entry_url"), "http_status", F.col("response_sha256").alias("entry_sha256"),
        F.col("response_bytes").alias("entry_bytes"), F.lit(True).alias("has_entry"),
    )
    j = archive.join(entry, "evidence_id", "left").join(legal_names, "seller_display_name", "left")
    stock = F.col("stock_text")
    reasons = F.array_compact(F.array(
        F.lit("delivery_not_read_by_collector"), F.when(F.col("legal_name").isNull(), F.lit("seller_legal_name_unresolved"))
    ))
    at = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return j.select(
        F.concat_ws("-", slug(F.col("seller_display_name")), F.lower("mpn"), F.lower(at)).alias("observation_id"),
        at.alias("observed_at"), F.lower("mpn").alias("product_key"),
        F.struct(
            F.concat(slug(F.col("seller_display_name")), F.lit("-uk-public-page")).alias("source_key"),
            F.col("entry_url").alias("source_url"), F.concat(F.lit("http_"), F.col("http_status").cast("string")).alias("supplied_url_status"),
        ).alias("source"),
        F.struct(F.col("mpn").alias("mpn_expected"), F.col("mpn").alias("mpn_observed"), F.lit("exact_mpn").alias("match_basis")).alias("identity"),
        F.struct(
            F.col("seller_display_name").alias("display_name"), "legal_name",
            F.when(F.col("legal_name").isNotNull(), F.lit("established_from_prior_retained_extract"))
            .otherwise(F.lit("not_established_from_retained_extract")).alias("legal_name_state"),
            F.lit("retailer_owned").alias("relationship"),
        ).alias("seller"),
        F.struct("amount_minor", "currency", F.lit("included").alias("vat_state")).alias("item_price"),
        F.struct(
            F.when(stock == "In stock", F.lit("in_stock")).when(F.length(stock) > 0, F.lit("other")).otherwise(F.lit("unknown")).alias("normalised"),
            F.when(F.length(stock) > 0, F.lit("explicit")).otherwise(F.lit("unknown")).alias("eligibility_semantics"),
        ).alias("availability"),
        F.struct(F.lit("candidate_retained_not_landed_price_eligible").alias("status"), reasons.alias("reasons")).alias("qualification"),
        F.struct(F.col("entry_sha256").alias("response_sha256"), F.col("entry_bytes").alias("response_bytes")).alias("evidence"),
        F.col("has_entry").isNull().alias("missing_evidence"),
    )


@dataclass(frozen=True)
class SiteRules:
    """Where one site states its facts. Patterns capture the fact in group 1.

    `price` is met inside the start tag of the element that holds the price, and
    captures nothing.
    """

    site: str
    title: str
    mpn: str
    price: str
    tax_included: str
    tax_excluded: str
    in_stock: str
    out_of_stock: str
    structured_mpn: str | None = None
    structured_price: str | None = None
    discontinued: str | None = None


KIT = r"(?i)\b32\s*GB\b[^()\d]{0,12}\(?\s*(?:2\s*x\s*16\s*GB|16\s*GB\s*x\s*2)\s*\)?"


def inside_element(rest: Column, tag: Column) -> Column:
    """What stands between a start tag and its own end tag, elements of the same name inside included.

    `rest` is the page behind the start tag. An element that never ends is empty.
    """
    pieces = F.split(rest, F.concat(F.lit("(?i)</"), tag, F.lit(r"\s*>")))
    ended = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = F.struct(F.lit(1).alias("open"), F.lit("").alias("text"))

    def step(s: Column, piece: Column) -> Column:
        here = s["open"] + F.regexp_count(piece, F.concat(F.lit("(?i)<"), tag, F.lit(r"\b"))) - 1
        return F.when(s["open"] == 0, s).otherwise(F.struct(here.alias("open"), F.concat(s["text"], F.lit(" "), piece).alias("text")))

    done = F.aggregate(ended, start, step)
    return F.when(done["open"] == 0, done["text"]).otherwise(F.lit(""))


def extract_page_facts(pages: DataFrame, rules: list[SiteRules]) -> DataFrame:
    """Title, number, price, tax label, stock and reason codes of captured pages.

    `pages` carries (page_id, site, url, html). Each site's patterns are
    literals in its own branch, so they compile once and stay in the JVM. Price
    and tax label are read inside the element the site's rule names, however
    long it is, and nowhere else: a delivery charge or another product's price
    elsewhere on the page is never taken for it.
    """
    html = F.col("html")

    def by_site(make) -> Column:
        chain = None
        for rule in rules:
            value = make(rule)
            chain = F.when(F.col("site") == rule.site, value) if chain is None else chain.when(F.col("site") == rule.site, value)
        return chain

    def group(pattern: str | None) -> Column:
        return F.lit("") if pattern is None else F.regexp_extract(html, pattern, 1)

    def element(rule: SiteRules, part: int) -> Column:
        return F.regexp_extract(html, rf"(?s)<([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(?:{rule.price})[^<>]*>(.*)", part)

    p = pages.withColumns({
        "title": strip_markup(by_site(lambda r: group(r.title))),
        "visible_mpn": F.upper(F.trim(by_site(lambda r: group(r.mpn)))),
        "structured_mpn": F.upper(F.trim(by_site(lambda r: group(r.structured_mpn)))),
        "structured_price": by_site(lambda r: group(r.structured_price)),
        "price_tag": by_site(lambda r: element(r, 1)),
        "price_rest": by_site(lambda r: element(r, 2)),
        "gone": by_site(lambda r: F.lit(False) if r.discontinued is None else html.rlike(r.discontinued)),
        "stock_in": by_site(lambda r: html.rlike(r.in_stock)),
        "stock_out": by_site(lambda r: html.rlike(r.out_of_stock)),
    }).withColumn("price_block", strip_markup(inside_element(F.col("price_rest"), F.col("price_tag")))).withColumns({
        "inc": by_site(lambda r: F.col("price_block").rlike(r.tax_included)),
        "exc": by_site(lambda r: F.col("price_block").rlike(r.tax_excluded)),
        "amount_minor": pounds_to_minor(F.col("price_block")),
    })
    known = F.col("site").isin([r.site for r in rules])
    mpn = F.when(F.col("visible_mpn") != "", F.col("visible_mpn")).when(F.col("structured_mpn") != "", F.col("structured_mpn"))
    kit = F.col("title").rlike(KIT)
    reasons = F.when(~known, F.array(F.lit("NO_EXTRACTOR_FOR_SELLER"))).otherwise(reason_codes([
        ("CAPACITY_NOT_VISIBLE", ~kit),
        ("DDR5_NOT_CONFIRMED", ~F.col("title").rlike("(?i)DDR5")),
        ("NOT_A_DESKTOP_DIMM", F.col("title").rlike("(?i)so-?dimm")),
        ("MPN_NOT_VISIBLE", mpn.isNull()),
        ("MPN_NOT_VISIBLE_ONLY_STRUCTURED", (F.col("visible_mpn") == "") & (F.col("structured_mpn") != "")),
        ("PRICE_NOT_VISIBLE", F.col("amount_minor").isNull()),
        ("VAT_DISPLAY_MODE_NOT_VISIBLE", ~F.col("inc") & ~F.col("exc")),
        ("PRODUCT_DISCONTINUED", F.col("gone")),
    ]))
    return p.select(
        "page_id", "site", "url", "title",
        mpn.alias("mpn"),
        F.when(F.col("structured_mpn") != "", F.col("structured_mpn")).alias("structured_mpn"),
        "amount_minor",
        half_up(F.col("structured_price").try_cast("double") * 100).alias("structured_price_minor"),
        F.when(F.col("inc"), F.lit(True)).when(F.col("exc"), F.lit(False)).alias("vat_included"),
        F.when(kit, F.lit(32)).cast("long").alias("capacity_gb"),
        F.when(kit, F.lit(2)).cast("long").alias("module_count"),
        F.when(F.col("stock_out"), F.lit("Out of stock")).when(F.col("stock_in"), F.lit("In stock")).alias("availability"),
        reasons.alias("reasons"),
    )


def page_titles(pages: DataFrame) -> DataFrame:
    """Visible heading of every captured page."""
    return pages.select("page_id", strip_markup(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("title"))


def cross_check_sources(readings: DataFrame, tolerance: int = 3) -> DataFrame:
    """Two statements of one fact must agree; disagreements join the reasons."""
    inclusive = half_up(F.col("ex_vat_minor").cast("double") * 1.2)
    found = reason_codes([
        ("MPN_SOURCES_DISAGREE", F.coalesce(F.col("mpn") != F.col("structured_mpn"), F.lit(False))),
        ("PRICE_SOURCES_DISAGREE", F.coalesce(F.col("structured_price_minor") != F.col("amount_minor"), F.lit(False))),
        ("VAT_ARITHMETIC_INCONSISTENT",
         F.coalesce(F.col("vat_included") & (F.abs(inclusive - F.col("amount_minor")) > tolerance), F.lit(False))),
    ])
    return readings.withColumn("reasons", F.concat("reasons", found))


# Reasons an established kit shape may waive.
SHAPE_REASONS = ["CAPACITY_NOT_VISIBLE", "DDR5_NOT_CONFIRMED"]


def established_shapes(evidence: DataFrame) -> DataFrame:
    """Earliest row per number that showed the kit shape on the page."""
    seen = evidence.where("capacity_gb = 32 AND module_count = 2 AND mpn IS NOT NULL")
    return seen.groupBy(F.upper("mpn").alias("shape_mpn")).agg(F.min(F.struct("observed_at", "reading_id")).alias("r")).select(
        "shape_mpn", F.col("r.reading_id").alias("shape_reference"), F.col("r.observed_at").alias("shape_at")
    )


def propagate_kit_shape(readings: DataFrame) -> DataFrame:
    """Carry the shape of a number to its rows that do not state it, with basis and reference."""
    shaped = readings.join(established_shapes(readings), F.upper("mpn") == F.col("shape_mpn"), "left")
    on_page = F.coalesce((F.col("capacity_gb") == 32) & (F.col("module_count") == 2), F.lit(False))
    carried = ~on_page & F.col("shape_mpn").isNotNull()
    return shaped.withColumns({
        "capacity_basis": F.when(on_page, F.lit("visible_on_page")).when(carried, F.lit("established_from_sibling_capture")),
        "capacity_basis_reference": F.when(carried, F.col("shape_reference")),
        "capacity_gb": F.when(carried, F.lit(32)).otherwise(F.col("capacity_gb")).cast("long"),
        "module_count": F.when(carried, F.lit(2)).otherwise(F.col("module_count")).cast("long"),
    }).drop("shape_mpn", "shape_reference", "shape_at")


def accept_readings(readings: DataFrame, targets: DataFrame, shapes: DataFrame) -> DataFrame:
    """Expected against observed number, shape waiver, and the usable flag."""
    t = targets.select("url", "seller_display_name", F.col("mpn").alias("mpn_expected"))
    moved = F.coalesce(F.upper("mpn") != F.upper("mpn_expected"), F.lit(False))
    j = readings.join(t, ["url", "seller_display_name"]).withColumn(
        "all_reasons", F.concat("reasons", F.when(moved, F.array(F.lit("MPN_MISMATCH_URL_MAY_HAVE_MOVED"))).otherwise(F.array().cast("array<string>")))
    ).join(shapes, F.upper("mpn") == F.col("shape_mpn"), "left")
    on_page = F.coalesce((F.col("capacity_gb") == 32) & (F.col("module_count") == 2), F.lit(False))
    waivable = F.array(*[F.lit(r) for r in SHAPE_REASONS])
    waived = ~on_page & F.col("shape_mpn").isNotNull() & (F.size(F.array_except("all_reasons", waivable)) == 0)
    final = F.when(waived, F.array().cast("array<string>")).otherwise(F.col("all_reasons"))
    shape_known = on_page | waived
    usable = (
        (F.size("final_reasons") == 0) & F.col("mpn").isNotNull() & F.coalesce(F.col("amount_minor") > 0, F.lit(False))
        & F.coalesce(F.col("vat_included"), F.lit(False)) & F.col("capacity_basis").isNotNull()
    )
    return j.withColumns({
        "final_reasons": final,
        "capacity_basis": F.when(on_page, F.lit("visible_on_page")).when(waived, F.lit("established_for_mpn_from_prior_evidence")),
        "capacity_basis_reference": F.when(waived, F.col("shape_reference")),
        "shape_reasons_waived": F.when(waived, F.col("all_reasons")).otherwise(F.array().cast("array<string>")),
        "capacity_gb": F.when(shape_known, F.lit(32)).otherwise(F.col("capacity_gb")).cast("long"),
        "module_count": F.when(shape_known, F.lit(2)).otherwise(F.col("module_count")).cast("long"),
    }).withColumn("usable", usable).withColumn("reasons", F.col("final_reasons")).drop(
        "all_reasons", "final_reasons", "shape_mpn", "shape_reference", "shape_at"
    )


def to_prospective(accepted: DataFrame, legal_names: DataFrame) -> DataFrame:
    """Usable readings in the live observation shape."""
    at = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stock = F.col("availability")
    a = accepted.where("usable").join(legal_names, "seller_display_name", "left")
    reasons = F.array_compact(F.array(
        F.lit("delivery_not_read_by_collector"), F.when(F.col("legal_name").isNull(), F.lit("seller_legal_name_unresolved"))
    ))
    return a.select(
        F.concat_ws("-", slug(F.col("seller_display_name")), F.lower("mpn"), F.lower(at)).alias("observation_id"),
        F.lit("candidate_private_immutable").alias("status"), F.lit("candidate_only").alias("scope"),
        at.alias("observed_at"), F.lower("mpn").alias("product_key"),
        F.struct("mpn_expected", F.col("mpn").alias("mpn_observed"), F.lit("exact_mpn").alias("match_basis")).alias("identity"),
        F.struct("capacity_gb", "module_count", F.lit("DDR5").alias("memory_type"), "capacity_basis", "capacity_basis_reference").alias("product"),
        F.struct(F.col("seller_display_name").alias("display_name"), "legal_name", F.lit("retailer_owned").alias("relationship")).alias("seller"),
        F.struct("amount_minor", F.lit("GBP").alias("currency"), F.lit("included").alias("vat_state")).alias("item_price"),
        F.struct(
            F.when(stock == "In stock", F.lit("in_stock")).when(F.length(stock) > 0, F.lit("other")).otherwise(F.lit("unknown")).alias("normalised"),
            F.when(F.length(stock) > 0, F.lit("explicit")).otherwise(F.lit("unknown")).alias("eligibility_semantics"),
        ).alias("availability"),
        F.struct(reasons.alias("reasons")).alias("qualification"),
        F.struct(F.col("url").alias("source_url")).alias("source"),
    )


def thin_captures(captures: DataFrame) -> DataFrame:
    """First capture per address without its query and calendar month."""
    address = F.element_at(F.split("url", r"\?"), 1)
    return captures.groupBy(address.alias("url"), F.substring("timestamp", 1, 6).alias("month")).agg(F.min("timestamp").alias("timestamp"))


def pending_captures(queue: DataFrame, done: DataFrame) -> DataFrame:
    keys = ["seller_display_name", "url", "timestamp"]
    return queue.join(done.select(*keys), keys, "left_anti")


def triage_readings(readings: DataFrame, ceiling: int = 999900) -> DataFrame:
    """First failing code of every reading, null for the kept ones."""
    return readings.withColumn("rejection", F.coalesce(
        F.get("reasons", F.lit(0)),
        first_reason([
            ("MPN_NOT_VISIBLE", F.col("mpn").isNull()),
            ("PRICE_NOT_VISIBLE", F.coalesce(F.col("amount_minor") == 0, F.lit(True))),
            ("SENTINEL_PLACEHOLDER_PRICE", F.col("amount_minor") >= ceiling),
            ("VAT_DISPLAY_MODE_NOT_VISIBLE", F.col("vat_included").isNull()),
            ("KIT_SHAPE_NOT_VISIBLE", failed((F.col("capacity_gb") != 32) | (F.col("module_count") != 2))),
            ("DDR5_NOT_CONFIRMED_IN_VISIBLE_TEXT", failed(~F.col("title").rlike("(?i)DDR5"))),
        ]),
    ))


def drop_already_retained(readings: DataFrame, retained: DataFrame) -> DataFrame:
    """Code rows an earlier wave holds, and keep the least row of each id. Rows without id are all kept."""
    keys = ["seller_display_name", "mpn", "observed_at"]
    held = retained.select(*keys).distinct().withColumn("held", F.lit(True))
    marked = readings.join(held, keys, "left")
    code = F.coalesce(F.col("rejection"), F.when(F.col("held"), F.lit("ALREADY_RETAINED_BY_EARLIER_WAVE")))
    coded = marked.withColumn("rejection", code).select(*readings.columns)
    apart = coded.select(F.struct(*coded.columns).alias("r"), F.when(F.col("reading_id").isNull(), F.monotonically_increasing_id()).alias("nameless"))
    return apart.groupBy("r.reading_id", "nameless").agg(F.min("r").alias("r")).select("r.*")


def triage_summary(triaged: DataFrame) -> DataFrame:
    """Rows per rejection code and seller; kept rows under 'KEPT'."""
    return triaged.groupBy(F.coalesce("rejection", F.lit("KEPT")).alias("code"), "seller_display_name").agg(F.count(F.lit(1)).alias("n"))


def build_target_registry(active: DataFrame, archive: DataFrame, catalogue_mpns: DataFrame, recent_from: str) -> DataFrame:
    """One target per (number, seller): active wins, otherwise the latest capture.

    Both inputs are (mpn, seller_display_name, url, last_observed_at).
    """
    rows = stacked(
        active.select("mpn", "seller_display_name", "url", "last_observed_at", F.lit(True).alias("is_active")),
        archive.select("mpn", "seller_display_name", "url", "last_observed_at", F.lit(False).alias("is_active")),
    )
    best = F.max(F.struct("is_active", "last_observed_at", "url")).alias("b")
    targets = rows.groupBy("mpn", "seller_display_name").agg(best).select("mpn", "seller_display_name", "b.*")
    breadth = targets.groupBy("mpn").agg(F.count(F.lit(1)).alias("retailers_holding_this_mpn"))
    reviewed = catalogue_mpns.select("mpn").distinct().withColumn("reviewed", F.lit(True))
    j = targets.join(breadth, "mpn").join(reviewed, "mpn", "left")
    recent = F.col("last_observed_at") >= F.lit(recent_from).cast("timestamp")
    shared = F.col("retailers_holding_this_mpn") >= 2
    in_catalogue = F.coalesce("reviewed", F.lit(False))
    priority = (
        F.when(F.col("is_active"), 1).when(in_catalogue & recent, 2).when(recent & shared, 3).when(recent, 4).when(shared, 5).otherwise(6)
    )
    return j.select(
        "mpn", "seller_display_name", "url", "last_observed_at",
        F.when(F.col("is_active"), F.lit("active_collection")).otherwise(F.lit("archived_capture")).alias("provenance"),
        in_catalogue.alias("in_reviewed_catalogue"), "retailers_holding_this_mpn", recent.alias("recently_seen"),
        priority.cast("long").alias("collection_priority"),
    )


def select_targets(registry: DataFrame, max_priority: int, n: int) -> DataFrame:
    """The first n targets in registry order up to a priority."""
    return registry.where(F.col("collection_priority") <= max_priority).orderBy("collection_priority", "mpn", "seller_display_name").limit(n)


def resolve_crawl_rules(targets: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Whether each (host, path) may be fetched by `agent`.

    `rules` is (host, agent_group, allow, path). A group naming the agent
    replaces the wildcard group; the longest matching prefix decides, allow
    wins ties, no rule allows. Only prefixes whose length occurs among a host's
    rules are formed, and they meet the rules on equality.
    """
    group = F.lower("agent_group")
    named = (group != "*") & F.contains(F.lit(agent.lower()), group)
    scoped = rules.where(named | (group == "*")).withColumn("is_named", named)
    hosts = scoped.groupBy("host").agg(F.max("is_named").alias("host_named"))
    usable = scoped.join(hosts, "host").where("is_named = host_named AND path IS NOT NULL AND path <> ''").groupBy("host", "path").agg(
        F.max("allow").alias("allow")
    )
    # Distinct lengths per host are bounded by the longest rule.
    lengths = usable.select("host", F.length("path").alias("n")).distinct().groupBy("host").agg(F.array_sort(F.collect_list("n")).alias("lengths"))
    distinct = targets.select("host", "path").distinct()
    prefixes = distinct.join(lengths, "host").withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path")).select(
        "host", F.col("path").alias("target_path"), F.substr("path", F.lit(1), F.col("n")).alias("path")
    )
    best = prefixes.join(usable, ["host", "path"]).groupBy("host", F.col("target_path").alias("path")).agg(
        F.max(F.struct(F.length("path").alias("n"), "allow")).alias("best")
    )
    return distinct.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))
