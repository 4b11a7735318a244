"""Catalogue identity, listing matching, coverage and lifecycle checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.reasons import duplicated, failed, stacked, violations
from pricetrail.functions.text import normalise_manufacturer, normalise_mpn
from pricetrail.functions.windows import lag_in_chunks
from pricetrail.session import settle
from pricetrail.sources.tables import literal_table

SPEC_FIELDS = ["total_capacity_gb", "module_count", "memory_generation", "form_factor", "ecc", "registered"]
# The supported scope.
SCOPE = {
    "total_capacity_gb": 32,
    "module_count": 2,
    "memory_generation": "DDR5",
    "form_factor": "UDIMM",
    "ecc": False,
    "registered": False,
}


def spread(df: DataFrame, keys: list[str], value: str, rule: str) -> DataFrame:
    """Keys that go with more than one distinct value; pairs fold before counting."""
    pairs = df.select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), F.col("n").cast("string").alias("detail")
    )


def check_catalogue(products: DataFrame, aliases: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Uniqueness, one-to-one naming, alias ownership, primary numbers and scope."""
    slug = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
    in_scope = F.lit(True)
    for name, value in SCOPE.items():
        in_scope = in_scope & (F.col(name) == value)
    rows = violations(products, F.col("product_key"), [
        ("product_key_not_slug", failed(~F.col("product_key").rlike(slug))),
        ("mpn_normalisation_differs", failed(F.col("mpn_normalized") != normalise_mpn(F.col("mpn_raw")))),
        ("specification_out_of_scope", failed(~in_scope)),
        ("speed_not_positive", failed(F.col("speed_mt_s") <= 0)),
    ])
    owners = aliases.select(normalise_manufacturer(F.col("alias")).alias("alias_key"), "manufacturer_key")
    primary = identifiers.groupBy("product_key").agg(
        F.count_if((F.col("identifier_type") == "MPN") & F.col("is_primary")).alias("n")
    )
    primaries = products.select("product_key").join(primary, "product_key", "left").where(F.coalesce("n", F.lit(0)) != 1).select(
        F.lit("primary_mpn_count").alias("rule"), F.col("product_key").alias("key"), F.coalesce("n", F.lit(0)).cast("string").alias("detail")
    )
    return stacked(
        rows,
        duplicated(products, ["product_key"], "product_key_not_unique"),
        duplicated(products, ["manufacturer_key", "mpn_normalized"], "scoped_mpn_not_unique"),
        spread(products, ["manufacturer_key"], "manufacturer_name", "manufacturer_key_with_two_names"),
        spread(products, ["manufacturer_name"], "manufacturer_key", "manufacturer_name_with_two_keys"),
        spread(owners, ["alias_key"], "manufacturer_key", "alias_with_two_owners"),
        primaries,
    )


def with_manufacturer(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Listing plus manufacturer_key by accepted spelling and the normalised number."""
    # Written, so that Spark knows how few spellings there are and does not deal out the listings to meet them.
    known = settle(aliases.select(
        normalise_manufacturer(F.col("alias")).alias("alias_key"), "manufacturer_key"
    ).groupBy("alias_key").agg(F.min("manufacturer_key").alias("manufacturer_key")))
    keyed = listings.withColumns({
        "alias_key": normalise_manufacturer(F.col("manufacturer_raw")),
        "mpn_key": normalise_mpn(F.col("mpn_raw")),
    })
    return keyed.join(known, "alias_key", "left").drop("alias_key")


def deletions(text: Column) -> Column:
    """Every string left after removing at most two characters, itself included.

    Two strings are within edit distance two only if they share one of these.
    """
    def without_one(s: Column, first: Column) -> Column:
        return F.transform(
            F.sequence(first, F.greatest(F.length(s), first)),
            lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)),
        )

    once = without_one(text, F.lit(1))
    # The second character goes from the place of the first on, so no two are removed in both orders.
    twice = F.flatten(F.transform(once, lambda s, i: without_one(s, i + 1)))
    return F.array_distinct(F.concat(F.array(text), once, twice))


#: Of a variant's 64 bits the upper 40 are a hash, the rest the two places it lacks, counted in rounds of `PLACES`.
PLACES, PLACE_BITS = 4095, 12
#: Variants put together at once.
VARIANTS_AT_ONCE = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _variants_of(codes: np.ndarray, salt: np.ndarray, edits: int) -> np.ndarray:
    """Packed variants of texts of one length (a row of code points each), a column per choice of places.

    A text's hash is the sum of its characters times the powers of an odd base
    modulo 2^64, so that the hash without some characters follows from sums
    over what stands before, between and behind them.
    """
    n = codes.shape[1]
    base = 0x9E3779B97F4A7C15
    back = np.uint64(pow(base, -1, 1 << 64))
    powers = np.array([pow(base, k + 1, 1 << 64) for k in range(n)], dtype=np.uint64)
    sums = np.zeros((len(codes), n + 1), dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
    whole = sums[:, n]
    out = [(whole, 0)]
    place = [i % PLACES + 1 for i in range(n)]
    for i in range(n):
        left = sums[:, i]
        out.append((left + (whole - sums[:, i + 1]) * back, place[i] << PLACE_BITS | place[i]))
        if edits > 1:
            for j in range(i + 1, n):
                out.append((left + ((sums[:, j] - sums[:, i + 1]) + (whole - sums[:, j + 1]) * back) * back, place[i] << PLACE_BITS | place[j]))
    low = np.uint64(2 * PLACE_BITS)
    return np.stack([_mixed(h + salt) >> low << low | np.uint64(at) for h, at in out], axis=1)


def _variants(numbers: DataFrame, edits: int, name: str) -> DataFrame:
    """(name, variant): each number's id with itself and all that is left of it without up to `edits` characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["number"].map(len)
            for n, group in pdf.groupby(sizes, sort=False):
                each = 1 + n + (n * (n - 1) // 2 if edits > 1 else 0)
                step = max(1, VARIANTS_AT_ONCE // each)
                for start in range(0, len(group), step):
                    part = group.iloc[start:start + step]
                    codes = np.frombuffer("".join(part["number"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), n)
                    packed = _variants_of(codes, part["salt"].to_numpy().view(np.uint64), edits)
                    yield pd.DataFrame({name: np.repeat(part["id"].to_numpy(), packed.shape[1]), "variant": packed.view(np.int64).ravel()})

    return numbers.select("id", "number", F.xxhash64("manufacturer_key").alias("salt")).mapInPandas(run, f"{name} long, variant long")


def _numbers(listings: DataFrame, products: DataFrame) -> DataFrame:
    """(id, manufacturer_key, number, wanted, held, unknown) of every number listed or held, written once.

    Ids run from 0 on. `unknown`: a product of that number has no key. Manufacturers may be unknown.
    """
    flags = ["wanted", "held", "unknown"]
    no = F.lit(False)
    every = stacked(
        listings.where("mpn_key IS NOT NULL").select("manufacturer_key", F.col("mpn_key").alias("number"), F.lit(True).alias("wanted"), no.alias("held"), no.alias("unknown")),
        products.where("manufacturer_key IS NOT NULL AND mpn_normalized IS NOT NULL").select(
            "manufacturer_key", F.col("mpn_normalized").alias("number"), no.alias("wanted"), F.lit(True).alias("held"), F.col("product_key").isNull().alias("unknown")
        ),
    )
    folded = every.groupBy("manufacturer_key", "number").agg(*[F.bool_or(f).alias(f) for f in flags])
    held = settle(folded.withColumn("at", F.monotonically_increasing_id()))
    # The upper bits are the task that wrote the row; tasks are put one after the other.
    task = F.shiftright("at", 33)
    starts, start = [], 0
    for r in sorted(held.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["task"], start))
        start += r["n"]
    table = literal_table(listings.sparkSession, "task long, start long", starts or [(0, 0)])
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("task", task).join(table, "task").select((F.col("start") + inside).alias("id"), "manufacturer_key", "number", *flags)


def _likely(rows: DataFrame, products: DataFrame, number: str) -> DataFrame:
    """Rows whose number may be near one of its manufacturer's.

    Its length is at most two off theirs, and at most two of its characters occur
    in none of them. So free text of any length makes no variants.
    """
    held = products.select(F.col("manufacturer_key").alias("maker"), F.col("mpn_normalized").alias("held"))
    lengths = held.groupBy("maker").agg(F.min(F.length("held")).alias("least"), F.max(F.length("held")).alias("most"))
    each = F.when(F.length("held") > 0, F.transform(F.sequence(F.lit(1), F.length("held")), lambda i: F.substr("held", i, F.lit(1))))
    letters = held.select("maker", F.explode(each).alias("letter")).distinct()
    letters = letters.groupBy("maker").agg(F.array_join(F.collect_set("letter"), "").alias("letters"))
    # One row per manufacturer, written so that Spark knows.
    makers = settle(lengths.join(letters, "maker", "left"))
    size = F.length(number)
    near = (F.col("manufacturer_key") == F.col("maker")) & (size >= F.col("least") - 2) & (size <= F.col("most") + 2)
    return rows.join(makers, near & (F.length(F.call_function("translate", F.col(number), F.coalesce("letters", F.lit("")), F.lit(""))) <= 2), "left_semi")


def _met(wanted: DataFrame, held: DataFrame, edits: int = 2) -> DataFrame:
    """(wanted_id, held_id) of numbers that share a variant, its places fitting an edit distance of one or two.

    Numbers at that distance share a variant such that, where both lack two
    characters, these stand at the same places, and where one lacks two and the other one,
    the latter's place is the former's first, or one before its second. Every
    other pair of places is left out before it is moved.
    """
    left, right = _variants(wanted, edits, "wanted_id"), _variants(held, edits, "held_id")
    left, right = left.withColumnRenamed("variant", "wanted_variant"), right.withColumnRenamed("variant", "held_variant")

    def places(variant: str) -> list[Column]:
        return [F.shiftright(variant, at).bitwiseAND(F.lit(PLACES).cast("long")) for at in (PLACE_BITS, 0)]

    def fits(two: list[Column], one: list[Column]) -> Column:
        return (two[0] == two[1]) | (one[0] != one[1]) | (one[0] == 0) | (one[0] == two[0]) | (two[1] == one[0] % PLACES + 1)

    a, b = places("wanted_variant"), places("held_variant")
    both = (a[0] == a[1]) | (b[0] == b[1]) | ((a[0] == b[0]) & (a[1] == b[1]))
    hashed = F.shiftright("wanted_variant", 2 * PLACE_BITS) == F.shiftright("held_variant", 2 * PLACE_BITS)
    # Spark sizes variants as if there were one a number, so that it would broadcast a hundred times what it expects.
    met = left.join(right.hint("merge"), hashed & (F.col("wanted_id") != F.col("held_id")) & both & fits(a, b) & fits(b, a))
    # Pairs are dealt out by the number that is looked up next, and lie together there.
    return met.select("wanted_id", "held_id").repartition("wanted_id").distinct()


def _measured(pairs: DataFrame, wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(wanted_id, manufacturer_key, mpn_key, near_mpn, distance) of the pairs that are near indeed, the hash of a variant aside."""
    left = wanted.select(F.col("id").alias("wanted_id"), "manufacturer_key", F.col("number").alias("mpn_key"))
    right = held.select(F.col("id").alias("held_id"), F.col("manufacturer_key").alias("maker"), F.col("number").alias("near_mpn"))
    met = pairs.join(left, "wanted_id").join(right, "held_id").where("manufacturer_key = maker")
    distance = F.levenshtein("mpn_key", "near_mpn", 2).cast("long")
    return met.withColumn("distance", distance).where("distance BETWEEN 1 AND 2").select("wanted_id", "manufacturer_key", "mpn_key", "near_mpn", "distance")


def near_mpn(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs of unmatched number and catalogue number at edit distance one or two.

    `listings` needs (manufacturer_key, mpn_key). Numbers meet on shared
    deletion variants, an equi-join on their hashes, instead of all pairs of a
    manufacturer. A variant moves as a hash, the places of what it lacks and its
    number's id, no text; manufacturer and distance are then verified on the few that meet.
    """
    numbers = _numbers(_likely(listings, products, "mpn_key"), products)
    wanted, held = numbers.where("wanted"), numbers.where("held")
    near = _measured(_met(wanted, held), wanted, held)
    held = products.select("manufacturer_key", F.col("mpn_normalized").alias("near_mpn"), F.col("product_key").alias("near_product_key")).distinct()
    return near.join(held, ["manufacturer_key", "near_mpn"]).select("manufacturer_key", "mpn_key", "near_mpn", "near_product_key", "distance")


def _with_near(numbers: DataFrame, products: DataFrame) -> DataFrame:
    """Numbers that no product of a known key has, with a number of the same manufacturer near them: (id).

    Most have one at a place or two, found by their few variants without one
    character; only the rest makes those without two, and only numbers that the rest may be near.
    """
    held = numbers.where("held")
    wanted = settle(_likely(numbers.where("wanted AND (NOT held OR unknown)"), products, "number"))
    first = settle(_measured(_met(wanted, held, 1), wanted, held).select(F.col("wanted_id").alias("id")).distinct())
    rest = settle(wanted.join(first, "id", "left_anti"))
    size = F.length("number")
    around = F.explode(F.sequence(size - 2, size + 2)).alias("size")
    asked = settle(rest.select(F.col("manufacturer_key").alias("maker"), around).distinct())
    held = held.join(asked, (F.col("manufacturer_key") == F.col("maker")) & (size == F.col("size")), "left_semi")
    return stacked(first, _measured(_met(rest, held), rest, held).select(F.col("wanted_id").alias("id")).distinct())


def stated_conflict(expected: dict[str, Column]) -> Column:
    """Any stated field that differs from what is expected of it."""
    parts = [F.coalesce(F.col(f) != v, F.lit(False)) for f, v in expected.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out


def scope_conflicts(listings: DataFrame) -> DataFrame:
    """Stated fields outside the supported scope, one row per field."""
    found = F.array_compact(F.array(*[
        F.when(F.col(f) != F.lit(v), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stated")))
        for f, v in SCOPE.items() if f in listings.columns
    ]))
    return listings.select("listing_id", F.explode(found).alias("c")).select("listing_id", "c.field", "c.stated")


def check_gtin(listings: DataFrame) -> DataFrame:
    """Whether a stated GTIN has one of the four legal lengths."""
    ok = F.col("gtin_raw").rlike("^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})$")
    return listings.where("gtin_raw IS NOT NULL").select("listing_id", "gtin_raw", ok.alias("well_formed"))


def match_listings(listings: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Decision and reason of every listing; near numbers abstain, never match."""
    fields = [f for f in SPEC_FIELDS if f in listings.columns]
    # One row per number or manufacturer, so none of these joins multiplies rows. The second is written, being small.
    owners = products.groupBy(F.col("mpn_normalized").alias("number")).agg(
        F.count(F.lit(1)).alias("number_products"), F.min("manufacturer_key").alias("number_owner")
    )
    ranges = settle(products.groupBy("manufacturer_key").agg(F.count(F.lit(1)).alias("maker_products")))
    keyed = with_manufacturer(listings, aliases).join(ranges, "manufacturer_key", "left")

    # What a number is known for is put together once per number; a listing meets it once, and leaves its texts behind.
    numbers = _numbers(keyed, products)
    near = _with_near(numbers, products).withColumn("is_near", F.lit(True))
    scoped = products.select(
        "manufacturer_key", F.col("mpn_normalized").alias("number"), "product_key", *[F.col(f).alias(f"spec_{f}") for f in fields]
    )
    facts = (
        numbers.where("wanted").select("id", "manufacturer_key", "number").join(near, "id", "left").drop("id")
        .join(owners, "number", "left")
        .join(scoped, ["manufacturer_key", "number"], "left")
        .withColumnRenamed("manufacturer_key", "maker")
    )

    found = F.col("product_key").isNotNull()
    conflict = stated_conflict({f: F.col(f"spec_{f}") for f in fields})
    gtin_bad = F.col("gtin_raw").isNotNull() & ~F.col("gtin_raw").rlike("^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})$")
    no_number = F.col("mpn_key").isNull()
    alone = [
        *[
            (stated_conflict({field: F.lit(SCOPE[field])}), "unsupported", reason)
            for field, reason in (
                ("memory_generation", "unsupported_memory_type"),
                ("form_factor", "unsupported_form_factor"),
                ("module_count", "unsupported_module_configuration"),
                ("total_capacity_gb", "unsupported_capacity"),
            )
            if field in fields
        ],
        (gtin_bad, "abstain_insufficient", "malformed_identifier"),
        (no_number & F.col("title").rlike(r"(?i)\b(choose|or)\b"), "abstain_ambiguous", "multi_product_listing"),
        (no_number & F.col("gtin_raw").isNull() & F.coalesce(F.col("maker_products") > 1, F.lit(False)), "abstain_ambiguous", "multiple_candidates"),
        (no_number, "abstain_insufficient", "missing_identifier"),
    ]
    first = F.coalesce(*[F.when(cond, F.lit(i)) for i, (cond, _, _) in enumerate(alone)])
    # A listing without a number meets none, wherever it lies; a text of its own keeps such listings from lying together.
    lies = F.coalesce("mpn_key", F.concat(F.lit("?"), F.pmod(F.xxhash64("listing_id"), F.lit(1000)).cast("string")))
    rows = keyed.select(
        "listing_id", "manufacturer_key", no_number.alias("no_number"), lies.alias("lies"), *fields,
        (F.col("mpn_raw") == F.col("mpn_key")).alias("as_written"), first.alias("alone"),
    )
    full = rows.join(
        facts, (F.col("lies") == F.col("number")) & F.col("manufacturer_key").eqNullSafe(F.col("maker")) & ~F.col("no_number"), "left"
    )
    outcomes = [
        (found & conflict, "abstain_ambiguous", "specification_conflict"),
        (found & F.col("as_written"), "match", "exact_mpn"),
        (found, "match", "normalized_mpn"),
        *[(F.col("alone") == i, decision, reason) for i, (_, decision, reason) in enumerate(alone)],
        ((F.col("number_products") == 1) & ~F.col("number_owner").eqNullSafe(F.col("manufacturer_key")), "abstain_ambiguous", "manufacturer_mismatch"),
        (F.coalesce(F.col("is_near"), F.lit(False)), "abstain_insufficient", "near_mpn_only"),
        (F.col("manufacturer_key").isNotNull(), "no_match", "no_catalogue_product"),
    ]
    chosen = F.when(outcomes[0][0], F.struct(F.lit(outcomes[0][1]).alias("decision"), F.lit(outcomes[0][2]).alias("reason_code")))
    for cond, decision, reason in outcomes[1:]:
        chosen = chosen.when(cond, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason_code")))
    chosen = chosen.otherwise(F.struct(F.lit("abstain_insufficient").alias("decision"), F.lit("missing_identifier").alias("reason_code")))
    return full.withColumn("o", chosen).select(
        "listing_id", "o.decision", "o.reason_code", F.when(F.col("o.decision") == "match", F.col("product_key")).alias("product_key")
    )


def listing_prints(listing_id: Column) -> list[Column]:
    """128 bits of a listing id, by which the tables of check_labels are dealt out and met."""
    return [F.xxhash64(listing_id), F.xxhash64(F.lit(1), listing_id)]


def same_listing(one: list[Column], other: Column) -> Column:
    """Whether the prints are those of a listing id."""
    met = [a == b for a, b in zip(one, listing_prints(other), strict=True)]
    return met[0] & met[1]


def check_labels(matches: DataFrame, labels: DataFrame, decisions: list[str]) -> DataFrame:
    """Labels the row does not support, eligible non-matches, decisions never covered."""
    known = F.col("l.listing_id")
    met = known.isNotNull() & same_listing(listing_prints(known), F.col("m.listing_id"))
    j = labels.alias("l").join(matches.alias("m"), met, "left").select(
        "l.listing_id", F.col("l.decision").alias("want"), F.col("l.reason_code").alias("want_reason"),
        F.col("m.decision").alias("got"), F.col("m.reason_code").alias("got_reason"), "index_eligible",
    )
    rows = violations(j, F.col("listing_id"), [
        ("label_not_supported", ~F.col("want").eqNullSafe(F.col("got")) | ~F.col("want_reason").eqNullSafe(F.col("got_reason"))),
        ("eligible_without_match", F.col("index_eligible") & (F.col("want") != "match")),
    ], F.concat_ws("/", "got", "got_reason"))
    wanted = literal_table(labels.sparkSession, "decision string", [(d,) for d in decisions])
    # Counted over the columns that the rows above read too, so that both read the same shuffles.
    covered = labels.groupBy("decision", "reason_code", "index_eligible").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    required = wanted.join(covered.select("decision"), "decision", "left_anti")
    return stacked(rows, required.select(
        F.lit("decision_never_covered").alias("rule"), F.col("decision").alias("key"), F.lit("").alias("detail")
    ))


def bind_evidence(references: DataFrame, manifest: DataFrame) -> DataFrame:
    """Two-way completeness of evidence references against retained extracts.

    Both sides carry (reference, mpn, total_capacity_gb, module_count).
    """
    facts = ["mpn", "total_capacity_gb", "module_count"]
    a = references.select("reference", *[F.col(f).alias(f"claim_{f}") for f in facts], F.lit(True).alias("claimed"))
    # Of a doubled reference, which is reported as such, the least entry is compared.
    b = manifest.groupBy("reference").agg(F.min(F.struct(*facts)).alias("fact"), F.count(F.lit(1)).alias("items")).select(
        "reference", "items", *[F.col(f"fact.{f}").alias(f"fact_{f}") for f in facts]
    )
    j = a.join(b, "reference", "full")
    differs = F.lit(False)
    for f in facts:
        differs = differs | ~F.col(f"claim_{f}").eqNullSafe(F.col(f"fact_{f}"))
    both = F.col("claimed").isNotNull() & F.col("items").isNotNull()
    return violations(j, F.col("reference"), [
        ("reference_without_extract", F.col("items").isNull()),
        ("extract_without_reference", F.col("claimed").isNull()),
        ("extract_not_unique", F.coalesce(F.col("items") > 1, F.lit(False))),
        ("extract_facts_differ", both & differs),
    ])


def check_partition(every: DataFrame, approved: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """approved and held must be disjoint and together cover exactly `every`."""
    def marked(df: DataFrame, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    j = marked(every, "in_all").join(marked(approved, "in_approved"), key, "full").join(marked(held, "in_held"), key, "full")
    return violations(j, F.col(key), [
        ("in_both_parts", F.col("in_approved").isNotNull() & F.col("in_held").isNotNull()),
        ("in_neither_part", F.col("in_approved").isNull() & F.col("in_held").isNull()),
        ("not_in_whole", F.col("in_all").isNull()),
    ])


def coverage_report(products: DataFrame, dimensions: DataFrame, memberships: DataFrame) -> DataFrame:
    """Product counts by manufacturer, family, speed and catalogue status in one pass."""
    rows = products.select("product_key", "manufacturer_key", "speed_mt_s").join(dimensions, "product_key", "left").join(
        memberships.select("product_key", "status"), "product_key", "left"
    ).select(
        "manufacturer_key", F.coalesce("family_key", F.lit("none")).alias("family_key"), "speed_mt_s",
        F.coalesce("status", F.lit("none")).alias("status"),
    )
    sets = [["manufacturer_key"], ["family_key"], ["speed_mt_s"], ["status"], []]
    counted = rows.groupingSets(sets, "manufacturer_key", "family_key", "speed_mt_s", "status").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    # Bit per grouped-out column, first column highest.
    layer = (
        F.when(F.col("g") == 7, F.lit("manufacturer")).when(F.col("g") == 11, F.lit("family"))
        .when(F.col("g") == 13, F.lit("speed")).when(F.col("g") == 14, F.lit("status")).otherwise(F.lit("monitored_universe"))
    )
    key = F.coalesce("manufacturer_key", "family_key", F.col("speed_mt_s").cast("string"), "status", F.lit("all"))
    return counted.select(layer.alias("layer"), key.alias("key"), "n")


def missing_targets(products: DataFrame, targets: DataFrame) -> DataFrame:
    """Required manufacturers without a single product."""
    return targets.join(products, "manufacturer_key", "left_anti").select("manufacturer_key")


def check_memberships(products: DataFrame, memberships: DataFrame) -> DataFrame:
    """Exactly one membership per product, status as approved, blockers stated once."""
    p = products.select("product_key", F.col("review_status").alias("approved_status"), F.lit(True).alias("known"))
    j = memberships.join(p, "product_key", "full")
    has = F.col("status").isNotNull()
    rows = violations(j, F.col("product_key"), [
        ("unknown_product", F.col("known").isNull()),
        ("membership_missing", ~has),
        ("status_disagrees", has & F.col("known") & (F.col("status") != F.col("approved_status"))),
        ("baseline_claimed", F.coalesce("baseline_eligible", F.lit(False))),
        ("reserve_claimed", F.coalesce("reserve_candidate", F.lit(False))),
        ("blockers_missing", has & (F.size("eligibility_blockers") == 0)),
        ("blockers_repeated", has & (F.size(F.array_distinct("eligibility_blockers")) != F.size("eligibility_blockers"))),
        ("review_blocker_missing", (F.col("status") == "candidate_pending_review")
         & ~F.array_contains("eligibility_blockers", "additive-catalogue-review-pending")),
    ])
    return stacked(rows, duplicated(memberships, ["product_key"], "membership_not_unique"))


def check_lifecycle(events: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each event must continue the one before it within its scenario."""
    carry = ["to_state", "event_id", "effective_at"]
    numbered = lag_in_chunks(events, ["scenario_key"], ["event_no"], carry, F.floor(F.col("event_no") / 1_000_000))
    prior = numbered.withColumns({
        "prior_state": F.col("prior.to_state"), "prior_id": F.col("prior.event_id"), "prior_at": F.col("prior.effective_at"),
    })
    allowed = transitions.select(
        F.coalesce("from_state", F.lit("(start)")).alias("step_from"), F.col("to_state").alias("step_to"), F.lit(True).alias("legal")
    )
    step = {"step_from": F.coalesce("prior_state", F.lit("(start)")), "step_to": F.col("to_state")}
    j = prior.withColumns(step).join(allowed, ["step_from", "step_to"], "left")
    rows = violations(j, F.col("event_id"), [
        ("from_state_differs_from_prior", ~F.col("from_state").eqNullSafe(F.col("prior_state"))),
        ("transition_not_allowed", F.col("legal").isNull()),
        ("effective_at_not_increasing", F.coalesce(F.col("effective_at") <= F.col("prior_at"), F.lit(False))),
        ("supersedes_differs_from_prior", ~F.col("supersedes_event_id").eqNullSafe(F.col("prior_id"))),
    ])
    return stacked(rows, duplicated(events, ["event_id"], "event_id_not_unique"))


def identifier_conflicts(identifiers: DataFrame) -> DataFrame:
    """Identifiers claimed by several products; MPN within a manufacturer, GTIN anywhere."""
    scope = F.when(F.col("identifier_type") == "GTIN", F.lit("(global)")).otherwise(F.col("manufacturer_key"))
    claims = identifiers.select("identifier_type", scope.alias("scope"), "normalized_value", "product_key").distinct()
    return claims.groupBy("identifier_type", "scope", "normalized_value").agg(
        F.count(F.lit(1)).alias("product_count"), F.min("product_key").alias("first_product_key")
    ).where("product_count > 1")


def identifier_manufacturer_mismatch(identifiers: DataFrame, revisions: DataFrame) -> DataFrame:
    """Identifiers whose manufacturer is not that of the product revision they sit on."""
    r = revisions.select("product_key", F.col("manufacturer_key").alias("revision_manufacturer"))
    return identifiers.join(r, "product_key").where(F.col("manufacturer_key") != F.col("revision_manufacturer")).select(
        "identifier_type", "normalized_value", "product_key", "manufacturer_key", "revision_manufacturer"
    )
