"""Qualification: reason codes, resolutions, quarantine and structural checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.periods import valid_instant
from pricetrail.functions.reasons import duplicated, failed, reason_codes, stacked, violations
from pricetrail.functions.sieve import PrintSieve
from pricetrail.session import settle


def _identity_unresolved() -> Column:
    return failed((F.col("match_basis") != "exact_mpn") | ~F.col("mpn_observed").eqNullSafe(F.col("mpn_expected")))


def qualify_landed(obs: DataFrame) -> DataFrame:
    """Landed-price qualification; landed rules only speak when the rest passed."""
    state, amount = F.col("delivery_state"), F.col("delivery_amount_minor")
    delivery_known = (
        state.isin("mandatory_cost_known", "free_delivery_explicit")
        & amount.isNotNull()
        & ((state != "free_delivery_explicit") | (amount == 0))
    )
    stage_one = reason_codes([
        ("exact_mpn_unresolved", _identity_unresolved()),
        ("channel_not_primary_retail", failed(F.col("channel") != "PRIMARY_RETAIL")),
        ("retailer_owned_seller_unresolved", failed(F.col("seller_relationship") != "retailer_owned")),
        ("item_price_not_positive", failed(F.col("item_price_minor") == 0)),
        ("vat_inclusion_unresolved", failed(F.col("vat_state") != "included")),
        ("availability_unresolved", failed(F.col("availability") == "unknown")),
        ("not_available_to_purchase", ~F.col("availability").isin("unknown", "in_stock")),
        ("mandatory_delivery_unresolved", ~F.coalesce(delivery_known, F.lit(False))),
    ])
    sum_differs = ~F.col("landed_price_minor").eqNullSafe(F.col("item_price_minor") + amount)
    stage_two = F.array(
        F.when(F.col("landed_eligibility") != "eligible", F.lit("landed_price_eligibility_unresolved"))
        .when(sum_differs, F.lit("landed_price_arithmetic_mismatch"))
    )
    reasons = F.when(F.size("stage_one") > 0, F.col("stage_one")).otherwise(F.array_compact(stage_two))
    return (
        obs.withColumn("stage_one", stage_one)
        .withColumn("reasons", reasons)
        .drop("stage_one")
        .withColumn("status", F.when(F.size("reasons") == 0, F.lit("eligible")).otherwise(F.lit("abstain")))
    )


def reason_codes_sql(obs: DataFrame) -> DataFrame:
    """The persistence rule set: six rules, landed price tested unconditionally."""
    state = F.col("delivery_state")
    reasons = reason_codes([
        ("exact_mpn_unresolved", _identity_unresolved()),
        ("retailer_owned_seller_unresolved", F.col("seller_relationship") != "retailer_owned"),
        ("vat_inclusion_unresolved", F.col("vat_state") != "included"),
        ("availability_unresolved", F.col("availability") == "unknown"),
        ("not_available_to_purchase", ~F.col("availability").isin("unknown", "in_stock")),
        ("mandatory_delivery_unresolved",
         ~state.isin("mandatory_cost_known", "free_delivery_explicit") | F.col("delivery_amount_minor").isNull()),
        ("landed_price_eligibility_unresolved",
         (F.col("landed_eligibility") != "eligible") | F.col("landed_price_minor").isNull()),
    ])
    return obs.withColumn("reasons", reasons)


def qualify_quoted(obs: DataFrame) -> DataFrame:
    """Item-price-only eligibility."""
    reasons = reason_codes([
        ("exact_mpn_unresolved", _identity_unresolved()),
        ("retailer_owned_seller_unresolved", failed(F.col("seller_relationship") != "retailer_owned")),
        ("item_price_not_positive_safe_integer", failed(F.col("item_price_minor") <= 0)),
        ("currency_not_gbp", failed(F.col("currency") != "GBP")),
        ("vat_inclusion_unresolved", failed(F.col("vat_state") != "included")),
    ])
    return obs.withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") == 0, F.lit("eligible")).otherwise(F.lit("abstain"))
    )


# How shops word that an item is gone, in stock, or can be ordered.
GONE_WORDS = "out of stock|sold out|unavailable|not available"
STOCK_WORDS = "in stock|hurry, only [1-9][0-9]* left"
ORDER_WORDS = "available to order"


def classify_availability(state: Column, text: Column, semantics: Column) -> Column:
    """in_stock, available_to_order or null; negative wording beats the state."""
    raw = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    stated = F.coalesce(state, F.lit("unknown"))
    return (
        F.when(F.coalesce(semantics, F.lit("explicit")) != "explicit", F.lit(None))
        .when(raw.rlike(GONE_WORDS), F.lit(None))
        .when(stated.isin("in_stock", "available_to_order"), stated)
        .when((stated == "stated_at_capture") & raw.rlike(STOCK_WORDS), F.lit("in_stock"))
        .when((stated == "stated_at_capture") & raw.contains(ORDER_WORDS), F.lit("available_to_order"))
    )


#: An address with HTTPS and a host, without credentials, query or fragment; the port may be empty or the scheme's own, which a parser drops.
HTTPS = r"(?i:https)://([^/:@?#\\\s]+)(?::(?:443)?)?(/[^?#\s]*)?"
#: Such an address on the archive's host, that holds a capture time and, to the end of its line, another such address.
ARCHIVED = (
    r"(?i:https://web\.archive\.org)(?::(?:443)?)?/web/([0-9]{14})id_/"
    r"https://([^/:@?#\\\s\u0085  ]+)(?::(?:443)?)?(?:/[^?#\s\u0085  ]*)?[\u0085  ]?"
)


def hosts_of(roster: DataFrame) -> Column:
    """A retailer's hosts: the list it has, or its one host."""
    return F.col("https_hosts") if "https_hosts" in roster.columns else F.array("https_host")


def check_source_url(url: Column, archived: Column, observed_at: Column, hosts: Column) -> Column:
    """HTTPS without credentials, foreign port, query or fragment, on one of the retailer's hosts (an array).

    An archive address must embed the capture time and such an address. A
    pattern is read once for each thing taken from it: this runs for every row.
    """
    held = F.array_remove(hosts, "")

    def taken(pattern: str, group: int) -> Column:
        return F.regexp_extract(url, f"^{pattern}[?]?#?$", group)

    stamped = taken(ARCHIVED, 1) == F.date_format(observed_at, "yyyyMMddHHmmss")
    archive_ok = stamped & F.array_contains(held, F.lower(taken(ARCHIVED, 2)))
    return F.coalesce(F.when(archived, archive_ok).otherwise(F.array_contains(held, F.lower(taken(HTTPS, 1)))), F.lit(False))


def _print(salt: str, *facts: Column) -> Column:
    """A 64-bit print of a row of facts.

    Null when any fact is: hashing skips nulls, and an unknown fact agrees with
    nothing.
    """
    known = F.lit(True)
    for fact in facts:
        known = known & fact.isNotNull()
    return F.when(known, F.xxhash64(F.lit(salt), *facts))


def _shared_facts(obs: DataFrame, ledger: DataFrame) -> list[str]:
    """What a row need not state, but must share with its entry if it does; the archive address binds archived rows only."""
    return [c for c in ("response_sha256", "response_bytes", "archive_url") if c in obs.columns and (c != "archive_url" or c in ledger.columns)]


def _short(name: str) -> Column:
    return F.col(name) if name == "response_bytes" else _print(name, F.col(name))


def _keys(kind: str, *of: Column) -> list[Column]:
    # Ids and addresses are long; their prints are what is moved and compared. A null key meets nothing.
    return [_print(f"{kind} {half}", *of) for half in ("a", "b")]


def _needs(obs: DataFrame, shared: list[str]) -> list[Column]:
    """What a row brings to the ledger: the print of its key, of its facts, and what it states beside."""
    shape = F.lit(True)
    for name, value in (("capacity_gb", 32), ("module_count", 2), ("memory_type", "DDR5")):
        if name in obs.columns:
            shape = shape & (F.col(name) == value)
    wanted = F.when(shape, _print(
        "facts", F.lit(True), F.col("mpn"), F.col("amount_minor"), F.col("currency"), F.col("vat_state") == "included", F.col("observed_at")
    ))
    archived = F.col("archived")

    def stated(name: str) -> Column:
        told = F.col(name) != (0 if name == "response_bytes" else "")
        return F.when(told & archived if name == "archive_url" else told, _short(name))

    by_id = _keys("archived", F.col("evidence_id"))
    by_sight = _keys("live", F.col("source_url"), F.col("observed_at"), F.col("seller_display_name"))
    return [
        F.when(archived, by_id[0]).otherwise(by_sight[0]).alias("key_a"), F.when(archived, by_id[1]).otherwise(by_sight[1]).alias("key_b"),
        wanted.alias("want"), *[stated(c).alias(f"want_{c}") for c in shared],
    ]


def _folded_ledger(ledger: DataFrame, shared: list[str], asked: PrintSieve | None = None) -> DataFrame:
    """One row per binding key: the number of its entries, the print of their facts, and what a row may state beside.

    With `asked`, of the keys that it may hold: an entry is dropped before it is
    printed or moved, and goes by those of its ways alone.
    """
    sound = (F.col("http_status") == 200) & F.col("response_sha256").rlike("^[0-9a-f]{64}$") & (F.col("response_bytes") > 0)
    for name, value in (("fact_capacity_gb", 32), ("fact_module_count", 2)):
        if name in ledger.columns:
            sound = sound & (F.col(name) == value)
    captured = F.col("archive_captured_at" if "archive_captured_at" in ledger.columns else "retrieved_at")
    facts = [F.coalesce(sound, F.lit(False)), F.col("fact_mpn"), F.col("fact_amount_minor"), F.col("fact_currency"), F.col("fact_vat_included")]

    def bound(key: list[Column], at: Column) -> Column:
        return F.struct(key[0].alias("key_a"), key[1].alias("key_b"), _print("facts", *facts, at).alias("print"))

    addresses = [F.col("source_url")]
    if "final_url" in ledger.columns:
        # An entry may be reached by the address asked for or the one it ended at.
        addresses.append(F.when(~F.col("final_url").eqNullSafe(F.col("source_url")), F.col("final_url")))
    keys = [_keys("archived", F.col("evidence_id"))] + [_keys("live", url, F.col("retrieved_at"), F.col("seller_display_name")) for url in addresses]
    if asked is not None:
        any_held = F.lit(False)
        for key in keys:
            any_held = any_held | asked.may_hold(key[0])
        ledger = ledger.where(any_held)
    ways = [bound(key, captured if i == 0 else F.col("retrieved_at")) for i, key in enumerate(keys)]
    names = [f"way_{i}" for i in range(len(ways))]
    # Printed before the rows are dealt out: a generator's own expressions are not compiled.
    printed = ledger.select(*[way.alias(n) for way, n in zip(ways, names, strict=True)], *[_short(c).alias(f"held_{c}") for c in shared])
    entries = printed.select(F.inline(F.array(*names)), *[f"held_{c}" for c in shared]).where("key_a IS NOT NULL")
    if asked is not None:
        entries = entries.where(asked.may_hold(F.col("key_a")))
    return entries.groupBy("key_a", "key_b").agg(
        F.count(F.lit(1)).alias("entries"), F.min("print").alias("print"), *[F.min(f"held_{c}").alias(f"held_{c}") for c in shared]
    )


def _agree(shared: list[str]) -> Column:
    """Whether a row's facts are those of its entry."""
    agree = F.col("print") == F.col("want")
    for c in shared:
        agree = agree & (F.col(f"want_{c}").isNull() | F.coalesce(F.col(f"want_{c}") == F.col(f"held_{c}"), F.lit(False)))
    return F.coalesce(agree, F.lit(False))


def match_evidence(obs: DataFrame, ledger: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(observation_id, entry_count, facts_equal): exactly one entry must agree, in facts all known.

    Of every row, or of those whose `mpn` is in `products`, which are picked once
    a row is down to its prints.

    Archived rows are bound by evidence id; live rows by address, time and
    seller. Both kinds meet the ledger in one equi-join on a 128-bit print of
    kind and key, so rows and entries are read once. The ledger is folded to one
    row per binding key beforehand, as a count and a print of its facts, so
    copies of an entry never multiply rows and the fold hashes instead of sorts.
    Facts are compared only within a key, one entry with one row, for which a
    64-bit print is enough.
    Where the tables have them, the kit's shape (32 GB, two modules, DDR5) must
    be stated on both sides, an archived row is held against the entry's capture
    time, and a digest, byte count or archive address that the row states must be
    the entry's.
    """
    shared = _shared_facts(obs, ledger)
    needs = obs.where(F.col("archived").isNotNull()).select("observation_id", "mpn", *_needs(obs, shared))
    if products is not None:
        needs = needs.join(products.select("mpn"), "mpn", "left_semi")
    return needs.join(_folded_ledger(ledger, shared), ["key_a", "key_b"], "left").select(
        "observation_id",
        F.coalesce("entries", F.lit(0)).alias("entry_count"),
        F.when(F.col("entries") == 1, _agree(shared)).alias("facts_equal"),
    )


def with_evidence(obs: DataFrame, ledger: DataFrame, rows: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """The `rows` (of `obs`, with further columns) to which evidence gives no reason against them.

    The rules of `match_evidence`, for callers that want accepted rows alone: a
    row goes to its entry itself, once, where the outcome would have to meet the
    row again by its id. Rows that are neither archived nor live, or without id,
    have no outcome to meet and stay, as they do there.

    Entries that no row asks for stay behind: the keys of `asking` (the rows, or
    more rows that are found with less work) are written once and make a sieve of
    bounded size. What it lets through beyond them costs space and meets no row.
    """
    shared = _shared_facts(obs, ledger)
    needs = _needs(obs, shared)
    bound = rows.withColumn("unbound", F.col("archived").isNull() | F.col("observation_id").isNull()).select("*", *needs)
    # Keys that are not known meet nothing; left in, they would all go to one task.
    prints = settle((rows if asking is None else asking).select(needs[0]).where("key_a IS NOT NULL"))
    folded = _folded_ledger(ledger, shared, PrintSieve(prints, "key_a"))
    met = bound.where("unbound OR key_a IS NOT NULL").join(folded, ["key_a", "key_b"], "left")
    good = F.coalesce(F.col("entries") == 1, F.lit(False)) & _agree(shared)
    return met.where(F.col("unbound") | good).select(*rows.columns)


def restriction_reasons(fields: list[str], flags: list[str]) -> Column:
    """Restriction wording anywhere in the review fields' values, or a true authority flag."""
    text = F.lower(F.concat_ws("\n", *[F.col(f).cast("string") for f in fields]))
    worded = text.rlike("ambigu|restrict|reject|identity_mismatch|mpn_mismatch")
    named = [f for f in flags if any(p in f for p in ("approval", "approved", "allowed", "eligibility", "activation"))]
    raised = F.lit(False)
    for flag in named:
        raised = raised | F.coalesce(F.col(flag), F.lit(False))
    return reason_codes([
        ("record_specific_ambiguity_restriction_or_rejection", worded),
        ("record_authority_drift", raised),
    ])


def apply_tax_resolutions(obs: DataFrame, resolutions: DataFrame, source: str) -> DataFrame:
    """Additive tax-basis overrides (observation_id, before, after)."""
    r = resolutions.select("observation_id", F.col("vat_after").alias("after"), F.lit(True).alias("resolved"))
    return obs.join(r, "observation_id", "left").withColumns({
        "vat_included": F.when(F.col("resolved"), F.col("after")).otherwise(F.col("vat_included")),
        "vat_resolution_source": F.when(F.col("resolved"), F.lit(source)),
    }).drop("after", "resolved")


def check_tax_resolutions(obs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Overrides of unknown rows, or whose stated before-state is not the row's."""
    known = obs.select("observation_id", "vat_included", F.lit(True).alias("known"))
    joined = resolutions.join(known, "observation_id", "left")
    return violations(joined, F.col("observation_id"), [
        ("unknown_observation_in_resolution", F.col("known").isNull()),
        ("resolution_before_state_mismatch", F.col("known") & ~F.col("vat_before").eqNullSafe(F.col("vat_included"))),
    ])


def apply_seller_resolution(obs: DataFrame, aliases: DataFrame, observed: str = "seller_observed") -> DataFrame:
    """Canonical seller by alias; the observed name stays next to it."""
    a = aliases.select(F.col("observed_name").alias(observed), F.col("canonical_name"))
    return obs.join(a, observed, "left").withColumn("seller_resolved", F.coalesce("canonical_name", observed)).drop("canonical_name")


def check_seller_resolution(obs: DataFrame, roster: DataFrame, aliases: DataFrame, observed: str = "seller_observed") -> DataFrame:
    """Aliases to unknown sellers, doubled aliases, roster names used as aliases, unrostered rows."""
    names = roster.select(F.col("seller_name").alias("name"))
    off_roster = aliases.join(names, F.col("canonical_name") == F.col("name"), "left_anti").select(
        F.lit("alias_target_not_on_roster").alias("rule"), F.col("observed_name").alias("key"), F.col("canonical_name").alias("detail")
    )
    own_name = aliases.join(names, F.col("observed_name") == F.col("name"), "left_semi").select(
        F.lit("roster_seller_is_also_alias").alias("rule"), F.col("observed_name").alias("key"), F.lit("").alias("detail")
    )
    # Distinct names are few next to rows, so they are reduced before the join.
    seen = obs.groupBy(F.col(observed).alias("observed_name")).agg(F.count(F.lit(1)).alias("n"))
    # A doubled alias is reported below; the least of its targets by code point stands for it here.
    single = aliases.groupBy("observed_name").agg(F.min("canonical_name").alias("canonical_name"))
    resolved = seen.join(single, "observed_name", "left").withColumn(
        "name", F.coalesce("canonical_name", "observed_name")
    )
    unrostered = resolved.join(names, "name", "left_anti").select(
        F.lit("unrostered_seller").alias("rule"), F.col("observed_name").alias("key"), F.col("n").cast("string").alias("detail")
    )
    return stacked(off_roster, duplicated(aliases, ["observed_name"], "duplicate_alias"), own_name, unrostered)


def quarantine_sentinels(offers: DataFrame, values: list[int]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row counts of what was set aside)."""
    stocked = F.coalesce(F.col("availability") == "in_stock", F.lit(False))
    sentinel = F.col("amount_minor").isin(values)
    counts = offers.agg(
        F.count_if(~stocked).alias("not_in_stock_count"),
        F.count_if(stocked & sentinel).alias("sentinel_price_count"),
        F.count_if(stocked & ~sentinel).alias("kept_count"),
    )
    return offers.where(stocked & ~sentinel), counts


def check_contract(obs: DataFrame) -> DataFrame:
    """Structural rules of a landed-price observation -> (rule, key, detail)."""
    slug = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
    mpn = "^[A-Z0-9]+(?:-[A-Z0-9]+)*$"

    def not_one_of(name: str, *allowed: str) -> Column:
        return failed(~F.col(name).isin(*allowed))

    def not_like(name: str, pattern: str) -> Column:
        return failed(~F.col(name).rlike(pattern))

    instant = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rules = [
        ("observation_id_not_slug", not_like("observation_id", slug)),
        ("observed_at_not_instant", ~valid_instant(instant)),
        ("product_key_not_slug", not_like("product_key", slug)),
        ("mpn_expected_not_normalised", not_like("mpn_expected", mpn)),
        ("mpn_observed_not_normalised", F.col("mpn_observed").isNotNull() & ~F.col("mpn_observed").rlike(mpn)),
        ("match_basis_unknown", not_one_of("match_basis", "exact_mpn", "unresolved")),
        ("channel_unknown", not_one_of("channel", "PRIMARY_RETAIL", "MARKETPLACE")),
        ("retailer_key_not_slug", not_like("retailer_key", slug)),
        ("retailer_name_blank", failed((F.trim("retailer_name") != F.col("retailer_name")) | (F.length("retailer_name") == 0))),
        ("seller_relationship_unknown", not_one_of("seller_relationship", "retailer_owned", "third_party", "unresolved")),
        ("item_price_negative", failed(F.col("item_price_minor") < 0)),
        ("currency_not_gbp", not_one_of("currency", "GBP")),
        ("vat_state_unknown", not_one_of("vat_state", "included", "excluded", "unknown")),
        ("availability_unknown_value", not_one_of("availability", "in_stock", "out_of_stock", "unknown")),
        ("delivery_amount_negative", F.coalesce(F.col("delivery_amount_minor") < 0, F.lit(False))),
        ("delivery_state_unknown_value", not_one_of("delivery_state", "mandatory_cost_known", "free_delivery_explicit", "unknown")),
        ("landed_eligibility_unknown_value", not_one_of("landed_eligibility", "eligible", "unresolved")),
        ("landed_price_negative", F.coalesce(F.col("landed_price_minor") < 0, F.lit(False))),
    ]
    return stacked(
        violations(obs, F.col("observation_id"), rules),
        duplicated(obs, ["observation_id"], "observation_id_not_unique"),
    )


def check_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Schema-level part of a contract: missing or unknown columns, by name."""
    have, want = set(df.columns), set(expected)
    return [f"missing {c}" for c in sorted(want - have)] + [f"unknown {c}" for c in sorted(have - want)]


def check_locks(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Rows where a named authority flag is missing or not false."""
    rules = [(f"{f}_must_remain_false", ~F.col(f).eqNullSafe(F.lit(False))) for f in flags]
    return violations(df, F.col(key), rules)


def check_landed_arithmetic(obs: DataFrame) -> DataFrame:
    """Row constraints of the persisted form, re-deriving the reason list."""
    state, amount = F.col("delivery_state"), F.col("delivery_amount_minor")
    consistent = (
        ((state == "free_delivery_explicit") & F.coalesce(amount == 0, F.lit(False)))
        | ((state == "mandatory_cost_known") & amount.isNotNull())
        | ((state == "unknown") & amount.isNull())
    )
    landed = F.col("landed_price_minor")
    return violations(obs, F.col("observation_id"), [
        ("delivery_state_amount_disagree", ~consistent),
        ("landed_state_amount_disagree", (F.col("landed_eligibility") == "eligible") != landed.isNotNull()),
        ("landed_not_item_plus_delivery", landed.isNotNull() & ~landed.eqNullSafe(F.col("item_price_minor") + amount)),
        ("recorded_reasons_differ", F.col("recorded_reasons") != F.array_join("reasons", ",")),
        ("status_reasons_disagree", (F.col("recorded_status") == "eligible") != (F.size("reasons") == 0)),
    ])
