"""Duplicate, order, gap, revision and claim audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions.nested import json_leaves
from pricetrail.functions.reasons import duplicated, failed, stacked, violations


def _collision_keys(obs: DataFrame) -> DataFrame:
    return obs.select(
        F.coalesce("seller_legal_name", "seller_display_name").alias("seller"),
        F.when(F.col("seller_legal_name").isNotNull(), F.lit("legal_name"))
        .otherwise(F.lit("display_name_legal_entity_unresolved")).alias("seller_identity_basis"),
        "mpn", F.to_date("observed_at").alias("utc_date"), "observation_id", "tranche_id",
    )


COLLISION = ["seller", "mpn", "utc_date"]


def collision_audit(obs: DataFrame) -> DataFrame:
    """Seller, number and UTC date observed more than once, with counts.

    The rows of a collision are `collision_members`; they are never gathered
    into one value. Tranches fold per group before they are counted.
    """
    per_tranche = _collision_keys(obs).groupBy(*COLLISION, "tranche_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seller_identity_basis").alias("basis"), F.min("observation_id").alias("first_id")
    )
    return per_tranche.groupBy(*COLLISION).agg(
        F.min("basis").alias("seller_identity_basis"), F.sum("n").alias("observation_count"),
        F.count(F.lit(1)).alias("tranche_count"), F.min("first_id").alias("first_observation_id"),
    ).where("observation_count > 1")


def collision_members(obs: DataFrame) -> DataFrame:
    """Every row that takes part in a collision."""
    keyed = _collision_keys(obs)
    crowded = keyed.groupBy(*COLLISION).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(crowded, COLLISION, "left_semi").select(*COLLISION, "observation_id", "tranche_id")


def collision_verdict(collisions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return collisions.agg(n.alias("collision_count")).select(
        "collision_count",
        (F.col("collision_count") == 0).alias("date_level_diagnostic_integration_allowed"),
        F.when(F.col("collision_count") > 0, F.lit("BLOCKED_DUPLICATE_SELLER_MPN_UTC_DATE"))
        .otherwise(F.lit("NO_COLLISIONS_DETECTED")).alias("reason_code"),
    )


def unresolved_sellers(obs: DataFrame) -> DataFrame:
    return obs.where("seller_legal_name IS NULL").select("seller_display_name").distinct()


def append_order_violations(rows: DataFrame) -> DataFrame:
    """Rows (tranche_id, created_at, observation_id, observed_at, line) against append order.

    Tranches are folded to one row each; the ordered pass over them is the only
    unpartitioned window and holds one row per tranche.
    """
    tranches = rows.groupBy("tranche_id").agg(F.max("created_at").alias("created_at"), F.max("observed_at").alias("last_seen"))
    w = Window.orderBy("created_at", "tranche_id")
    earlier = F.max("last_seen").over(w.rowsBetween(Window.unboundedPreceding, -1))
    order = tranches.select("tranche_id", F.lag("created_at").over(w).alias("previous_created"), "created_at", earlier.alias("seen_before"))
    shape = violations(order, F.col("tranche_id"), [
        ("created_at_not_increasing", F.coalesce(F.col("created_at") <= F.col("previous_created"), F.lit(False))),
    ])
    placed = rows.join(order.select("tranche_id", "seen_before"), "tranche_id")
    each = violations(placed, F.col("observation_id"), [
        ("observed_after_own_tranche", F.col("observed_at") > F.col("created_at")),
        ("backdated_before_earlier_tranche", F.coalesce(F.col("observed_at") <= F.col("seen_before"), F.lit(False))),
    ])
    dated = rows.withColumn("date", F.to_date("observed_at"))
    return stacked(
        shape, each,
        duplicated(rows, ["observation_id"], "observation_id_not_unique"),
        duplicated(dated, ["line", "date"], "line_date_not_unique"),
    )


def missed_slots(runs: DataFrame, now: str, hour: int, minute: int, recorded: DataFrame | None = None) -> DataFrame:
    """Daily slots strictly after the last run and before now, today excluded."""
    last = runs.agg(F.max("started_at").alias("last_run")).where("last_run IS NOT NULL")
    current = F.lit(now).cast("timestamp")
    day = F.explode(F.sequence(F.to_date("last_run"), F.to_date(current), F.expr("INTERVAL 1 DAY")))
    slot = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + (hour * 3600 + minute * 60))
    slots = (
        last.where(F.col("last_run") <= current).withColumn("day", day).withColumn("slot", slot)
        .where((F.col("slot") > F.col("last_run")) & (F.col("slot") < current) & (F.col("day") != F.to_date(current)))
        .select(F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss").alias("scheduled_for"))
    )
    if recorded is not None:
        slots = slots.join(recorded.select("scheduled_for"), "scheduled_for", "left_anti")
    return slots.withColumn("state", F.lit("unobserved_no_run"))


def unserved_slots(runs: DataFrame, hour: int, minute: int) -> DataFrame:
    """Slots between consecutive runs that no run served, over the whole ledger."""
    days = runs.select(F.to_date("started_at").alias("day")).distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    spine = span.select(F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 DAY"))).alias("day"))
    slot = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + (hour * 3600 + minute * 60))
    return spine.join(days, "day", "left_anti").select(F.date_format(slot, "yyyy-MM-dd'T'HH:mm:ss").alias("scheduled_for"))


def open_gaps(slots: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    return slots.join(acknowledgements.select("scheduled_for"), "scheduled_for", "left_anti")


def refused_acknowledgements(slots: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Acknowledgements of slots never flagged, or given more than once."""
    unknown = acknowledgements.join(slots.select("scheduled_for"), "scheduled_for", "left_anti").select(
        F.lit("slot_never_flagged").alias("rule"), F.col("scheduled_for").alias("key"), F.lit("").alias("detail")
    )
    return stacked(unknown, duplicated(acknowledgements, ["scheduled_for"], "slot_acknowledged_twice"))


def seller_reachability(obs: DataFrame, registry: DataFrame) -> DataFrame:
    """Targets and live observations per seller of the registry."""
    targets = registry.groupBy("seller_display_name").agg(F.count(F.lit(1)).alias("target_count"))
    live = obs.groupBy("seller_display_name").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("last_at"))
    return targets.join(live, "seller_display_name", "left").select(
        "seller_display_name", "target_count", F.coalesce("n", F.lit(0)).alias("observation_count"), "last_at",
        F.when(F.col("n").isNotNull(), F.lit("collected")).otherwise(F.lit("not yet collected")).alias("reachability"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Per run: attempted, retained, abstained and outcome."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("targets_attempted"),
        F.count_if("usable").alias("observations_retained"),
        F.count_if(~F.col("usable")).alias("abstentions"),
    ).withColumn(
        "outcome", F.when(F.col("observations_retained") > 0, F.lit("completed")).otherwise(F.lit("completed_with_no_usable_readings"))
    )


def abstention_reasons(results: DataFrame) -> DataFrame:
    """Per run, how often each first reason stopped a target."""
    reason = F.coalesce(F.get("reasons", F.lit(0)), F.lit("UNKNOWN")).alias("reason")
    return results.where(~F.col("usable")).groupBy("run_id", reason).agg(F.count(F.lit(1)).alias("n"))


def reconstruct_runs(rows: DataFrame) -> DataFrame:
    """One run row per tranche that predates the ledger."""
    return rows.groupBy("tranche_id").agg(F.max("created_at").alias("started_at"), F.count(F.lit(1)).alias("targets_attempted")).select(
        F.concat(F.lit("run-"), F.date_format("started_at", "yyyyMMdd'T'HHmmss'Z'")).alias("run_id"),
        "tranche_id", "started_at", F.lit("completed").alias("outcome"), "targets_attempted",
        F.col("targets_attempted").alias("observations_retained"), F.lit(0).cast("long").alias("abstentions"),
        F.lit(True).alias("reconstructed"),
    )


def with_prior_revision(log: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """Each revision next to its predecessor, met on (key, revision - 1).

    An equi-join on the numbered pair, so one much-revised record spreads over
    all tasks. The predecessor columns carry the prefix `prior_`. Of a doubled
    revision, the row of least carried values is the predecessor.
    """
    prior = log.groupBy(key, (F.col("revision") + 1).alias("revision")).agg(F.min(F.struct(*carry)).alias("_prior"))
    prior = prior.select(key, "revision", *[F.col("_prior")[c].alias(f"prior_{c}") for c in carry], F.lit(True).alias("has_prior"))
    return log.join(prior, [key, "revision"], "left")


def check_revision_chain(log: DataFrame, key: str) -> DataFrame:
    """Starts at 1 without parent, +1 each, parent hash is the previous hash, hashes unique."""
    j = with_prior_revision(log, key, ["revision_hash"])
    has_prior = F.col("has_prior").isNotNull()
    first = F.col("revision") == 1
    return stacked(
        violations(j, F.concat_ws("@", key, F.col("revision").cast("string")), [
            ("first_revision_has_parent", first & F.col("supersedes_revision_hash").isNotNull()),
            ("revision_gap", ~first & ~has_prior),
            ("parent_hash_differs", ~first & has_prior & ~F.col("supersedes_revision_hash").eqNullSafe(F.col("prior_revision_hash"))),
        ]),
        duplicated(log, ["revision_hash"], "revision_hash_not_unique"),
        duplicated(log, [key, "revision"], "revision_not_unique"),
    )


def current_revisions(log: DataFrame, key: str) -> DataFrame:
    """Latest row per id, folded map-side."""
    rest = [c for c in log.columns if c not in (key, "revision")]
    return log.groupBy(key).agg(F.max(F.struct("revision", *rest)).alias("last")).select(key, "last.*")


def presentation_order(overlays: DataFrame) -> DataFrame:
    """Latest placed and reviewed overlays in display order."""
    shown = current_revisions(overlays, "overlay_id").where(
        "placement_state = 'placed_private' AND review_state = 'reviewed_private'"
    )
    return shown.select("overlay_id", "display_order").orderBy("display_order", "overlay_id")


# What an overlay revision states besides its place in the chain, and the closed lists of its words.
OVERLAY_FIELDS = [
    "title", "event_revision_ref", "numeric_revision_ref", "display_start", "display_end", "date_precision", "possible_effect_label",
    "causal_language_level", "uncertainty", "evidence_panel_ref", "placement_state", "unavailable_reason", "display_order", "creator_id",
    "review_state", "reviewer_id",
]
ACTIONS = ["add", "edit", "remove", "reorder", "review"]
ACTOR_TYPES = ["fixture_editor", "human_editor_fixture"]
STABLE_ID = "^[a-z0-9]+(-[a-z0-9]+)*$"


def check_overlays(overlays: DataFrame) -> DataFrame:
    """What every overlay revision must state, whatever was done to it. Fields the table lacks are not judged."""
    c = F.col
    date = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    missing = c("display_start").isNull() | (c("date_precision") == "unresolved") | (c("placement_state") == "unavailable")
    reviewed = c("review_state") == "reviewed_private"
    told = c("unavailable_reason").eqNullSafe(F.lit("UNAVAILABLE_EVENT_DATE_OR_REVISION"))
    rules = [
        (["display_start"], "display_start_malformed", F.coalesce(~c("display_start").rlike(date), F.lit(False))),
        (["display_end"], "display_end_malformed", F.coalesce(~c("display_end").rlike(date), F.lit(False))),
        (["display_start", "display_end"], "date_range_reversed", F.coalesce(c("display_end") < c("display_start"), F.lit(False))),
        (["date_precision"], "date_precision_unknown", failed(~c("date_precision").isin("day", "month", "range", "unresolved"))),
        (["possible_effect_label"], "possible_effect_label_missing", failed(F.length("possible_effect_label") == 0)),
        (["causal_language_level"], "causal_level_not_permitted", failed(~c("causal_language_level").isin("descriptive", "temporal_association", "contributory_hypothesis"))),
        (["uncertainty"], "uncertainty_missing", failed(F.length("uncertainty") == 0)),
        (["evidence_panel_ref"], "evidence_panel_ref_malformed", failed(~c("evidence_panel_ref").rlike(STABLE_ID))),
        (["placement_state"], "placement_state_unknown", failed(~c("placement_state").isin("placed_private", "unavailable", "withdrawn"))),
        (["unavailable_reason"], "unavailable_reason_unknown", c("unavailable_reason").isNotNull() & ~told),
        (["display_start", "date_precision", "placement_state", "unavailable_reason"], "unavailability_not_stated", F.coalesce(missing, F.lit(False)) != told),
        (["display_order"], "display_order_negative", failed(c("display_order") < 0)),
        (["creator_id"], "creator_id_malformed", failed(~c("creator_id").rlike(STABLE_ID))),
        (["review_state"], "review_state_unknown", failed(~c("review_state").isin("draft", "review_pending", "reviewed_private", "withdrawn"))),
        (["reviewer_id"], "reviewer_id_malformed", F.coalesce(~c("reviewer_id").rlike(STABLE_ID), F.lit(False))),
        (["review_state", "reviewer_id"], "reviewed_without_reviewer", F.coalesce(reviewed, F.lit(False)) != c("reviewer_id").isNotNull()),
        (["reviewer_id", "creator_id"], "creator_is_reviewer", F.coalesce(c("reviewer_id") == c("creator_id"), F.lit(False))),
        (["review_state", "display_start", "date_precision", "placement_state"], "unavailable_but_reviewed", F.coalesce(reviewed & missing, F.lit(False))),
        (["placement_state", "review_state"], "withdrawn_but_not_in_review", F.coalesce((c("placement_state") == "withdrawn") & (c("review_state") != "withdrawn"), F.lit(False))),
    ]
    held = set(overlays.columns)
    return violations(overlays, F.concat_ws("@", "overlay_id", F.col("revision").cast("string")), [(rule, cond) for needs, rule, cond in rules if held >= set(needs)])


def audit_operations(ops: DataFrame) -> DataFrame:
    """Legality of add/edit/remove/reorder/review against the prior revision.

    Every field of an overlay that the table holds is compared, so an action
    changes nothing it does not name. Unknown actions and kinds of actor are
    reported as such.
    """
    fields = [f for f in OVERLAY_FIELDS if f in ops.columns]
    j = with_prior_revision(ops, "overlay_id", fields)
    has_prior = F.col("has_prior").isNotNull()
    action = F.col("action")
    changed = F.array_compact(F.array(*[F.when(has_prior & ~F.col(f).eqNullSafe(F.col(f"prior_{f}")), F.lit(f)) for f in fields]))

    def only(*fields: str) -> Column:
        return F.size(F.array_except("changed", F.array(*[F.lit(f) for f in fields]))) == 0

    j = j.withColumn("changed", changed)
    return violations(j, F.concat_ws("@", "overlay_id", F.col("revision").cast("string")), [
        ("action_unsupported", failed(~action.isin(*ACTIONS))),
        ("actor_type_unsupported", failed(~F.col("actor_type").isin(*ACTOR_TYPES))),
        ("actor_id_malformed", failed(~F.col("actor_id").rlike(STABLE_ID))),
        ("add_overwrites", (action == "add") & has_prior),
        ("add_bypasses_review", (action == "add") & ((F.col("review_state") == "reviewed_private") | F.col("reviewer_id").isNotNull())),
        ("add_creator_is_not_actor", (action == "add") & (F.col("creator_id") != F.col("actor_id"))),
        ("needs_existing_overlay", action.isin(*ACTIONS[1:]) & ~has_prior),
        ("edit_must_return_to_review", (action == "edit") & (F.col("review_state") != "review_pending")),
        ("remove_must_withdraw", (action == "remove") & ((F.col("placement_state") != "withdrawn") | (F.col("review_state") != "withdrawn"))),
        ("remove_changes_other_fields", (action == "remove") & has_prior & ~only("placement_state", "review_state", "reviewer_id")),
        ("reorder_changes_nothing", (action == "reorder") & has_prior & F.col("display_order").eqNullSafe(F.col("prior_display_order"))),
        ("reorder_must_return_to_review", (action == "reorder") & ((F.col("review_state") != "review_pending") | F.col("reviewer_id").isNotNull())),
        ("reorder_changes_other_fields", (action == "reorder") & has_prior & ~only("display_order", "review_state", "reviewer_id")),
        ("review_by_non_human", (action == "review") & (F.col("actor_type") != "human_editor_fixture")),
        ("review_of_unplaced", (action == "review") & (F.col("placement_state") != "placed_private")),
        ("review_state_not_private", (action == "review") & (F.col("review_state") != "reviewed_private")),
        ("review_of_causal_claim", (action == "review") & (F.col("causal_language_level") == "contributory_hypothesis")),
        ("review_without_pending", (action == "review") & has_prior & (F.col("prior_review_state") != "review_pending")),
        ("creator_reviews_own_work", (action == "review") & has_prior & (F.col("actor_id") == F.col("prior_creator_id"))),
        ("reviewer_is_not_actor", (action == "review") & ~F.col("reviewer_id").eqNullSafe(F.col("actor_id"))),
        ("review_changes_other_fields", (action == "review") & has_prior & ~only("review_state", "reviewer_id")),
    ])


def check_captures(captures: DataFrame, items: DataFrame) -> DataFrame:
    """Retained text agrees with its stated length and digest; its source exists."""
    known = items.select(F.col("source_item_id"), F.lit(True).alias("known_item"))
    j = captures.join(known, "source_item_id", "left")
    return stacked(
        violations(j, F.col("capture_id"), [
            ("source_item_unknown", F.col("known_item").isNull()),
            ("byte_count_differs", failed(F.octet_length("retained_text") != F.col("byte_count"))),
            ("sha256_differs", failed(F.sha2("retained_text", 256) != F.col("sha256"))),
        ]),
        duplicated(captures, ["capture_id"], "capture_id_not_unique"),
    )


def check_claims(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """Claims bind an existing capture by digest and quote it literally."""
    c = captures.select("capture_id", F.col("sha256").alias("bound_sha256"), "retained_text")
    j = claims.join(c, "capture_id", "left")
    there = F.col("bound_sha256").isNotNull()
    return stacked(
        violations(j, F.col("claim_id"), [
            ("capture_unknown", ~there),
            ("capture_sha256_differs", there & failed(F.col("capture_sha256") != F.col("bound_sha256"))),
            ("extract_blank", failed(F.length("exact_extract") == 0)),
            ("extract_not_in_capture", there & failed(~F.contains("retained_text", "exact_extract"))),
            ("status_unknown", failed(~F.col("status").isin("verified", "disputed"))),
        ]),
        duplicated(claims, ["claim_id"], "claim_id_not_unique"),
    )


def check_relations(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Duplicates share a lineage, contradictions do not, both ends exist."""
    def end(name: str) -> DataFrame:
        return claims.select(F.col("claim_id").alias(f"{name}_claim_id"), F.col("duplicate_lineage_id").alias(f"{name}_lineage"))

    j = edges.join(end("from"), "from_claim_id", "left").join(end("to"), "to_claim_id", "left")
    both = F.col("from_lineage").isNotNull() & F.col("to_lineage").isNotNull()
    equal = F.col("from_lineage") == F.col("to_lineage")
    return stacked(
        violations(j, F.col("relationship_id"), [
            ("claim_unknown", ~both),
            ("duplicates_split_lineage", both & (F.col("relationship") == "duplicates") & ~equal),
            ("contradiction_within_lineage", both & (F.col("relationship") == "contradicts") & equal),
        ]),
        duplicated(edges, ["relationship_id"], "relationship_id_not_unique"),
    )


def check_events(events: DataFrame, references: DataFrame, claims: DataFrame) -> DataFrame:
    """Claim references (event_id, revision, kind, claim_id, claim_revision_hash) bind exact revisions."""
    c = claims.select("claim_id", F.col("claim_revision_hash").alias("held_hash"))
    j = references.join(c, "claim_id", "left")
    key = F.concat_ws("@", "event_id", F.col("revision").cast("string"))
    unbound = violations(j, key, [
        ("claim_revision_not_bound", ~F.col("claim_revision_hash").eqNullSafe(F.col("held_hash")) | F.col("held_hash").isNull()),
    ], F.col("claim_id"))
    against = references.where("kind = 'contradictory'").select("event_id", "revision").distinct().withColumn("against", F.lit(True))
    e = events.join(against, ["event_id", "revision"], "left")
    state = violations(e, key, [
        ("contested_without_contradiction", (F.col("factual_state") == "contested") & F.col("against").isNull()),
        ("date_precision_inconsistent", F.col("event_date").isNull() != (F.col("date_precision") == "unresolved")),
        ("causal_level_unknown", failed(~F.col("causal_language_level").isin("descriptive", "temporal_association"))),
    ])
    return stacked(unbound, state)


def check_reviews(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Reviews bind an exact event revision and are not by its author."""
    e = events.select(F.col("event_id").alias("record_id"), "revision_hash", "author_id", F.lit(True).alias("bound"))
    j = reviews.join(e, ["record_id", "revision_hash"], "left")
    return stacked(
        violations(j, F.col("review_id"), [
            ("event_revision_not_bound", F.col("bound").isNull()),
            ("author_reviews_own_revision", F.coalesce(F.col("reviewer_id") == F.col("author_id"), F.lit(False))),
            ("decision_not_permitted", failed(F.col("decision") != "changes_requested")),
        ]),
        duplicated(reviews, ["review_id"], "review_id_not_unique"),
    )


# Keys that carry a price or a series parameter.
NUMERIC_KEYS = ["amount_minor", "price", "weight", "link_factor", "deflator", "reference_period", "imputed_value", "gap_fill"]


def check_numeric_coupling(rows: DataFrame, key: str, json_column: str, banned: list[str] = NUMERIC_KEYS) -> DataFrame:
    """Banned keys at any depth of a free-form JSON column; texts that are no JSON are reported, nulls have no keys."""
    leaves = json_leaves(rows.select(key, json_column), json_column)
    who = F.col(f"row.{key}").cast("string").alias("key")
    met = leaves.select(who, F.explode(F.array_intersect("names", F.array(*[F.lit(b) for b in banned]))).alias("detail")).distinct()
    broken = leaves.where(F.col("leaf").isNull() & (F.size("names") == 0) & F.col(f"row.{json_column}").isNotNull())
    return stacked(
        met.select(F.lit("numeric_key_present").alias("rule"), "key", "detail"),
        broken.select(F.lit("json_malformed").alias("rule"), who, F.lit("").alias("detail")),
    )


def coupled_columns(df: DataFrame, banned: list[str] = NUMERIC_KEYS) -> list[str]:
    """The same rule for typed columns: dotted paths with a banned name."""
    from pyspark.sql import types as T

    found: list[str] = []

    def walk(dtype: T.DataType, path: str) -> None:
        if isinstance(dtype, T.StructType):
            for field in dtype.fields:
                here = f"{path}.{field.name}" if path else field.name
                if field.name in banned:
                    found.append(here)
                walk(field.dataType, here)
        elif isinstance(dtype, T.ArrayType):
            walk(dtype.elementType, f"{path}[]")
        elif isinstance(dtype, T.MapType):
            walk(dtype.valueType, f"{path}{{}}")

    walk(df.schema, "")
    return found


def check_explanations(explanations: DataFrame, movements: DataFrame) -> DataFrame:
    """Known movement, permitted causal level, search done, attributable source."""
    m = movements.select("movement_id", F.lit(True).alias("known")).distinct()
    j = explanations.join(m, "movement_id", "left")

    def blank(name: str) -> Column:
        return failed(F.length(F.trim(name)) == 0)

    host = F.regexp_extract("source_url", "^https://([^/?#]+)", 1)
    date = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    return violations(j, F.col("explanation_id"), [
        ("unknown_movement", F.col("known").isNull()),
        ("causal_level_not_permitted",
         failed(~F.col("causal_language_level").isin("descriptive", "temporal_association", "contributory_hypothesis"))),
        ("counterevidence_search_missing",
         failed(~(F.col("search_performed") & F.col("search_result").isin("none_identified", "counterevidence_recorded")))),
        ("response_sha256_not_digest", failed(F.length("response_sha256") != 64)),
        ("quote_missing", blank("minimal_quote")),
        ("source_title_missing", blank("source_title")),
        ("source_publisher_missing", blank("source_publisher")),
        ("source_author_missing", blank("source_author")),
        ("source_url_not_https", failed(~F.col("source_url").startswith("https://"))),
        ("source_url_synthetic", host.rlike(r"(^|\.)fixture\.invalid(:|$)")),
        ("source_date_malformed", failed(~F.col("published_on").rlike(date)) | failed(~F.col("accessed_on").rlike(date))),
    ])
