"""Audit queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.periods import instant_text
from pricetrail.functions.reasons import stacked
from pricetrail.operators import audit
from pricetrail.operators import movements
from pricetrail.plans.registry import register
from pricetrail.plans.views import VIEWS
from pricetrail.sources.adapter import catalogue, observations
from pricetrail.sources.tables import literal_table, table

VIEWS.update({
    "v_tranche_row": """
SELECT *, tranche_month AS tranche_id, CASE WHEN tranche_month LIKE '%-06' THEN CAST(tranche_month || '-01' AS TIMESTAMP)
  ELSE CAST(tranche_month || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH END AS created_at
FROM (SELECT *, seller_fine AS seller_display_name, mpn || '|' || coalesce(seller_legal_name, '') AS line,
  strftime(date_trunc('month', observed_at) + CASE WHEN k_qty = 3 AND k_line = 7 THEN INTERVAL 1 MONTH WHEN k_qty = 3 AND k_line = 6 THEN -INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END, '%Y-%m') AS tranche_month
  FROM v_obs)
""",
    "v_rev": """
SELECT 'rec-' || user_id AS record_id, revision, sha256('e' || event_id) AS revision_hash,
  CASE WHEN revision > 1 THEN sha256('e' || (before + CASE WHEN value > 200 THEN 1 ELSE 0 END)) WHEN value > 100 THEN sha256('none') END AS supersedes_revision_hash,
  event_type, value, event_id, author
FROM (SELECT *, row_number() OVER w AS revision, lag(event_id) OVER w AS before, 'a' || (event_id % 7) AS author FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE NOT (event_type = 'error' AND value < 2)
""",
    "v_op": """
SELECT 'ov-' || user_id AS overlay_id, revision, action, 'a' || (event_id % 5) AS actor_id,
  CASE WHEN event_id % 3 = 0 THEN 'fixture_editor' ELSE 'human_editor_fixture' END AS actor_type,
  CASE WHEN value > 150 THEN 'Edited' ELSE 'Title' END AS title,
  CASE WHEN action = 'reorder' THEN revision ELSE 1 END AS display_order,
  CASE WHEN action = 'remove' AND value > 5 THEN 'withdrawn' WHEN value > 250 THEN 'unplaced' ELSE 'placed_private' END AS placement_state,
  CASE WHEN action = 'remove' THEN 'withdrawn' WHEN action = 'review' AND value > 5 THEN 'reviewed_private' WHEN value > 220 THEN 'draft' ELSE 'review_pending' END AS review_state,
  CASE WHEN action = 'add' AND value < 200 THEN 'a' || (event_id % 5) ELSE 'a' || (user_id % 5) END AS creator_id,
  CASE WHEN action = 'review' AND value > 10 THEN 'a' || (event_id % 5) WHEN value < 10 THEN 'a9' END AS reviewer_id,
  CASE WHEN value > 180 THEN 'contributory_hypothesis' ELSE 'descriptive' END AS causal_language_level
FROM (SELECT *, row_number() OVER w AS revision, CASE WHEN row_number() OVER w = 1 THEN 'add' WHEN event_type = 'view' THEN 'review' WHEN event_type = 'error' THEN 'remove'
  WHEN event_type = 'purchase' THEN 'reorder' WHEN event_type = 'signup' AND value < 1 THEN 'add' ELSE 'edit' END AS action FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
""",
})


def tranche_rows(spark: SparkSession, root: str) -> DataFrame:
    """Observations assigned to monthly batches; a few land one batch off."""
    o = observations(spark, root)
    shift = F.when((F.col("k_qty") == 3) & (F.col("k_line") == 7), 1).when((F.col("k_qty") == 3) & (F.col("k_line") == 6), -1).otherwise(0)
    month = F.add_months(F.trunc("observed_at", "month"), shift)
    created = F.when(F.month(month) == 6, month).otherwise(F.add_months(month, 1)).cast("timestamp")
    return o.select(
        "observation_id", "observed_at", "mpn", F.col("seller_fine").alias("seller_display_name"), "seller_legal_name", "capture_kind", "k_qty",
        F.concat_ws("|", "mpn", F.coalesce("seller_legal_name", F.lit(""))).alias("line"),
        F.date_format(month, "yyyy-MM").alias("tranche_id"), created.alias("created_at"),
    )


COLLISION_SQL = """SELECT coalesce(seller_legal_name, seller_display_name) AS seller,
  min(CASE WHEN seller_legal_name IS NOT NULL THEN 'legal_name' ELSE 'display_name_legal_entity_unresolved' END) AS seller_identity_basis,
  mpn, strftime(observed_at, '%Y-%m-%d') AS utc_date, count(*) AS observation_count, count(DISTINCT tranche_id) AS tranche_count, min(observation_id) AS first_observation_id
FROM v_tranche_row GROUP BY 1, 3, 4 HAVING count(*) > 1"""


@register("collision_audit", COLLISION_SQL)
def _(spark, root):
    return audit.collision_audit(tranche_rows(spark, root)).withColumn("utc_date", F.col("utc_date").cast("string"))


@register("collision_members", """
SELECT * FROM (SELECT coalesce(seller_legal_name, seller_display_name) AS seller, mpn, strftime(observed_at, '%Y-%m-%d') AS utc_date, observation_id, tranche_id FROM v_tranche_row)
QUALIFY count(*) OVER (PARTITION BY seller, mpn, utc_date) > 1""")
def _(spark, root):
    return audit.collision_members(tranche_rows(spark, root)).withColumn("utc_date", F.col("utc_date").cast("string"))


@register("collision_verdict", f"""
SELECT count(*) AS collision_count, count(*) = 0 AS date_level_diagnostic_integration_allowed,
  CASE WHEN count(*) > 0 THEN 'BLOCKED_DUPLICATE_SELLER_MPN_UTC_DATE' ELSE 'NO_COLLISIONS_DETECTED' END AS reason_code FROM ({COLLISION_SQL})""")
def _(spark, root):
    return audit.collision_verdict(audit.collision_audit(tranche_rows(spark, root)))


@register("unresolved_sellers", "SELECT DISTINCT seller_fine AS seller_display_name FROM v_obs WHERE seller_legal_name IS NULL")
def _(spark, root):
    return audit.unresolved_sellers(tranche_rows(spark, root))


@register("append_order_violations", """
WITH t AS (SELECT tranche_id, max(created_at) AS created_at, max(observed_at) AS last_seen FROM v_tranche_row GROUP BY 1),
o AS (SELECT *, lag(created_at) OVER (ORDER BY created_at, tranche_id) AS prev,
  max(last_seen) OVER (ORDER BY created_at, tranche_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)
SELECT 'created_at_not_increasing' AS rule, tranche_id AS key, '' AS detail FROM o WHERE created_at <= prev
UNION ALL SELECT 'observed_after_own_tranche', observation_id, '' FROM v_tranche_row WHERE observed_at > created_at
UNION ALL SELECT 'backdated_before_earlier_tranche', observation_id, '' FROM v_tranche_row r JOIN o ON o.tranche_id = r.tranche_id WHERE observed_at <= seen
UNION ALL SELECT 'observation_id_not_unique', observation_id, CAST(count(*) AS VARCHAR) FROM v_tranche_row GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'line_date_not_unique', line || '|' || strftime(observed_at, '%Y-%m-%d'), CAST(count(*) AS VARCHAR) FROM v_tranche_row GROUP BY 2 HAVING count(*) > 1""")
def _(spark, root):
    return audit.append_order_violations(tranche_rows(spark, root))


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Error events as collection runs; on every fifth day of a month none runs, its events count as the day before's."""
    at = F.col("ts").cast("timestamp")
    started = F.when(F.dayofmonth("ts") % 5 == 3, at - F.expr("INTERVAL 1 DAY")).otherwise(at)
    return table(spark, root, "events").where("event_type = 'error'").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"), started.alias("started_at")
    )


RUNS = "(SELECT 'run-' || event_id AS run_id, CASE WHEN day(ts) % 5 = 3 THEN ts - INTERVAL 1 DAY ELSE ts END AS started_at FROM events WHERE event_type = 'error')"
MISSED = f"""SELECT strftime(d + INTERVAL 690 MINUTE, '%Y-%m-%dT%H:%M:%S') AS scheduled_for, 'unobserved_no_run' AS state FROM
  (SELECT unnest(generate_series(date_trunc('day', z), TIMESTAMP '2024-02-20', INTERVAL 1 DAY)) AS d, z FROM (SELECT max(started_at) AS z FROM {RUNS}))
  WHERE d + INTERVAL 690 MINUTE > z AND d + INTERVAL 690 MINUTE < TIMESTAMP '2024-02-20 12:00:00' AND d < TIMESTAMP '2024-02-20'
  AND strftime(d, '%d') <> '05'"""


def missed(spark: SparkSession, root: str) -> DataFrame:
    recorded = literal_table(spark, "scheduled_for string", [("2024-02-05T11:30:00",)])
    return audit.missed_slots(runs(spark, root), "2024-02-20 12:00:00", 11, 30, recorded)


@register("missed_slots", MISSED)
def _(spark, root):
    return missed(spark, root)


@register("unserved_slots", f"""
SELECT strftime(d + INTERVAL 690 MINUTE, '%Y-%m-%dT%H:%M:%S') AS scheduled_for FROM
  (SELECT unnest(generate_series((SELECT min(date_trunc('day', started_at)) FROM {RUNS}), (SELECT max(date_trunc('day', started_at)) FROM {RUNS}), INTERVAL 1 DAY)) AS d)
  WHERE d NOT IN (SELECT date_trunc('day', started_at) FROM {RUNS})""")
def _(spark, root):
    return audit.unserved_slots(runs(spark, root), 11, 30)


ACKS = [("2024-02-03T11:30:00", "ana"), ("2024-02-07T11:30:00", "ana"), ("2024-02-07T11:30:00", "bo"), ("2023-01-01T11:30:00", "bo")]
ACK_SQL = "(SELECT * FROM (VALUES " + ", ".join(repr(a) for a in ACKS) + ") AS a(scheduled_for, acknowledged_by))"


def acknowledgements(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "scheduled_for string, acknowledged_by string", ACKS)


@register("open_gaps", f"SELECT * FROM ({MISSED}) WHERE scheduled_for NOT IN (SELECT scheduled_for FROM {ACK_SQL})")
def _(spark, root):
    return audit.open_gaps(missed(spark, root), acknowledgements(spark))


@register("refused_acknowledgements", f"""
SELECT 'slot_never_flagged' AS rule, scheduled_for AS key, '' AS detail FROM {ACK_SQL} WHERE scheduled_for NOT IN (SELECT scheduled_for FROM ({MISSED}))
UNION ALL SELECT 'slot_acknowledged_twice', scheduled_for, CAST(count(*) AS VARCHAR) FROM {ACK_SQL} GROUP BY 2 HAVING count(*) > 1""")
def _(spark, root):
    return audit.refused_acknowledgements(missed(spark, root), acknowledgements(spark))


@register("seller_reachability", """
SELECT t.seller_display_name, target_count, coalesce(n, 0) AS observation_count, strftime(last_at, '%Y-%m-%dT%H:%M:%SZ') AS last_at,
  CASE WHEN n IS NULL THEN 'not yet collected' ELSE 'collected' END AS reachability
FROM (SELECT seller_display_name, count(*) AS target_count FROM (SELECT DISTINCT seller_fine AS seller_display_name, mpn FROM v_obs UNION ALL SELECT 'NATION_NEW', 'x') GROUP BY 1) t
LEFT JOIN (SELECT seller_fine AS s, count(*) AS n, max(observed_at) AS last_at FROM v_obs WHERE capture_kind = 'prospective_capture' GROUP BY 1) l ON l.s = t.seller_display_name""")
def _(spark, root):
    o = tranche_rows(spark, root)
    new = literal_table(spark, "seller_display_name string, mpn string", [("NATION_NEW", "x")])
    registry = stacked(o.select("seller_display_name", "mpn").distinct(), new)
    return audit.seller_reachability(o.where("capture_kind = 'prospective_capture'"), registry).withColumn("last_at", instant_text(F.col("last_at")))


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """Each event is one target of its day's run."""
    e = table(spark, root, "events")
    reasons = (
        F.when(F.col("event_type") == "error", F.array(F.lit("HTTP_404"), F.lit("MPN_NOT_VISIBLE")))
        .when(F.col("value") > 120, F.array(F.lit("PRICE_NOT_VISIBLE"))).otherwise(F.array().cast("array<string>"))
    )
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), reasons.alias("reasons"),
        ((F.size(reasons) == 0) & (F.col("value") > 1)).alias("usable"),
    )


RESULT_SQL = """(SELECT strftime(ts, '%Y-%m-%d') AS run_id, CASE WHEN event_type = 'error' THEN 'HTTP_404' WHEN value > 120 THEN 'PRICE_NOT_VISIBLE' END AS reason,
  NOT (event_type = 'error' OR value > 120) AND value > 1 AS usable FROM events)"""


@register("run_summary", f"""
SELECT run_id, count(*) AS targets_attempted, count(*) FILTER (WHERE usable) AS observations_retained, count(*) FILTER (WHERE NOT usable) AS abstentions,
  CASE WHEN bool_or(usable) THEN 'completed' ELSE 'completed_with_no_usable_readings' END AS outcome FROM {RESULT_SQL} GROUP BY run_id""")
def _(spark, root):
    return audit.run_summary(run_results(spark, root))


@register("abstention_reasons", f"SELECT run_id, coalesce(reason, 'UNKNOWN') AS reason, count(*) AS n FROM {RESULT_SQL} WHERE NOT usable GROUP BY ALL")
def _(spark, root):
    return audit.abstention_reasons(run_results(spark, root))


@register("reconstruct_runs", """
SELECT 'run-' || strftime(max(created_at), '%Y%m%dT%H%M%SZ') AS run_id, tranche_id, strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') AS started_at, 'completed' AS outcome,
  count(*) AS targets_attempted, count(*) AS observations_retained, 0 AS abstentions, true AS reconstructed FROM v_tranche_row GROUP BY tranche_id""")
def _(spark, root):
    return audit.reconstruct_runs(tranche_rows(spark, root)).withColumn("started_at", instant_text(F.col("started_at")))


def numbered_events(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, root, "events").withColumns({"revision": F.row_number().over(w).cast("long"), "before": F.lag("event_id").over(w)})


def revision_log(spark: SparkSession, root: str) -> DataFrame:
    """Events of a user as revisions of a record, some with wrong parents or missing."""
    e = numbered_events(spark, root)

    def digest(c):
        return F.sha2(F.concat(F.lit("e"), c.cast("string")), 256)

    off = F.when(F.col("value") > 200, 1).otherwise(0)
    return e.where("NOT (event_type = 'error' AND value < 2)").select(
        F.concat(F.lit("rec-"), F.col("user_id").cast("string")).alias("record_id"), "revision",
        digest(F.col("event_id")).alias("revision_hash"),
        F.when(F.col("revision") > 1, digest(F.col("before") + off)).when(F.col("value") > 100, F.sha2(F.lit("none"), 256)).alias("supersedes_revision_hash"),
        "event_type", "value", "event_id", F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("author"),
    )


@register("check_revision_chain", """
WITH j AS (SELECT r.*, p.revision_hash AS prior_hash FROM v_rev r LEFT JOIN v_rev p ON p.record_id = r.record_id AND p.revision = r.revision - 1)
SELECT CASE WHEN revision = 1 THEN 'first_revision_has_parent' WHEN prior_hash IS NULL THEN 'revision_gap' ELSE 'parent_hash_differs' END AS rule,
  record_id || '@' || revision AS key, '' AS detail FROM j
WHERE CASE WHEN revision = 1 THEN supersedes_revision_hash IS NOT NULL ELSE prior_hash IS NULL OR supersedes_revision_hash <> prior_hash END""")
def _(spark, root):
    return audit.check_revision_chain(revision_log(spark, root), "record_id")


@register("current_revisions", """
SELECT record_id, revision, revision_hash, event_type FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY revision DESC) AS rn FROM v_rev) WHERE rn = 1""")
def _(spark, root):
    return audit.current_revisions(revision_log(spark, root).select("record_id", "revision", "revision_hash", "event_type"), "record_id")


def overlay_ops(spark: SparkSession, root: str, more: list[Column] | None = None) -> DataFrame:
    """Events of a user as edits of one overlay; `more` are further columns over the event."""
    e = numbered_events(spark, root)
    v, kind = F.col("value"), F.col("event_type")
    action = (
        F.when(F.col("revision") == 1, F.lit("add")).when(kind == "view", F.lit("review")).when(kind == "error", F.lit("remove"))
        .when(kind == "purchase", F.lit("reorder")).when((kind == "signup") & (v < 1), F.lit("add")).otherwise(F.lit("edit"))
    )
    actor = F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string"))
    owner = F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string"))
    a = F.col("action")
    return e.withColumn("action", action).select(
        F.concat(F.lit("ov-"), F.col("user_id").cast("string")).alias("overlay_id"), "revision", "action", actor.alias("actor_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit("fixture_editor")).otherwise(F.lit("human_editor_fixture")).alias("actor_type"),
        F.when(v > 150, F.lit("Edited")).otherwise(F.lit("Title")).alias("title"),
        F.when(a == "reorder", F.col("revision")).otherwise(F.lit(1)).cast("long").alias("display_order"),
        F.when((a == "remove") & (v > 5), F.lit("withdrawn")).when(v > 250, F.lit("unplaced")).otherwise(F.lit("placed_private")).alias("placement_state"),
        F.when(a == "remove", F.lit("withdrawn")).when((a == "review") & (v > 5), F.lit("reviewed_private"))
        .when(v > 220, F.lit("draft")).otherwise(F.lit("review_pending")).alias("review_state"),
        F.when((a == "add") & (v < 200), actor).otherwise(owner).alias("creator_id"),
        F.when((a == "review") & (v > 10), actor).when(v < 10, F.lit("a9")).alias("reviewer_id"),
        F.when(v > 180, F.lit("contributory_hypothesis")).otherwise(F.lit("descriptive")).alias("causal_language_level"), *(more or []),
    )


@register("presentation_order", """
SELECT overlay_id, display_order FROM (SELECT *, row_number() OVER (PARTITION BY overlay_id ORDER BY revision DESC) AS rn FROM v_op)
WHERE rn = 1 AND placement_state = 'placed_private' AND review_state = 'reviewed_private'""")
def _(spark, root):
    return audit.presentation_order(overlay_ops(spark, root))


def _changed(*fields: str) -> str:
    return "(" + " OR ".join(f"o.{f} IS DISTINCT FROM p.{f}" for f in fields) + ")"


OPERATION_RULES = {
    "add_overwrites": "o.action = 'add' AND p.overlay_id IS NOT NULL",
    "add_bypasses_review": "o.action = 'add' AND (o.review_state = 'reviewed_private' OR o.reviewer_id IS NOT NULL)",
    "add_creator_is_not_actor": "o.action = 'add' AND o.creator_id <> o.actor_id",
    "edit_must_return_to_review": "o.action = 'edit' AND o.review_state <> 'review_pending'",
    "remove_must_withdraw": "o.action = 'remove' AND NOT (o.placement_state = 'withdrawn' AND o.review_state = 'withdrawn')",
    "remove_changes_other_fields": "o.action = 'remove' AND " + _changed("title", "display_order", "creator_id", "causal_language_level"),
    "reorder_changes_nothing": "o.action = 'reorder' AND o.display_order = p.display_order",
    "reorder_must_return_to_review": "o.action = 'reorder' AND (o.review_state <> 'review_pending' OR o.reviewer_id IS NOT NULL)",
    "reorder_changes_other_fields": "o.action = 'reorder' AND " + _changed("title", "placement_state", "creator_id", "causal_language_level"),
    "review_by_non_human": "o.action = 'review' AND o.actor_type <> 'human_editor_fixture'",
    "review_of_unplaced": "o.action = 'review' AND o.placement_state <> 'placed_private'",
    "review_state_not_private": "o.action = 'review' AND o.review_state <> 'reviewed_private'",
    "review_of_causal_claim": "o.action = 'review' AND o.causal_language_level = 'contributory_hypothesis'",
    "review_without_pending": "o.action = 'review' AND p.review_state <> 'review_pending'",
    "creator_reviews_own_work": "o.action = 'review' AND o.actor_id = p.creator_id",
    "reviewer_is_not_actor": "o.action = 'review' AND o.reviewer_id IS DISTINCT FROM o.actor_id",
    "review_changes_other_fields": "o.action = 'review' AND " + _changed("title", "display_order", "placement_state", "creator_id", "causal_language_level"),
}


@register("audit_operations", " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, o.overlay_id || '@' || o.revision AS key, '' AS detail FROM v_op o LEFT JOIN v_op p ON p.overlay_id = o.overlay_id AND p.revision = o.revision - 1 WHERE {cond}"
    for rule, cond in OPERATION_RULES.items()
))
def _(spark, root):
    return audit.audit_operations(overlay_ops(spark, root))


#: Further fields of an overlay as columns over the event, and the same as SQL.
STATED = {
    "display_start": ("CASE WHEN event_id % 9 = 1 THEN '2024-01-0' || CAST(event_id % 5 + 1 AS STRING) WHEN event_id % 9 = 4 THEN NULL ELSE '2024-01-09' END"),
    "display_end": ("CASE WHEN event_id % 9 = 2 THEN '2024-01-03' END"),
    "date_precision": ("CASE WHEN event_id % 9 = 3 THEN 'week' WHEN event_id % 9 = 4 THEN 'unresolved' ELSE 'day' END"),
    "unavailable_reason": ("CASE WHEN event_id % 9 = 4 AND value > 20 THEN 'UNAVAILABLE_EVENT_DATE_OR_REVISION' END"),
    "possible_effect_label": ("CASE WHEN event_id % 9 = 5 THEN '' ELSE 'effect' END"),
    "uncertainty": ("CASE WHEN event_id % 9 = 6 THEN 'high' ELSE 'low' END"),
    "evidence_panel_ref": ("CASE WHEN event_id % 9 = 7 THEN 'Panel 1' ELSE 'panel-1' END"),
}
V_STATED_OP = f"""(SELECT o.*, CASE WHEN e.event_id % 11 = 5 AND o.revision > 1 THEN 'conjure' ELSE o.action END AS stated_action, CASE WHEN e.event_id % 13 = 5 THEN 'robot' ELSE o.actor_type END AS stated_type,
  {", ".join(f"{sql} AS {name}" for name, sql in STATED.items())} FROM v_op o JOIN (SELECT event_id, value, 'ov-' || user_id AS who, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) e ON e.who = o.overlay_id AND e.n = o.revision)""".replace("STRING", "VARCHAR")


def stated_ops(spark: SparkSession, root: str) -> DataFrame:
    """Overlay edits with all their fields, some by an unknown action or kind of actor."""
    more = [F.expr(sql).alias(name) for name, sql in STATED.items()] + [F.col("event_id").alias("of")]
    ops = overlay_ops(spark, root, more)
    return ops.withColumns({
        "action": F.when((F.col("of") % 11 == 5) & (F.col("revision") > 1), F.lit("conjure")).otherwise(F.col("action")),
        "actor_type": F.when(F.col("of") % 13 == 5, F.lit("robot")).otherwise(F.col("actor_type")),
    }).drop("of")


def _stated(condition: str) -> str:
    return condition.replace("o.action", "o.stated_action").replace("o.actor_type", "o.stated_type")


STATED_RULES = {
    **{rule: _stated(cond) for rule, cond in OPERATION_RULES.items()},
    **{f"{a}_changes_other_fields": _stated(OPERATION_RULES[f"{a}_changes_other_fields"])[:-1] + " OR " + _changed(*STATED)[1:] for a in ("remove", "reorder", "review")},
    "action_unsupported": "o.stated_action = 'conjure'", "actor_type_unsupported": "o.stated_type = 'robot'",
}


@register("audit_operations_stated", f"WITH s AS {V_STATED_OP} " + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, o.overlay_id || '@' || o.revision AS key, '' AS detail FROM s o LEFT JOIN s p ON p.overlay_id = o.overlay_id AND p.revision = o.revision - 1 WHERE {cond}"
    for rule, cond in STATED_RULES.items()
))
def _(spark, root):
    return audit.audit_operations(stated_ops(spark, root))


UNAVAILABLE = "(display_start IS NULL OR date_precision = 'unresolved')"
OVERLAY_RULES = {
    "date_range_reversed": "display_end < display_start", "date_precision_unknown": "date_precision = 'week'", "possible_effect_label_missing": "possible_effect_label = ''",
    "evidence_panel_ref_malformed": "evidence_panel_ref = 'Panel 1'", "placement_state_unknown": "placement_state = 'unplaced'",
    "unavailability_not_stated": f"{UNAVAILABLE} <> (unavailable_reason IS NOT NULL)", "reviewed_without_reviewer": "(review_state = 'reviewed_private') <> (reviewer_id IS NOT NULL)",
    "creator_is_reviewer": "reviewer_id = creator_id", "unavailable_but_reviewed": f"review_state = 'reviewed_private' AND {UNAVAILABLE}",
    "withdrawn_but_not_in_review": "placement_state = 'withdrawn' AND review_state <> 'withdrawn'",
}


@register("check_overlays", f"WITH s AS {V_STATED_OP} " + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, overlay_id || '@' || revision AS key, '' AS detail FROM s WHERE {cond}" for rule, cond in OVERLAY_RULES.items()
))
def _(spark, root):
    return audit.check_overlays(stated_ops(spark, root))


# Documents stand in for captures, their opening words for quoted claims.
CAPTURE = """(SELECT 'cap-' || doc_id AS capture_id, source AS source_item_id, text AS retained_text,
  octet_length(encode(text)) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS byte_count,
  sha256(text || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END) AS sha256, doc_id, lang, n_chars FROM documents)"""
CLAIM = """(SELECT 'claim-' || doc_id AS claim_id, 'cap-' || CASE WHEN doc_id % 17 = 0 THEN -1 ELSE doc_id END AS capture_id,
  sha256(text || CASE WHEN doc_id % 13 = 0 AND doc_id % 2 = 0 THEN 'x' ELSE '' END) AS capture_sha256,
  CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'no such words here' ELSE text END AS exact_extract,
  CASE WHEN doc_id % 29 = 0 THEN 'rumour' WHEN doc_id % 2 = 0 THEN 'verified' ELSE 'disputed' END AS status,
  'lin-' || lang || '-' || (doc_id % 5) AS duplicate_lineage_id, sha256('c' || doc_id) AS claim_revision_hash, doc_id FROM documents)"""


def captures(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    tail = F.when(F.col("doc_id") % 13 == 0, F.lit("x")).otherwise(F.lit(""))
    return d.select(
        F.concat(F.lit("cap-"), F.col("doc_id").cast("string")).alias("capture_id"), F.col("source").alias("source_item_id"),
        F.col("text").alias("retained_text"),
        (F.octet_length("text") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("long").alias("byte_count"),
        F.sha2(F.concat("text", tail), 256).alias("sha256"),
    )


def claims(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    i = F.col("doc_id")
    tail = F.when((i % 13 == 0) & (i % 2 == 0), F.lit("x")).otherwise(F.lit(""))
    return d.select(
        F.concat(F.lit("claim-"), i.cast("string")).alias("claim_id"),
        F.concat(F.lit("cap-"), F.when(i % 17 == 0, F.lit(-1)).otherwise(i).cast("string")).alias("capture_id"),
        F.sha2(F.concat("text", tail), 256).alias("capture_sha256"),
        F.when(i % 19 == 0, F.lit("")).when(i % 23 == 0, F.lit("no such words here")).otherwise(F.col("text")).alias("exact_extract"),
        F.when(i % 29 == 0, F.lit("rumour")).when(i % 2 == 0, F.lit("verified")).otherwise(F.lit("disputed")).alias("status"),
        F.concat_ws("-", F.lit("lin"), "lang", (i % 5).cast("string")).alias("duplicate_lineage_id"),
        F.sha2(F.concat(F.lit("c"), i.cast("string")), 256).alias("claim_revision_hash"),
        "doc_id",
    )


@register("check_captures", f"""
SELECT 'source_item_unknown' AS rule, capture_id AS key, '' AS detail FROM {CAPTURE} WHERE source_item_id = 'src3'
UNION ALL SELECT 'byte_count_differs', capture_id, '' FROM {CAPTURE} WHERE doc_id % 11 = 0 UNION ALL SELECT 'sha256_differs', capture_id, '' FROM {CAPTURE} WHERE doc_id % 13 = 0""")
def _(spark, root):
    items = table(spark, root, "documents").select(F.col("source").alias("source_item_id")).distinct().where("source_item_id <> 'src3'")
    return audit.check_captures(captures(spark, root), items)


@register("check_claims", f"""
WITH j AS (SELECT k.*, c.sha256 AS bound, c.retained_text FROM {CLAIM} k LEFT JOIN {CAPTURE} c ON c.capture_id = k.capture_id)
SELECT 'capture_unknown' AS rule, claim_id AS key, '' AS detail FROM j WHERE bound IS NULL
UNION ALL SELECT 'capture_sha256_differs', claim_id, '' FROM j WHERE capture_sha256 <> bound UNION ALL SELECT 'extract_blank', claim_id, '' FROM j WHERE exact_extract = ''
UNION ALL SELECT 'extract_not_in_capture', claim_id, '' FROM j WHERE NOT contains(retained_text, exact_extract) UNION ALL SELECT 'status_unknown', claim_id, '' FROM j WHERE status = 'rumour'""")
def _(spark, root):
    return audit.check_claims(claims(spark, root), captures(spark, root))


EDGE = """(SELECT 'rel-' || doc_id AS relationship_id, 'claim-' || doc_id AS from_claim_id, 'claim-' || (doc_id + CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 1 END) AS to_claim_id,
  CASE WHEN doc_id % 2 = 0 THEN 'duplicates' ELSE 'contradicts' END AS relationship FROM documents)"""


@register("check_relations", f"""
WITH j AS (SELECT e.*, a.duplicate_lineage_id AS fl, b.duplicate_lineage_id AS tl FROM {EDGE} e LEFT JOIN {CLAIM} a ON a.claim_id = from_claim_id LEFT JOIN {CLAIM} b ON b.claim_id = to_claim_id)
SELECT 'claim_unknown' AS rule, relationship_id AS key, '' AS detail FROM j WHERE fl IS NULL OR tl IS NULL
UNION ALL SELECT 'duplicates_split_lineage', relationship_id, '' FROM j WHERE relationship = 'duplicates' AND fl <> tl
UNION ALL SELECT 'contradiction_within_lineage', relationship_id, '' FROM j WHERE relationship = 'contradicts' AND fl = tl""")
def _(spark, root):
    i = F.col("doc_id")
    edges = table(spark, root, "documents").select(
        F.concat(F.lit("rel-"), i.cast("string")).alias("relationship_id"), F.concat(F.lit("claim-"), i.cast("string")).alias("from_claim_id"),
        F.concat(F.lit("claim-"), (i + F.when(i % 4 == 0, 5).otherwise(1)).cast("string")).alias("to_claim_id"),
        F.when(i % 2 == 0, F.lit("duplicates")).otherwise(F.lit("contradicts")).alias("relationship"),
    )
    return audit.check_relations(edges, claims(spark, root))


EVENT_REF = """(SELECT record_id AS event_id, revision, CASE WHEN event_type = 'click' THEN 'contradictory' ELSE 'supporting' END AS kind, 'claim-' || (event_id // 7) AS claim_id,
  sha256('c' || (event_id // 7 + CASE WHEN value > 150 THEN 1 ELSE 0 END)) AS claim_revision_hash FROM v_rev)"""


def event_references(log: DataFrame) -> DataFrame:
    n = F.expr("event_id div 7")
    return log.select(
        F.col("record_id").alias("event_id"), "revision",
        F.when(F.col("event_type") == "click", F.lit("contradictory")).otherwise(F.lit("supporting")).alias("kind"),
        F.concat(F.lit("claim-"), n.cast("string")).alias("claim_id"),
        F.sha2(F.concat(F.lit("c"), (n + F.when(F.col("value") > 150, 1).otherwise(0)).cast("string")), 256).alias("claim_revision_hash"),
    )


@register("check_events", f"""
SELECT 'claim_revision_not_bound' AS rule, r.event_id || '@' || r.revision AS key, r.claim_id AS detail FROM {EVENT_REF} r LEFT JOIN {CLAIM} c ON c.claim_id = r.claim_id
  WHERE c.claim_revision_hash IS DISTINCT FROM r.claim_revision_hash
UNION ALL SELECT 'contested_without_contradiction', record_id || '@' || revision, '' FROM v_rev WHERE value > 50 AND event_type <> 'click'
UNION ALL SELECT 'date_precision_inconsistent', record_id || '@' || revision, '' FROM v_rev WHERE event_type = 'signup' AND value < 10
UNION ALL SELECT 'causal_level_unknown', record_id || '@' || revision, '' FROM v_rev WHERE value > 250""")
def _(spark, root):
    log = revision_log(spark, root)
    signup = F.col("event_type") == "signup"
    events = log.select(
        F.col("record_id").alias("event_id"), "revision",
        F.when(F.col("value") > 50, F.lit("contested")).otherwise(F.lit("unverified")).alias("factual_state"),
        F.when(~signup, F.lit("2024-01-01")).alias("event_date"),
        F.when(signup & (F.col("value") >= 10), F.lit("unresolved")).otherwise(F.lit("day")).alias("date_precision"),
        F.when(F.col("value") > 250, F.lit("causal")).otherwise(F.lit("descriptive")).alias("causal_language_level"),
    )
    return audit.check_events(events, event_references(log), claims(spark, root))


@register("check_reviews", """
SELECT 'event_revision_not_bound' AS rule, 'rv-' || event_id AS key, '' AS detail FROM v_rev WHERE value > 180
UNION ALL SELECT 'author_reviews_own_revision', 'rv-' || event_id, '' FROM v_rev WHERE value <= 180 AND author = 'a3'
UNION ALL SELECT 'decision_not_permitted', 'rv-' || event_id, '' FROM v_rev WHERE event_type = 'purchase' AND value > 90""")
def _(spark, root):
    log = revision_log(spark, root)
    reviews = log.select(
        F.concat(F.lit("rv-"), F.col("event_id").cast("string")).alias("review_id"), "record_id",
        F.when(F.col("value") > 180, F.sha2(F.lit("other"), 256)).otherwise(F.col("revision_hash")).alias("revision_hash"),
        F.lit("a3").alias("reviewer_id"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), F.lit("approved")).otherwise(F.lit("changes_requested")).alias("decision"),
    )
    events = log.select(F.col("record_id").alias("event_id"), "revision_hash", F.col("author").alias("author_id"))
    return audit.check_reviews(reviews, events)


@register("check_numeric_coupling", """
SELECT 'numeric_key_present' AS rule, CAST(event_id AS VARCHAR) AS key, d AS detail FROM (SELECT event_id, unnest(CASE WHEN value > 100 THEN ['amount_minor', 'weight'] WHEN value < 3 THEN ['gap_fill'] END) AS d FROM events)""")
def _(spark, root):
    doc = (
        F.when(F.col("value") > 100, F.concat(F.lit('{"note": {"price ": 1, "amount_minor": [2], "deep": {"weight" : 1}}, "p": '), F.col("props"), F.lit("}")))
        .when(F.col("value") < 3, F.concat(F.lit('{"list": [{"gap_fill": null}], "p": '), F.col("props"), F.lit("}")))
        .otherwise(F.col("props"))
    )
    return audit.check_numeric_coupling(table(spark, root, "events").select("event_id", doc.alias("body")), "event_id", "body")


@register("check_explanations", """
SELECT 'unknown_movement' AS rule, 'ex-' || mpn AS key, '' AS detail FROM v_widest WHERE delta_minor % 5 = 0
UNION ALL SELECT 'causal_level_not_permitted', 'ex-' || mpn, '' FROM v_widest WHERE delta_minor % 7 = 0
UNION ALL SELECT 'counterevidence_search_missing', 'ex-' || mpn, '' FROM v_widest WHERE from_minor % 5 = 0
UNION ALL SELECT 'response_sha256_not_digest', 'ex-' || mpn, '' FROM v_widest WHERE from_minor % 7 = 0
UNION ALL SELECT 'source_author_missing', 'ex-' || mpn, '' FROM v_widest WHERE to_minor % 5 = 0
UNION ALL SELECT 'source_url_not_https', 'ex-' || mpn, '' FROM v_widest WHERE to_minor % 7 = 0
UNION ALL SELECT 'source_url_synthetic', 'ex-' || mpn, '' FROM v_widest WHERE to_minor % 11 = 0 AND to_minor % 7 <> 0
UNION ALL SELECT 'source_date_malformed', 'ex-' || mpn, '' FROM v_widest WHERE to_minor % 13 = 0""")
def _(spark, root):
    w = movements.widest_movements(observations(spark, root))

    def every(column: str, n: int):
        return F.col(column) % n == 0

    explanations = w.select(
        F.concat(F.lit("ex-"), "mpn").alias("explanation_id"),
        F.when(every("delta_minor", 5), F.lit("movement-none")).otherwise(F.col("movement_id")).alias("movement_id"),
        F.when(every("delta_minor", 7), F.lit("caused_by")).otherwise(F.lit("descriptive")).alias("causal_language_level"),
        (~every("from_minor", 5)).alias("search_performed"), F.lit("none_identified").alias("search_result"),
        F.when(every("from_minor", 7), F.lit("short")).otherwise(F.sha2("mpn", 256)).alias("response_sha256"),
        F.lit("said so").alias("minimal_quote"), F.lit("A headline").alias("source_title"), F.lit("A paper").alias("source_publisher"),
        F.when(every("to_minor", 5), F.lit(" ")).otherwise(F.lit("not_stated_by_publisher")).alias("source_author"),
        F.when(every("to_minor", 7), F.lit("http://news.example/a")).when(every("to_minor", 11), F.lit("https://a.fixture.invalid/x"))
        .otherwise(F.lit("https://news.example/a")).alias("source_url"),
        F.when(every("to_minor", 13), F.lit("2024-1-1")).otherwise(F.lit("2024-01-01")).alias("published_on"), F.lit("2024-01-02").alias("accessed_on"),
    )
    return audit.check_explanations(explanations, w)
