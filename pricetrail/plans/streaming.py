"""Streaming queries, each run over everything present and then read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions.periods import month_label
from pricetrail.plans.registry import register
from pricetrail.plans.views import VIEWS
from pricetrail.session import shared_folder
from pricetrail.sources.tranches import read_tranches, write_tranches
from pricetrail.streaming import live

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

VIEWS["v_event_obs"] = """
SELECT 'e-' || event_id AS observation_id, ts AS observed_at, 'u-' || user_id AS mpn, event_type AS seller, CAST(floor(value * 100 + 0.5) AS BIGINT) + 1 AS amount_minor,
  event_type <> 'error' AS vat_included, event_id FROM events
"""


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place for one run of a stream."""
    return f"{shared_folder(spark)}/streams/{name}-{uuid4().hex}"


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The events table read as a stream of observations."""
    e = spark.readStream.schema(EVENTS).parquet(f"{root}/[e]vents.parquet")
    return e.select(
        F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("observation_id"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("mpn"), F.col("event_type").alias("seller"),
        (F.floor(F.col("value") * 100 + 0.5).cast("long") + 1).alias("amount_minor"), (F.col("event_type") != "error").alias("vat_included"), "event_id",
    )


def to_files(stream: DataFrame, folder: str) -> DataFrame:
    schema = stream.schema
    live.run_to_end(stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), f"{folder}/checkpoint")
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")


@register("stream_dedup", "SELECT observation_id, amount_minor FROM v_event_obs")
def _(spark, root):
    s = event_stream(spark, root)
    doubled = s.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 5 == 0, 3).otherwise(1)))).drop("copy")
    return to_files(live.stream_dedup(doubled), work_folder(spark, "dedup")).select("observation_id", "amount_minor")


@register("stream_daily", """
SELECT strftime(observed_at, '%Y-%m-%d') AS date, mpn, min(amount_minor) AS low_minor, max(amount_minor) AS high_minor, count(*) AS observation_count FROM v_event_obs
WHERE date_trunc('day', observed_at) + INTERVAL 1 DAY <= (SELECT max(observed_at) - INTERVAL 1 HOUR FROM v_event_obs) GROUP BY ALL""")
def _(spark, root):
    return to_files(live.stream_daily(event_stream(spark, root)), work_folder(spark, "daily")).withColumn("date", F.col("date").cast("string"))


def through_batches(spark: SparkSession, stream: DataFrame, name: str, make) -> str:
    folder = work_folder(spark, name)
    live.run_to_end(live.write_batches(stream, make(folder)), f"{folder}/checkpoint")
    return folder


@register("stream_late", """
SELECT observation_id, CASE WHEN observed_at <= max(observed_at) OVER (PARTITION BY mpn, seller ORDER BY delivery RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 'refused' ELSE 'accepted' END AS side FROM (SELECT *, event_id % 3 AS delivery FROM v_event_obs)""")
def _(spark, root):
    # Three deliveries that overlap in time, so rows of the later ones are backdated.
    s = event_stream(spark, root).withColumn("delivery", F.col("event_id") % 3)
    return to_files(live.follow_lines(s, ["delivery"]), work_folder(spark, "late")).select("observation_id", "side")


@register("stream_line_movement", """
SELECT * FROM (SELECT mpn, seller, lag(observation_id) OVER w AS from_observation_id, observation_id AS to_observation_id, lag(amount_minor) OVER w AS from_minor, amount_minor AS to_minor,
  amount_minor - lag(amount_minor) OVER w AS change_minor,
  CAST(sign(amount_minor - lag(amount_minor) OVER w) AS BIGINT) * ((20000 * abs(amount_minor - lag(amount_minor) OVER w) + lag(amount_minor) OVER w) // (2 * lag(amount_minor) OVER w)) AS change_basis_points,
  CASE WHEN amount_minor > lag(amount_minor) OVER w THEN 'up' WHEN amount_minor < lag(amount_minor) OVER w THEN 'down' ELSE 'flat' END AS direction
  FROM v_event_obs WINDOW w AS (PARTITION BY mpn, seller ORDER BY observed_at, observation_id)) WHERE from_observation_id IS NOT NULL""")
def _(spark, root):
    followed = live.follow_lines(event_stream(spark, root), tranche=())
    return to_files(live.line_movements(followed), work_folder(spark, "moves"))


VIEWS["v_tranche_file"] = """
SELECT *, event_id // 1500 * 3 + event_id % 3 AS number, (event_id // 1500 * 3 + event_id % 3) % 2 = 1 AS archived FROM v_event_obs
"""

VIEWS["v_tranche_line"] = """
SELECT *, coalesce(observed_at <= max(observed_at) OVER (PARTITION BY mpn, seller ORDER BY number RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM v_tranche_file
"""

#: Tranches are delivered in so many rounds, each later than the one before.
ROUNDS = 4


def tranche_number() -> Column:
    """Of every 1500 events, three tranches that overlap in time."""
    return F.expr("event_id div 1500 * 3 + event_id % 3")


def tranche_files(spark: SparkSession, root: str, name: str, rounds: int = ROUNDS) -> tuple[str, int]:
    """Events written as tranche files, archive-shaped and live ones in turn: their folder, and the files of a round.

    A tranche holds 500 observations, so their number grows with the table.
    """
    folder = work_folder(spark, name)
    e = spark.read.schema(EVENTS).parquet(f"{root}/events.parquet").withColumn("number", tranche_number())
    archived = F.col("number") % 2 == 1
    mpn, amount, vat = F.concat(F.lit("u-"), F.col("user_id").cast("string")), F.floor(F.col("value") * 100 + 0.5).cast("long") + 1, F.col("event_type") != "error"
    observation = F.struct(
        F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("observation_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_at"),
        F.struct(F.col("event_type").alias("display_name")).alias("seller"),
        F.when(archived, F.struct(mpn.alias("mpn"), F.lit(32).alias("capacity_gb"), F.lit(2).alias("module_count"), F.lit("DDR5").alias("memory_type"))).alias("product"),
        F.when(archived, F.struct(amount.alias("item_price_minor"), F.lit("GBP").alias("currency"), vat.alias("vat_included"))).alias("price"),
        F.when(archived, F.struct(F.lit(True).alias("identity_exact"))).alias("eligibility"),
        F.when(~archived, F.struct(mpn.alias("mpn_observed"))).alias("identity"),
        F.when(~archived, F.struct(amount.alias("amount_minor"), F.lit("GBP").alias("currency"), F.when(vat, F.lit("included")).otherwise(F.lit("excluded")).alias("vat_state"))).alias("item_price"),
    )
    rows = e.select(
        "number", F.lit(1).alias("schema_version"), F.format_string("t-%08d", "number").alias("tranche_id"),
        F.when(archived, F.lit("candidate_only_historical_backfill")).otherwise(F.lit("candidate_only")).alias("scope"),
        F.when(~archived, F.lit("PRIMARY_RETAIL")).alias("channel"),
        F.date_format(F.timestamp_seconds(F.lit(1_900_000_000) + 60 * F.col("number")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        observation.alias("o"),
    )
    last = e.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]
    size = last // rounds + 1
    for k in range(rounds):
        write_tranches(rows.where((F.col("number") >= k * size) & (F.col("number") < (k + 1) * size)).drop("number"), f"{folder}/in")
    return folder, max(size, 1)


def tranche_observations(raw: DataFrame, *more: str) -> DataFrame:
    """Both shapes of tranche rows as the columns lines are followed by."""
    return raw.select(
        *more, "tranche_id", "created_at", "observation_id", F.to_timestamp("observed_at").alias("observed_at"),
        F.coalesce("identity.mpn_observed", "product.mpn").alias("mpn"), F.col("seller.display_name").alias("seller"),
        F.coalesce("item_price.amount_minor", "price.item_price_minor").alias("amount_minor"),
        F.coalesce(F.col("price.vat_included"), F.col("item_price.vat_state") == "included").alias("vat_included"),
    )


def micros_text() -> Column:
    return F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


FLAT = "'t-' || lpad(CAST(number AS VARCHAR), 8, '0') AS tranche_id, strftime(to_timestamp(1900000000 + 60 * number) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created_at"


@register("read_tranches", f"""
SELECT {FLAT}, observation_id, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f') AS observed_at, mpn, seller, amount_minor, vat_included,
  CASE WHEN archived THEN 'candidate_only_historical_backfill' ELSE 'candidate_only' END AS tranche_scope, CASE WHEN NOT archived THEN 'PRIMARY_RETAIL' END AS channel,
  count(*) OVER (PARTITION BY number) AS in_file FROM v_tranche_file""")
def _(spark, root):
    folder, _ = tranche_files(spark, root, "tranches")
    raw = read_tranches(spark, f"{folder}/in")
    held = raw.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("in_file"))
    flat = tranche_observations(raw, "tranche_scope", "channel", "source_file").join(held, F.col("source_file") == F.col("file"))
    return flat.withColumn("observed_at", micros_text()).drop("source_file", "file")


@register("stream_tranches", f"SELECT {FLAT}, observation_id, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f') AS observed_at, mpn, seller, amount_minor, vat_included FROM v_tranche_file")
def _(spark, root):
    folder, size = tranche_files(spark, root, "tranche-stream")
    flat = tranche_observations(live.stream_tranches(spark, f"{folder}/in", files_per_batch=size))
    return to_files(flat, folder).withColumn("observed_at", micros_text())


def followed_tranches(spark: SparkSession, root: str, name: str) -> DataFrame:
    folder, size = tranche_files(spark, root, name)
    flat = tranche_observations(live.stream_tranches(spark, f"{folder}/in", files_per_batch=size))
    return to_files(live.follow_lines(flat), folder)


@register("stream_tranche_late", "SELECT observation_id, mpn, seller, amount_minor, CASE WHEN late THEN 'refused' ELSE 'accepted' END AS side FROM v_tranche_line")
def _(spark, root):
    return followed_tranches(spark, root, "tranche-late").select("observation_id", "mpn", "seller", "amount_minor", "side")


@register("stream_tranche_movements", """
SELECT * FROM (SELECT mpn, seller, lag(observation_id) OVER w AS from_observation_id, observation_id AS to_observation_id, lag(amount_minor) OVER w AS from_minor, amount_minor AS to_minor,
  amount_minor - lag(amount_minor) OVER w AS change_minor,
  CAST(sign(amount_minor - lag(amount_minor) OVER w) AS BIGINT) * ((20000 * abs(amount_minor - lag(amount_minor) OVER w) + lag(amount_minor) OVER w) // (2 * lag(amount_minor) OVER w)) AS change_basis_points,
  CASE WHEN amount_minor > lag(amount_minor) OVER w THEN 'up' WHEN amount_minor < lag(amount_minor) OVER w THEN 'down' ELSE 'flat' END AS direction
  FROM v_tranche_line WHERE NOT late WINDOW w AS (PARTITION BY mpn, seller ORDER BY observed_at, observation_id)) WHERE from_observation_id IS NOT NULL""")
def _(spark, root):
    return live.line_movements(followed_tranches(spark, root, "tranche-moves"))


@register("stream_missed_slots", """
WITH r AS (SELECT DISTINCT date_trunc('day', CASE WHEN day(observed_at) % 5 = 3 THEN observed_at - INTERVAL 1 DAY ELSE observed_at END) AS d FROM v_event_obs)
SELECT strftime(s + INTERVAL 690 MINUTE, '%Y-%m-%dT%H:%M:%S') AS scheduled_for, 'unobserved_no_run' AS state
FROM (SELECT unnest(generate_series((SELECT min(d) FROM r), (SELECT max(d) FROM r), INTERVAL 1 DAY)) AS s) WHERE s NOT IN (SELECT d FROM r)""")
def _(spark, root):
    # On every fifth day of a month nothing runs: its events count as the day before's.
    at = F.col("observed_at")
    started = F.when(F.dayofmonth("observed_at") % 5 == 3, at - F.expr("INTERVAL 1 DAY")).otherwise(at)
    runs = event_stream(spark, root).select(F.col("observation_id").alias("run_id"), started.alias("started_at"))
    folder = through_batches(spark, runs, "slots", lambda f: live.missed_slot_writer(spark, f, 11, 30))
    return spark.read.parquet(f"{folder}/missed").drop("batch")


@register("stream_monthly_medians", """
SELECT mpn, strftime(month, '%Y-%m') AS month, CAST(floor(quantile_cont(m, 0.5) + 0.5) AS BIGINT) AS median_minor FROM
  (SELECT mpn, seller, date_trunc('month', observed_at) AS month, floor(quantile_cont(amount_minor, 0.5) + 0.5) AS m FROM v_event_obs WHERE vat_included GROUP BY ALL) GROUP BY ALL""")
def _(spark, root):
    folder = through_batches(spark, event_stream(spark, root), "medians", lambda f: live.monthly_median_writer(spark, f))
    return live.current_medians(spark, folder).withColumn("month", month_label(F.col("month")))
