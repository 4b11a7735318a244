"""Queries over files that Spark writes and reads again: classified inputs and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetrail.functions.reasons import stacked
from pricetrail.operators import ingest
from pricetrail.plans.registry import register
from pricetrail.plans.streaming import tranche_files, work_folder
from pricetrail.plans.views import VIEWS
from pricetrail.sources.adapter import observations
from pricetrail.sources.release import check_release, release_files, release_manifest, write_release
from pricetrail.sources.tranches import input_files

VIEWS["v_file_entry"] = """
SELECT number, number % 7 <> 1 AS listed, number % 7 = 2 AS changed, number % 7 = 3 AS gone, number % 7 = 4 AS doubled, number % 5 = 2 AS unreasoned,
  CASE WHEN number % 11 = 6 THEN 'maybe' WHEN number % 2 = 0 THEN 'included_private_candidate' ELSE 'excluded_private_candidate' END AS decision,
  number % 2 = 1 AS archived, 't-' || lpad(CAST(number AS VARCHAR), 8, '0') AS name FROM (SELECT DISTINCT event_id // 1500 * 3 + event_id % 3 AS number FROM events)
"""


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """Tranche files as they lie on disk: bytes, digest and what their content says; `name` is the tranche inside."""
    folder, _ = tranche_files(spark, root, "inputs", rounds=1)
    return input_files(spark, f"{folder}/in/*.json")


def listed(files: DataFrame) -> DataFrame:
    """A manifest written from the files, in which some are missing, changed, listed twice or listed though gone."""
    n = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
    f = files.where(n % 7 != 1)
    entries = f.select(
        F.when(n % 7 == 3, F.concat("name", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(n % 7 == 2, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"), F.lit(1).alias("schema_version"),
        F.lit("PRIMARY_RETAIL").alias("channel"), F.lit("prospective_capture").alias("capture_kind"),
        F.when(n % 11 == 6, F.lit("maybe")).when(n % 2 == 0, F.lit("included_private_candidate")).otherwise(F.lit("excluded_private_candidate")).alias("decision"),
        F.when(n % 5 == 2, F.lit(" ")).otherwise(F.lit("kept")).alias("reason"), (n % 7 == 4).alias("doubled"),
    )
    return stacked(entries, entries.where("doubled")).drop("doubled")


@register("classify_files", """
SELECT rule, key, '' AS detail FROM (
  SELECT 'file_not_classified' AS rule, name AS key FROM v_file_entry WHERE NOT listed OR gone UNION ALL SELECT 'classified_file_missing', name || '.gone' FROM v_file_entry WHERE gone
  UNION ALL SELECT 'classified_more_than_once', name FROM v_file_entry WHERE doubled UNION ALL SELECT 'hash_mismatch', name FROM v_file_entry WHERE changed
  UNION ALL SELECT 'decision_unknown', name FROM v_file_entry WHERE listed AND NOT gone AND decision = 'maybe' UNION ALL SELECT 'reason_blank', name FROM v_file_entry WHERE listed AND NOT gone AND unreasoned)""")
def _(spark, root):
    files = scanned(spark, root)
    found = ingest.classify_inputs(files.drop("name"), listed(files))
    # Paths are names that Spark chose; the tranche in a file tells which it is.
    named = found.join(files.select("path", "name"), F.col("key") == F.col("path"), "left")
    return named.select("rule", F.coalesce("name", "key").alias("key"), "detail")


@register("scan_files", """
SELECT name, CASE WHEN archived THEN 'candidate_only_historical_backfill' ELSE 'candidate_only' END AS file_scope, CASE WHEN NOT archived THEN 'PRIMARY_RETAIL' END AS file_channel, 1 AS file_schema_version,
  count(*) AS observations FROM v_file_entry JOIN events ON event_id // 1500 * 3 + event_id % 3 = number GROUP BY ALL""")
def _(spark, root):
    return scanned(spark, root).select("name", "file_scope", "file_channel", "file_schema_version", "observations")


def released(spark: SparkSession, root: str) -> DataFrame:
    return observations(spark, root).select("observation_id", "mpn", "seller", "observed_at", "amount_minor", "vat_included")


def altered(rows: DataFrame) -> DataFrame:
    """The rows as a later derivation might give them: some gone, some twice, some at another price."""
    a = F.col("amount_minor")
    moved = rows.where("amount_minor % 101 <> 3").withColumn("amount_minor", F.when(a % 97 == 5, a + 1).otherwise(a))
    return stacked(moved, rows.where("amount_minor % 89 = 7 AND amount_minor % 101 <> 3 AND amount_minor % 97 <> 5"))


def wrote(spark: SparkSession, root: str, name: str) -> tuple[str, DataFrame]:
    path = f"{work_folder(spark, name)}/release"
    rows = released(spark, root)
    write_release(rows, path, ["observation_id"], files=8)
    return path, rows


@register("release_round_trip", "SELECT '' AS observation_id, '' AS side, 0 AS surplus WHERE false")
def _(spark, root):
    path, rows = wrote(spark, root, "same")
    return check_release(spark, rows, path).select("observation_id", "side", "surplus")


@register("release_change", """
WITH o AS (SELECT observation_id, mpn, seller, observed_at, amount_minor AS a, vat_included FROM v_obs), d AS (
  SELECT * REPLACE (CASE WHEN a % 97 = 5 THEN a + 1 ELSE a END AS a) FROM o WHERE a % 101 <> 3 UNION ALL SELECT * FROM o WHERE a % 89 = 7 AND a % 101 <> 3 AND a % 97 <> 5)
SELECT observation_id, a AS amount_minor, CASE WHEN sum(s) > 0 THEN 'only_derived' ELSE 'only_recorded' END AS side, CAST(abs(sum(s)) AS BIGINT) AS surplus
FROM (SELECT *, -1 AS s FROM o UNION ALL SELECT *, 1 FROM d) GROUP BY observation_id, mpn, seller, observed_at, a, vat_included HAVING sum(s) <> 0""")
def _(spark, root):
    path, rows = wrote(spark, root, "changed")
    return check_release(spark, altered(rows), path).select("observation_id", "amount_minor", "side", "surplus")


@register("release_files", """
SELECT count(*) AS row_count, min(observation_id) AS first_id, max(observation_id) AS last_id, 0 AS overlapping, true AS same_digest FROM v_obs""")
def _(spark, root):
    # Files hold ranges in order, and what was written has the digest of what was derived.
    path, rows = wrote(spark, root, "files")
    held = release_files(spark, path, rows.schema, "observation_id")
    earlier = F.max("last_key").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1))
    ranges = held.withColumn("earlier", earlier).agg(
        F.sum("row_count").alias("row_count"), F.min("first_key").alias("first_id"), F.max("last_key").alias("last_id"), F.count_if(F.col("earlier") >= F.col("first_key")).alias("overlapping")
    )
    read = spark.read.schema(rows.schema).parquet(path)
    digests = release_manifest({"recorded": read, "derived": rows}).agg((F.count_distinct("row_count", "sha256") == 1).alias("same_digest"))
    return ranges.withColumn("same_digest", digests.scalar())
