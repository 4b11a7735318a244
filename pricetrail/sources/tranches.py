"""Writing and reading batch files: observations, ledgers, manifests and raw bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail import schemas


#: Columns of a tranche besides its observations.
TRANCHE_HEADER = ("schema_version", "tranche_id", "status", "scope", "region", "channel", "created_at", "evidence_ledger")


def write_tranches(rows: DataFrame, path: str) -> None:
    """Append one JSON file per tranche: rows of its header columns and an observation struct `o`.

    A tranche is one document, held by one task; fields an observation does not
    use are left out. Files already there stay as they are.
    """
    header = [c for c in TRANCHE_HEADER if c in rows.columns]
    held = F.array_sort(F.collect_list(F.struct(F.col("o.observation_id").alias("id"), "o")))
    out = rows.groupBy(*header).agg(F.transform(held, lambda x: x["o"]).alias("observations"))
    out.write.mode("append").option("maxRecordsPerFile", 1).json(path)


def read_tranches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per observation of every batch file, with its batch columns and file."""
    raw = spark.read.schema(schemas.TRANCHE).option("multiLine", True).json(paths)
    return raw.select(
        "schema_version", "tranche_id", F.col("status").alias("tranche_status"), F.col("scope").alias("tranche_scope"),
        "channel", "created_at", "evidence_ledger", F.col("_metadata.file_path").alias("source_file"),
        F.explode("observations").alias("o"),
    ).select("schema_version", "tranche_id", "tranche_status", "tranche_scope", "channel", "created_at", "evidence_ledger", "source_file", "o.*")


def read_ledger(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.schema(schemas.LEDGER).option("multiLine", True).json(paths)
    return raw.select(F.explode("entries").alias("e")).select("e.*", F.col("e.facts.mpn").alias("fact_mpn"))


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(paths)
    return raw.select(F.explode("entries").alias("e")).select("e.*")


def read_run_ledger(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, missed slots, acknowledgements)."""
    raw = spark.read.schema(schemas.RUN_LEDGER).option("multiLine", True).json(paths)
    return tuple(raw.select(F.explode(c).alias("e")).select("e.*") for c in ("runs", "missed_slots", "acknowledgements"))


def input_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Digest and header of every batch file, read as bytes."""
    files = spark.read.format("binaryFile").load(paths)
    header = F.from_json(F.decode("content", "UTF-8"), schemas.TRANCHE)
    classes = F.coalesce(F.col("h.observations.source.source_class"), F.array().cast("array<string>"))
    some = F.size(classes) > 0
    return files.select("path", F.sha2("content", 256).alias("sha256"), header.alias("h")).select(
        "path", "sha256", F.col("h.tranche_id").alias("name"), F.coalesce(F.size("h.observations"), F.lit(0)).cast("long").alias("observations"), F.col("h.schema_version").alias("file_schema_version"), F.col("h.scope").alias("file_scope"),
        F.col("h.channel").alias("file_channel"), F.col("h.status").alias("file_status"),
        (some & F.forall(classes, lambda c: c.eqNullSafe(F.lit("archived_primary_retail_storefront")))).alias("all_archived_primary_retail"),
        (some & F.forall(classes, lambda c: F.coalesce(c.startswith("archived_"), F.lit(False)))).alias("all_archived"),
    )
