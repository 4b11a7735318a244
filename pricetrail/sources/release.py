"""Writing, re-checking and fingerprinting published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.functions.reasons import stacked
from pricetrail.functions.text import canonical_json


def write_release(df: DataFrame, path: str, order: list[str], fmt: str = "parquet", files: int | None = None) -> None:
    """Range-partitioned and sorted within files, so equal data gives equal rows per file."""
    columns = sorted(df.columns)
    out = df.select(*columns)
    out = out.repartitionByRange(files, *order) if files else out.repartitionByRange(*order)
    out.sortWithinPartitions(*order, *[c for c in columns if c not in order]).write.mode("overwrite").format(fmt).save(path)


def release_files(spark: SparkSession, path: str, schema: T.StructType, key: str, fmt: str = "parquet") -> DataFrame:
    """(path, row_count, first_key, last_key, sha256) of every file of a release.

    The digest is over the rows a file holds, not its bytes, so equal rows have
    equal digests whatever the writer's version. It is a sum of row hashes and
    folds map-side.
    """
    rows = spark.read.schema(schema).format(fmt).load(path)
    names = sorted(schema.names)
    parts = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), *row_hash_sums(canonical_json(*names))
    )
    return parts.select("path", "row_count", "first_key", "last_key", folded_digest().alias("sha256"))


def row_hash_sums(text: Column) -> list[Column]:
    """The four 64-bit words of the rows' hashes, summed."""
    digest = F.sha2(text, 256)
    return [
        F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"w{i}")
        for i in range(4)
    ]


def folded_digest() -> Column:
    return F.sha2(F.concat_ws(":", "w0", "w1", "w2", "w3"), 256)


def release_difference(recorded: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows only recorded and rows only derived, with how often they differ.

    Both sides fold to counts per row first, so copies cost nothing.
    """
    columns = sorted(derived.columns)
    signed = stacked(
        recorded.select(*columns, F.lit(-1).alias("sign")), derived.select(*columns, F.lit(1).alias("sign"))
    )
    return signed.groupBy(*columns).agg(F.sum("sign").alias("surplus")).where("surplus <> 0").withColumn(
        "side", F.when(F.col("surplus") > 0, F.lit("only_derived")).otherwise(F.lit("only_recorded"))
    ).withColumn("surplus", F.abs("surplus"))


def check_release(spark: SparkSession, derived: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Re-derived rows against what was written; empty when they agree."""
    return release_difference(spark.read.schema(derived.schema).format(fmt).load(path), derived)


def release_manifest(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows, bytes and digest per dataset.

    A row's canonical JSON is hashed; the four 64-bit words of the hashes are
    summed per dataset. Sums do not depend on order or partitioning and fold
    map-side, so the digest needs no sort and no single task over the rows.
    """
    parts = []
    for name, df in datasets.items():
        text = canonical_json(*df.columns)
        parts.append(df.agg(
            F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("byte_count"), *row_hash_sums(text)
        ).select(
            F.lit(name).alias("dataset"), "row_count", "byte_count", folded_digest().alias("sha256")
        ))
    return stacked(*parts)
