from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def obs(spark, rows: list[tuple]) -> DataFrame:
    """(mpn, seller, 'YYYY-MM-DD[ HH:MM]', amount, vat) -> flat observations."""
    data = [(f"o-{i:03d}", m, s, t, a, v) for i, (m, s, t, a, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "observation_id string, mpn string, seller string, t string, amount_minor long, vat_included boolean")
    return df.withColumn("observed_at", F.to_timestamp("t")).drop("t")


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
