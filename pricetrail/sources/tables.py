"""The star-schema tables a deployment keeps its observations in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A fixed table written in code, planned as a local relation of known size."""

    def lit(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, (int, float)):
            return str(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    names = [c.split()[0] for c in columns.split(",")]
    types = [c.split()[1] for c in columns.split(",")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True))
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({', '.join(names)})")
