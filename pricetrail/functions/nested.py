"""Walking free-form JSON and nested columns down to their leaves, as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nesting(text: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested; brackets inside strings do not count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, mark: Column) -> Column:
        now = s["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, step)["most"]


def type_depth(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 1 + max((type_depth(f.dataType) for f in kind.fields), default=0)
    if isinstance(kind, T.ArrayType):
        return 1 + type_depth(kind.elementType)
    if isinstance(kind, T.MapType):
        return 1 + type_depth(kind.valueType)
    return 0


def variant_leaves(rows: DataFrame, value: Column, depth: int) -> DataFrame:
    """(row, leaf, names): one row per leaf of a variant; `row` holds the input's columns.

    `names` are the keys on the way to the leaf, null for a place in an array.
    Every level unnests once, inside the same pass; a leaf that is reached early
    stays as it is. Empty objects and arrays are leaves.
    """
    spark = rows.sparkSession
    now = rows.select(F.struct("*").alias("row"), value.alias("leaf"), F.array().cast("array<string>").alias("names"))
    for _ in range(depth):
        below = now.lateralJoin(spark.tvf.variant_explode_outer(F.col("leaf").outer()))
        inner = F.col("pos").isNotNull()
        now = below.select(
            "row", F.when(inner, F.col("value")).otherwise(F.col("leaf")).alias("leaf"),
            F.when(inner, F.array_append("names", F.col("key"))).otherwise(F.col("names")).alias("names"),
        )
    return now


def json_leaves(rows: DataFrame, json_column: str) -> DataFrame:
    """The leaves of a column of JSON texts at any depth. A text that is no JSON has one null leaf.

    The depth is that of the deepest text, found in a pass of its own.
    """
    depth = rows.agg(F.max(nesting(F.col(json_column)))).first()[0] or 0
    return variant_leaves(rows, F.try_parse_json(F.col(json_column)), depth)


def typed_leaves(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The leaves of columns of structs, arrays and maps; the columns' own names come first."""
    held = rows.select(*columns)
    return variant_leaves(held, F.to_variant_object(F.struct("*")), type_depth(held.schema))
