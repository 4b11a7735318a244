"""Ordered passes that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_in_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], chunk: Column, alias: str = "prior"
) -> DataFrame:
    """Previous row's `carry` columns as a struct, without one task per key.

    `chunk` must grow with `order`. Rows are windowed inside (keys, chunk), and
    the first row of a chunk takes the tail of the chunk before it; tails are
    one row per (keys, chunk), so a hot key costs its number of chunks there.
    Null keys form a line of their own and null order values come first, as in
    `lag`; the chunk is met as a struct, which equals itself with nulls inside.
    """
    rows = df.withColumn("chunk_no", F.struct(*keys, chunk.alias("chunk_no")))
    inside = Window.partitionBy("chunk_no").orderBy(*order)
    tails = rows.groupBy("chunk_no").agg(F.max(F.struct(*order, *[c for c in carry if c not in order])).alias("tail"))
    across = Window.partitionBy(*[f"chunk_no.{k}" for k in keys]).orderBy("chunk_no.chunk_no")
    before = tails.select("chunk_no", F.lag("tail").over(across).alias("before"))
    held = rows.withColumns({
        "held": F.lag(F.struct(*carry)).over(inside),
        "place": F.row_number().over(inside),
    })
    from_tail = F.when(F.col("before").isNotNull(), F.struct(*[F.col(f"before.{c}").alias(c) for c in carry]))
    return (
        held.join(before, "chunk_no")
        .withColumn(alias, F.when(F.col("place") == 1, from_tail).otherwise(F.col("held")))
        .drop("chunk_no", "held", "place", "before")
    )
