"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the nearest vertex of the cross-polytope, that is the
largest coordinate and its sign. A table joins `width` rotations into a bucket.
Every vector is stored in its own bucket of each table and looked up in the
buckets of its two nearest vertices per rotation. Pairs that meet are checked by
cosine in double precision.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import components, write_out

COSINE = 0.93
#: Least chance that a rotation's nearest vertex of one vector is among the two nearest of another at COSINE, and the chance of a miss that the number of tables allows.
HIT = 0.72
MISS = 1e-6


def shape(classes: int, vertices: int = 128) -> tuple[int, int]:
    """(width, tables): so many rotations that a bucket holds few vectors, so many tables that MISS holds."""
    width = max(2, math.ceil(math.log(max(classes, 2)) / math.log(vertices)))
    return width, math.ceil(math.log(MISS) / math.log(1 - HIT**width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x


def vertices(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """The two nearest cross-polytope vertices of each row under one pseudorandom rotation: (rows, 2)."""
    signs = np.random.default_rng([x.shape[1], table, turn]).choice((-1.0, 1.0), size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :2]
    return top * 2 + (np.take_along_axis(x, top, axis=1) < 0)


def keyed(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, key, vec): key names label and vector, null for what links with nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            keys, packed = [], []
            for label, v in zip(pdf["label"], pdf["embedding"], strict=True):
                x = None if v is None else np.array([np.nan if c is None else c for c in v], dtype=np.float64)
                good = x is not None and label is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                x = x + 0.0 if good else None
                packed.append(x.tobytes() if good else None)
                keys.append(xxhash.xxh3_128_digest(str(label).encode() + b"\0" + packed[-1]) if good else None)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].array, "label": pdf["label"].array, "key": keys, "vec": packed})

    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return rows.mapInPandas(run, f"vec_id {kind}, label string, key binary, vec binary")


def buckets(classes: DataFrame, width: int, tables: int, probing: bool) -> DataFrame:
    """(label, slot, id): the bucket a vector is stored in, or all buckets it looks into, table by table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["vec"].map(len).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = np.frombuffer(b"".join(pdf["vec"].iloc[at]), dtype=np.float64).reshape(len(at), -1)
                full = 1 << max(0, (x.shape[1] - 1).bit_length())
                # Scaled by its largest component first, so that squares stay finite.
                x = np.pad(x / np.abs(x).max(axis=1, keepdims=True), ((0, 0), (0, full - x.shape[1])))
                ids, labels = pdf["id"].iloc[at].array, pdf["label"].iloc[at].array
                for table in range(tables):
                    near = [vertices(x, table, turn) for turn in range(width)]
                    for pick in itertools.product(range(min(2, near[0].shape[1]) if probing else 1), repeat=width):
                        slot = np.full(len(at), int(n) * 1_000_003 + table, dtype=np.int64)
                        for k, p in enumerate(pick):
                            slot = slot * (2 * full + 1) + near[k][:, p]
                        yield pd.DataFrame({"label": labels, "slot": slot, "id": ids})

    return classes.select("label", "vec", F.col("node").alias("id")).mapInPandas(run, "label string, slot long, id long")


def links(classes: DataFrame, width: int, tables: int, cosine: float) -> DataFrame:
    """Pairs (a, b) of nodes, different vectors with the cosine or more."""
    stored = buckets(classes, width, tables, False).withColumnRenamed("id", "x")
    looked = buckets(classes, width, tables, True).withColumnRenamed("id", "y")
    met = looked.join(stored, ["label", "slot"]).where("x <> y")
    pairs = write_out(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "polytope-pairs")
    vec = lambda side: classes.select(F.col("node").alias(side), F.col("vec").alias(f"v{side}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = np.zeros(len(pdf), dtype=bool)
            for i, (p, q) in enumerate(zip(pdf["va"], pdf["vb"], strict=True)):
                x, y = np.frombuffer(p), np.frombuffer(q)
                if len(x) == len(y):
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    good[i] = x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine
            yield pdf.loc[good, ["a", "b"]]

    return write_out(pairs.join(vec("a"), "a").join(vec("b"), "b").mapInPandas(check, "a long, b long"), "polytope-links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, label, embedding).

    Equal vectors of a label are one node with a count, so copies are linked but
    never paired out. Rows without label, or whose vector is null, empty, zero or
    has null or non-finite components, have no links and are their own component.
    Vectors of different lengths do not link. Rows that repeat a vec_id count one
    by one, with their own vectors; a row without vec_id takes part with its
    copies and links. A component's id is the least that is not null among its
    rows; a row without vec_id is kept where its component has none.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = write_out(keyed(vectors, kind), "polytope-vectors")
    grouped = rows.where("key IS NOT NULL").groupBy("key")
    merged = grouped.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    # Numbered as it is written: every reader sees the same numbers.
    classes = write_out(merged.withColumn("node", F.monotonically_increasing_id()), "polytope-classes")
    width, tables = shape(classes.count())
    found = links(classes, width, tables, cosine)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("node").alias("b"), F.col("copies").alias("more"))
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("more").alias("more"))
    roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "polytope").withColumnRenamed("node", "linked")
    held = classes.join(degree, F.col("node") == F.col("a"), "left").join(roots, F.col("node") == F.col("linked"), "left")
    held = held.select("key", "rep", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component"))
    held = write_out(held, "polytope-held")
    least = held.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("component_id"))
    named = held.join(least, F.col("component") == F.col("of")).select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
