"""Shared pieces: written intermediates, row splits, text pieces, components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from collections.abc import Iterator, Sequence
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetrail.session import shared_folder

#: White space of the word rule `[^\x20\x09-\x0D]+`, for translate().
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; one of our own only in local mode, else an error."""
    return shared_folder(spark)


@lru_cache(maxsize=4)
def _ship(app_id: str) -> None:
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="pricetrail-code-"), "pricetrail_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    SparkSession.active().sparkContext.addPyFile(path)


def ship_code(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, through Spark's own file service."""
    _ship(spark.sparkContext.applicationId)
    return spark


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> SparkSession:
    """Bound what a Python task is handed at once by bytes as well as rows: long texts come in smaller batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts lineage and survives lost executors; readers plan from the files.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of write_out() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs, which it does once the driver has collected their plans."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def split_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod `modulus` = `remainder`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learned_from(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows a model may learn from: a known id whose remainder is another one."""
    return doc_id.isNotNull() & ~split_is(doc_id, modulus, remainder)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+` as UTF-8 bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def in_chunks(texts: Sequence[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about `limit` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def row_chunks(rows: DataFrame, per_chunk: int = 20_000) -> int:
    """How many hash chunks keep about `per_chunk` rows in each."""
    return max(1, -(-rows.count() // per_chunk))


def running_start(rows: DataFrame, keys: Sequence[str], order: str, size: str, chunks: int, alias: str) -> DataFrame:
    """Sum of `size` over the earlier rows of a key, in the order of hash(order), order.

    Rows are summed inside (key, chunk), chunks being ranges of the hash, so a
    hot key is spread over its chunks. `keys` may hold nulls; `order` is unique.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.col(order)), 1)
    width = (1 << 63) // chunks + 1
    rows = rows.withColumns({
        "_place": place,
        "_chunk": F.expr(f"shiftrightunsigned(xxhash64({order}), 1) div {min(width, (1 << 63) - 1)}L"),
    })
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_place", order, size).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    match = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = held.join(sums, match, "left").withColumn(alias, F.col("_base") + F.col("_in"))
    return out.drop("_place", "_chunk", "_c", "_base", "_in", *[f"_k{i}" for i in range(len(keys))])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (u, v): rows (node, root) with root the smallest node.

    Every round hooks each node to the neighbour of least hash, renames the
    edges' ends by it and drops the loops, so a constant share of the nodes
    goes whatever the shape; the hooks are then composed. Neighbours are never
    gathered: hooks are minima that combine before the shuffle. Each round's
    tables are written, which cuts the lineage.
    """
    own = lambda c: F.struct(F.xxhash64(F.lit(7), F.col(c)).alias("h"), F.col(c).alias("n"))
    now = write_out(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    hooks: list[DataFrame] = []
    while not now.isEmpty():
        both = now.select(F.col("u").alias("node"), "v").unionByName(now.select(F.col("v").alias("node"), F.col("u").alias("v")))
        hook = both.groupBy("node").agg(F.min(own("v")).alias("m")).select("node", F.least(own("node"), F.col("m"))["n"].alias("root"))
        hook = write_out(hook, f"{name}-hooks")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = now.join(left, "u").join(right, "v").where("ru <> rv")
        after = write_out(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), f"{name}-edges")
        discard(now)
        now = after
    if not hooks:
        node = now.select(F.col("u").alias("node"))
        return node.withColumn("root", F.col("node"))
    labels = hooks[0]
    for hook in hooks[1:]:
        up = hook.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        labels = labels.join(up, labels["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
    least = labels.groupBy("root").agg(F.min("node").alias("_least"))
    return labels.join(least, "root").select("node", F.col("_least").alias("root"))
