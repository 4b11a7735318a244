"""Mixing sources to target weights.

Each source's words form one stream, cut into fixed-length blocks. The mix is a
row of output shards of slots. First every shard draws how many of its slots each
source gets. From that table of counts a source's slots are numbered through the
shards, and its o-th slot takes block perm(o mod n) of the source's n blocks,
under a permutation keyed by the source and the pass o div n; inside a shard the
slots are shuffled. Blocks then join their slots by index.

The draws are multinomial counts conditioned on the mix's totals: a pseudorandom
permutation deals all slots of all sources to the shards. A free draw would miss
a small source's target by its random walk and could pass the limit of three
passes; the condition keeps the totals and leaves the shards random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.common import WORD, discard, row_chunks, running_start, write_out

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
PASSES = 3
#: Slots that one row expands to, so that a large source is dealt to many tasks.
PIECE = 8192
ROUNDS = 12


def permute(x: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1 (n of any size) by swap-or-not rounds."""

    def swap(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(F.lit(1), *key, r, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each whole text, 0 for null."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, target, blocks, slots, first slot.

    Weights are 1, 2, 3, repeating by code point, null last. A target is
    level * weight, at most PASSES times the source's size; the level is where
    the targets sum to all sizes: with sources in order of size / weight, it is
    found at the first one that stays under its limit.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("sid", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", F.col("sid") % 3 + 1)
    whole = Window.partitionBy()
    earlier = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ratio", PASSES * F.col("source_size") / F.col("weight")).withColumns({
        "_left": F.sum("source_size").over(whole) - PASSES * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)),
        "_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
    })
    rows = rows.withColumn("_level", F.col("_left") / F.col("_weight"))
    rows = rows.withColumn("level", F.min_by(F.when(F.col("ratio") > F.col("_level"), F.col("_level")), F.when(F.col("ratio") > F.col("_level"), F.struct("ratio", "sid"))).over(whole))
    limit = (PASSES * F.col("source_size")).cast("double")
    rows = rows.withColumn("target", F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), PASSES * F.col("blocks")))
    rows = rows.withColumn("slots", F.coalesce(slots, F.lit(0)))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all_slots", F.sum("slots").over(whole))
    return rows.select("sid", "source", "source_size", "target", "blocks", "slots", "first_slot", "all_slots")


def shard_counts(sources: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, sid, n): the draws, how many slots of each shard a source gets. They sum to `slots` per source."""
    pieces = sources.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / PIECE))).alias("piece"))
    # A number of its own: sizes do not tell how far a row expands, so adaptive merging would put all pieces in one task.
    pieces = pieces.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "piece")
    o = F.explode(F.sequence(F.col("piece") * PIECE, F.least((F.col("piece") + 1) * PIECE, F.col("slots")) - 1))
    rows = pieces.select("sid", "first_slot", "all_slots", o.alias("o"))
    dealt = permute(F.col("first_slot") + F.col("o"), F.col("all_slots"), F.lit(seed))
    return rows.groupBy(F.floor(dealt / SHARD_SLOTS).alias("shard"), "sid").agg(F.count("*").alias("n"))


def slots(sources: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """Every slot of the mix from the shards' counts: (shard, position, sid, block, pass_no).

    A source's slots are numbered over the shards, so its passes are complete
    before the next begins, whatever the draws were. A shard's rows are one per
    source and expand to its own slots.
    """
    numbered = running_start(counts, ["sid"], "shard", "n", row_chunks(counts), "first")
    shard = Window.partitionBy("shard")
    before = shard.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumns({"ahead": F.coalesce(F.sum("n").over(before), F.lit(0)), "filled": F.sum("n").over(shard)})
    of = sources.select(F.col("sid").alias("_sid"), "blocks")
    rows = numbered.join(of, F.col("sid") == F.col("_sid")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    o = F.col("first") + F.col("k")
    rows = rows.withColumns({"pass_no": F.floor(o / F.col("blocks")), "index": o % F.col("blocks")})
    return rows.select(
        "shard", (F.col("shard") * SHARD_SLOTS + permute(F.col("ahead") + F.col("k"), F.col("filled"), F.lit(seed), F.col("shard"))).alias("position"), "sid",
        permute(F.col("index"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("pass_no")).alias("block"), "pass_no",
    )


def packed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the source's figures and `start`, their first word's place in the source's stream."""
    keyed = sources.select("sid", F.col("source").alias("_s"), "source_size", "target")
    rows = sizes.join(keyed, sizes["source"].eqNullSafe(keyed["_s"])).drop("_s", "source")
    return running_start(rows, ["sid"], "doc_id", "size", row_chunks(rows), "start")


def doc_blocks(rows: DataFrame) -> DataFrame:
    """Rows once for each block they reach into, with the words they have there."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    spread = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), last)))
    lo = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return spread.withColumn("words", hi - lo).withColumn("from_word", lo - F.col("start"))


def plan(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables of a mix: sources, packed documents, and slots.

    Null source is a source, last in order; null text has no words and is never
    taken. Rows with equal ids are packed side by side as rows of their own. An
    empty table gives empty results.
    """
    sizes = write_out(sized(docs), "mix-sizes")
    sources = write_out(targets(sizes), "mix-sources")
    rows = write_out(packed(sizes, sources), "mix-packed")
    counts = write_out(shard_counts(sources, seed), "mix-counts")
    dealt = write_out(slots(sources, counts, seed), "mix-slots")
    for table in (sizes, counts):
        discard(table)
    return sources, rows, dealt


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as (shard, position, source, block, pass_no): which block of a source's stream stands at each place."""
    sources, rows, dealt = plan(docs, seed)
    discard(rows)
    return dealt.join(sources.select("sid", "source"), "sid").select("shard", "position", "source", "block", "pass_no")


def times_taken(dealt: DataFrame) -> DataFrame:
    """(sid, block, times, at): how often a block is taken, and where first."""
    return dealt.groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("position").alias("at"))


def taken_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, first_position) for every row; the last two null where nothing is taken."""
    _, rows, dealt = plan(docs, seed)
    spread = doc_blocks(rows).select("sid", "block", "doc_id", "start", "size", "source_size", "target", "words")
    hit = spread.join(times_taken(dealt), ["sid", "block"], "left").groupBy("sid", "start", "doc_id", "size", "source_size", "target")
    full = hit.agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), F.min("at").alias("first_position"))
    none = rows.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_position": F.lit(None).cast("long")})
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_position"]
    out = full.select(*columns).unionByName(none.select(*columns))
    return out.select(*columns[:-1], F.floor(F.col("first_position") / SHARD_SLOTS).alias("first_shard"), "first_position")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents: a row of its own for the words taken once or more, twice or more, three times.

    All columns stay; text holds the taken words with the white space after
    them, the whole text as it was where all its blocks are taken, and n_chars,
    where there is such a column, its length. Rows are matched by doc_id, and
    rows with equal doc_id by the order of their sizes; a null doc_id is an id.
    """
    _, rows, dealt = plan(docs, seed)
    spread = doc_blocks(rows).join(times_taken(dealt), ["sid", "block"])
    spans = spread.groupBy("doc_id", "start", "size").agg(
        F.array_sort(F.collect_list(F.struct("from_word", "words", "times"))).alias("_spans")
    )
    same = Window.partitionBy("doc_id").orderBy("size", "start")
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "_spans", F.row_number().over(same).alias("_nth"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The table's own columns travel in a struct, where no name can clash.
    numbered = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", size.alias("_n")).where("_n > 0")
    return _layers(numbered, spans, docs)


def _layers(rows: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    nth = Window.partitionBy("doc_id", "_n").orderBy(F.xxhash64("text"))
    again = Window.partitionBy("_id", "_size").orderBy("_nth")
    spans = spans.withColumn("_k", F.row_number().over(again)).drop("_nth")
    held = rows.withColumn("_k2", F.row_number().over(nth)).join(
        spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")) & (F.col("_k2") == F.col("_k"))
    )
    held = held.withColumn("_layer", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_spans", lambda s: s["times"])).cast("int"))))
    held = held.withColumn("_in", F.filter("_spans", lambda s: s["times"] >= F.col("_layer")))
    got = F.aggregate("_in", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    held = held.withColumn("_words", F.when(got < F.col("_n"), F.regexp_extract_all("text", F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))))
    part = F.array_join(F.flatten(F.transform("_in", lambda s: F.slice("_words", (s["from_word"] + 1).cast("int"), s["words"].cast("int")))), "")
    held = held.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(part))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return held.select(*[made.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
