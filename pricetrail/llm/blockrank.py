"""Ranked lexical search by dense blocked matrix products.

The items' terms make a compact vocabulary; it is cut into tiles. Per tile, the
weights of a block of items (items x terms) and the impacts of a block of
documents (terms x documents) are dense float64 matrices, multiplied by BLAS.
A tile's column sums are bounded below 2**53, so every product is an exact
integer; tiles are added up in 64-bit integers. Each task keeps every item's
best documents, equal scores by document id, and the tasks' lists are ranked
once more.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetrail.llm.common import discard, in_chunks, running_start, write_out

#: Bytes outside `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]` become blanks, A-Z becomes a-z; UTF-8 bytes from 0x80 stay.
TO_TERMS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: An impact (10**9 * tf) div (1000 * tf + 12 * m) is below this.
IMPACT = 10**6
EXACT = 1 << 53
#: Entries (item, term) of the items that one pass over the documents answers: bounds what a pass sends to its tasks.
PASS_ENTRIES = 400_000
ITEM_BLOCK, TERM_TILE, DOC_BLOCK = 256, 1024, 2048
#: 32768 bits in each of so many pieces: the sieve of terms that may be an item's.
SIEVE_PIECES = 128
SIEVE_BITS = SIEVE_PIECES * 32768


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return [] if text is None else text.translate(TO_TERMS).split()


def entries_of(items: DataFrame) -> DataFrame:
    """(item, term, c): how often each item holds each term. `items` has (item, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                if held := Counter(terms_of(text)):
                    yield pd.DataFrame({"item": item, "term": pd.Series([t.decode() for t in held], dtype=object), "slot": [zlib.crc32(t) % SIEVE_BITS for t in held], "c": list(held.values())})

    rows = items.select("item", F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "item long, term string, slot long, c long")


def sieve_of(entries: DataFrame) -> bytes:
    """One byte per slot, 1 where an item's term hashes to it: a fixed size whatever the items hold."""
    at = F.col("slot")
    pieces = entries.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    sieve = np.zeros(SIEVE_BITS + 1, dtype=np.uint8)
    # Bucket b holds the values from 32768 * (b - 1) + 1 on; 0 lies at the end of bucket 0.
    for piece, bits in pieces.collect():
        start = 32768 * (piece - 1) + 1
        on = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
        held = np.flatnonzero(on) + start
        sieve[held[held >= 0]] = 1
        if piece == 0:
            sieve[0] = 1
    return sieve.tobytes()


def documents_of(docs: DataFrame, sieve: bytes, kind: str) -> DataFrame:
    """(doc_id, no_id, n, terms, tfs) of documents with a term: its size, and the terms that pass the sieve with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, terms, tfs = [], [], []
            for text in pdf["text"]:
                found = terms_of(text)
                held = [(t, k) for t, k in Counter(found).items() if sieve[zlib.crc32(t) % SIEVE_BITS]]
                sizes.append(len(found))
                terms.append(b" ".join(t for t, _ in held).decode())
                tfs.append(np.array([k for _, k in held], dtype=np.int64).tobytes())
            yield pdf[["doc_id", "no_id"]].assign(n=sizes, terms=pd.Series(terms, dtype=object), tfs=tfs)

    # Ids stay whole in pandas: none is null, and a flag tells which were.
    rows = docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, no_id boolean, n long, terms string, tfs binary").where("n > 0")


def weighted(entries: DataFrame, held: DataFrame, n_docs: int) -> DataFrame:
    """(item, term, c, w) of the entries whose term some document holds."""
    found = held.select(F.explode(F.split("terms", " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
    return entries.join(found, "term").select("item", "term", "c", w.cast("long").alias("w")).where("w > 0")


def passes(entries: DataFrame, per_pass: int) -> tuple[DataFrame, int]:
    """The entries with the pass that answers their item, and the number of passes: whole items, about `per_pass` entries each."""
    sizes = entries.groupBy("item").agg(F.count("*").alias("size"))
    starts = running_start(sizes, [], "item", "size", 1 + entries.count() // per_pass, "start")
    turn = starts.select(F.col("item").alias("_i"), F.expr(f"CAST(start div {per_pass} AS INT)").alias("turn"))
    out = write_out(entries.join(turn, F.col("item") == F.col("_i")).drop("_i"), "rank-passes")
    last = out.agg(F.max("turn")).first()[0]
    return out, 0 if last is None else last + 1


class Tiles:
    """A pass's items in blocks, each with its compact vocabulary cut into tiles of bounded sums."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, block: int, tile: int) -> None:
        self.items, row = np.unique(items, return_inverse=True)
        names, col = np.unique(terms, return_inverse=True)
        self.place = {t: i for i, t in enumerate(names)}
        self.block = block
        self.blocks: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for start in range(0, len(self.items), block):
            at = np.flatnonzero((row >= start) & (row < start + block))
            self.blocks.append(self._tiles(row[at] - start, col[at], counts[at], weights[at], min(block, len(self.items) - start), tile))

    @staticmethod
    def _tiles(row: np.ndarray, col: np.ndarray, c: np.ndarray, w: np.ndarray, n: int, tile: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        while len(row):
            # What one tile cannot hold of a repeated term is left for a further one.
            now = np.minimum(c, (EXACT // IMPACT - 1) // w)
            for cols in np.array_split(np.unique(col), -(-len(np.unique(col)) // tile)):
                pending = [cols]
                while pending:
                    part = pending.pop()
                    at = np.flatnonzero(np.isin(col, part))
                    q = np.zeros((n, len(part)))
                    q[row[at], np.searchsorted(part, col[at])] = now[at] * w[at]
                    if q.sum(axis=1).max() * IMPACT < EXACT:
                        out.append((part, q))
                    else:
                        half = len(part) // 2
                        pending += [part[:half], part[half:]]
            rest = c > now
            row, col, c, w = row[rest], col[rest], (c - now)[rest], w[rest]
        return out

    def scores(self, k: int, doc: np.ndarray, col: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """(items of block k, documents) exact scores; (doc, col, impact) are the documents' entries, sorted by col."""
        total = np.zeros((min(self.block, len(self.items) - k * self.block), n_docs), dtype=np.int64)
        for cols, q in self.blocks[k]:
            lo, hi = np.searchsorted(col, [cols[0], cols[-1] + 1])
            at = np.searchsorted(cols, col[lo:hi])
            good = cols[at] == col[lo:hi]
            d = np.zeros((len(cols), n_docs))
            d[at[good], doc[lo:hi][good]] = impact[lo:hi][good]
            total += (q @ d).astype(np.int64)
        return total


def best_of(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal scores by `order`; ties at the end are settled, not cut by chance."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((order[at], -scores[at]))][:k]


def answers(held: DataFrame, tiles, top: int, n_docs: int, n_terms: int, kind: str) -> DataFrame:
    """(item, doc_id, no_id, score): per task, the best documents of every item of one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Tiles = tiles.value
        best: dict[int, list[tuple]] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), DOC_BLOCK):
                part = pdf.iloc[lo:lo + DOC_BLOCK]
                doc, col, tf = [], [], []
                for i, (terms, tfs) in enumerate(zip(part["terms"], part["tfs"], strict=True)):
                    at = [own.place.get(t, -1) for t in terms.split()]
                    doc.append(np.full(len(at), i))
                    col.append(np.array(at, dtype=np.int64))
                    tf.append(np.frombuffer(tfs, dtype=np.int64))
                m = np.array([75 + 25 * int(n) * n_docs // n_terms for n in part["n"]], dtype=np.int64)
                doc, col, tf = np.concatenate(doc), np.concatenate(col), np.concatenate(tf)
                known = np.flatnonzero(col >= 0)
                known = known[np.argsort(col[known], kind="stable")]
                doc, col, tf = doc[known], col[known], tf[known]
                impact = (10**9 * tf) // (1000 * tf + 12 * m[doc])
                ids, lacking = part["doc_id"].tolist(), part["no_id"].tolist()
                order = np.empty(len(part), dtype=np.int64)
                order[sorted(range(len(part)), key=lambda i: (lacking[i], ids[i]))] = np.arange(len(part))
                for k in range(len(own.blocks)):
                    scores = own.scores(k, doc, col, impact, len(part))
                    for r in range(len(scores)):
                        if len(at := best_of(scores[r], order, top)):
                            item = k * own.block + r
                            new = [(-int(scores[r, i]), lacking[i], ids[i]) for i in at]
                            best[item] = sorted(best[item] + new)[:top] if item in best else new
        for item, rows in best.items():
            score, no_id, doc_id = zip(*rows, strict=True)
            yield pd.DataFrame({"item": own.items[item], "doc_id": doc_id, "no_id": no_id, "score": [-x for x in score]})

    return held.mapInPandas(run, f"item long, doc_id {kind}, no_id boolean, score long")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 20, per_pass: int = PASS_ENTRIES) -> DataFrame:
    """Each item's `top` documents with the highest scores above 0: (item_id, rank, doc_id, score).

    `docs` has (doc_id, text), `items` (item_id, text); other columns are not
    read. Texts may be null, empty or long. Every row of `docs` is a document and
    every row of `items` an item of its own, also where ids are null or repeat;
    a null doc_id comes after all others among equal scores. Items without terms,
    or whose terms no document holds, have no rows; empty tables give none.

    Documents are reduced once to their counts of terms that pass the sieve of
    the items' terms (false positives cost space, never rows) and written. Items
    are answered in passes of about `per_pass` entries, the bound on what is sent
    to the tasks besides the one item that may exceed it.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    numbered = write_out(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "rank-items")
    entries = write_out(entries_of(numbered.select("item", "text")), "rank-entries")
    held = write_out(documents_of(docs, sieve_of(entries), kind), "rank-documents")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    turns, n_passes = passes(weighted(entries, held, n_docs), per_pass)
    found: DataFrame | None = None
    for turn in range(n_passes):
        rows = turns.where(F.col("turn") == turn).select("item", "term", "c", "w").toPandas()
        tiles = spark.sparkContext.broadcast(Tiles(rows["item"].to_numpy(), rows["term"].to_numpy(dtype=object), rows["c"].to_numpy(), rows["w"].to_numpy(), ITEM_BLOCK, TERM_TILE))
        part = write_out(answers(held, tiles, top, n_docs, n_terms, kind), "rank-answers")
        tiles.destroy()
        found = part if found is None else found.unionByName(part)
    discard(entries)
    discard(turns)
    discard(held)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", F.expr("IF(no_id, NULL, doc_id)").alias("doc_id"), "score")
