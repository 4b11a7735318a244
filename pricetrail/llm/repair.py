"""Token ids in shard files compressed by Re-Pair grammars.

Documents in ascending order of doc_id become runs of ids, each closed by an end
id. A shard of about SHARD_IDS ids is compressed on its own: frequent pairs of
neighbouring ids are replaced by nonterminals, round by round, until no pair is
frequent enough. A shard file holds the rules, the expansion length of each
nonterminal, the compressed symbols and the place of each document in them, so
that any document, or the id at any place, is decoded without the rest.

Shard bytes, all little-endian: magic RPR1; u32 documents, rules, symbols, first
nonterminal, bytes per symbol; rules (2 x u32 each); expansion lengths (u32);
symbol offset of each document and the end (u32); id offset likewise (u64);
symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.bpe import STEP, ByteBpe
from pricetrail.llm.common import in_chunks, work_folder

MAGIC = b"RPR1"
SHARD_IDS = 1 << 20
ROUNDS = 6
#: A pair must occur this often in a shard to earn a rule; at most RULES_A_ROUND rules come from one round.
LEAST_COUNT = 64
RULES_A_ROUND = 1500
END_ID = 2
SLOT_BITS = 20
_SEP = np.int32(-1)


class LibraryBpe(ByteBpe):
    """Piece store filled by the tokenizers library itself."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = np.array([len(b) for b in self.bytes_of])

    def learn(self, pieces: set[str]) -> None:
        from pricetrail.llm import bpe

        new = pieces.difference(self.known)
        if len(self.known) + len(new) > bpe.CACHE:
            # What this batch uses stays; the rest of the store goes.
            self.known = {p: self.known[p] for p in pieces if p in self.known}
            self.uneven.intersection_update(self.known)
        # Pieces that begin with a blank and end without one tokenise in a row as they do alone.
        rows = [p for p in new if p[:1] == " " and p not in self.uneven]
        parts = [rows[at : at + 1024] for at in range(0, len(rows), 1024)]
        for part, got in zip(parts, self.library.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<i4")
            ends = np.cumsum([len(p.encode()) for p in part])
            stops = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1) * 4
            packed = ids.tobytes()
            starts = [0, *stops[:-1].tolist()]
            self.known.update((p, packed[lo:hi]) for p, lo, hi in zip(part, starts, stops.tolist(), strict=True))
        alone = list(new.difference(rows))
        for p, e in zip(alone, self.library.encode_batch(alone, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, dtype="<i4").tobytes()


@lru_cache(maxsize=2)
def library(path: str) -> LibraryBpe:
    return LibraryBpe(path)


@dataclass
class Shard:
    """One decoded header with its arrays."""

    rules: np.ndarray
    lengths: np.ndarray
    symbol_at: np.ndarray
    id_at: np.ndarray
    symbols: np.ndarray
    first: int

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols."""
        now = symbols.astype(np.int64)
        while True:
            at = np.flatnonzero(now >= self.first)
            if not len(at):
                return now
            extra = np.zeros(len(now), dtype=np.int64)
            extra[at] = 1
            place = np.arange(len(now)) + np.cumsum(extra) - extra
            out = np.empty(len(now) + len(at), dtype=np.int64)
            out[place] = now
            pair = self.rules[now[at] - self.first]
            out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
            now = out

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, its end id included."""
        return self.expand(self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]])

    def id_of(self, place: int) -> int:
        """The id at a place of the shard, by expansion lengths, without decoding what lies before."""
        doc = int(np.searchsorted(self.id_at, place, side="right")) - 1
        run = self.symbols[self.symbol_at[doc] : self.symbol_at[doc + 1]].astype(np.int64)
        ends = np.cumsum(np.where(run >= self.first, self.lengths[np.maximum(run - self.first, 0)] if len(self.lengths) else 1, 1))
        rest = place - int(self.id_at[doc])
        k = int(np.searchsorted(ends, rest, side="right"))
        rest -= int(ends[k - 1]) if k else 0
        symbol = int(run[k])
        while symbol >= self.first:
            left, right = (int(x) for x in self.rules[symbol - self.first])
            n = int(self.lengths[left - self.first]) if left >= self.first else 1
            symbol, rest = (left, rest) if rest < n else (right, rest - n)
        return symbol


def compress(documents: list[np.ndarray], first: int) -> bytes:
    """The shard file of these documents; symbols from `first` up are nonterminals."""
    counts = np.array([len(d) for d in documents], dtype=np.int64)
    ends = np.cumsum(counts + 1) - 1
    seq = np.full(int(counts.sum()) + len(documents), _SEP, dtype=np.int32)
    inside = np.ones(len(seq), dtype=bool)
    inside[ends] = False
    seq[inside] = np.concatenate(documents) if documents else 0
    rules: list[np.ndarray] = []
    base = first
    for _ in range(ROUNDS):
        # Counts by hash first: only positions whose hash is frequent need their pairs counted exactly.
        u = seq.view(np.uint32)
        slot = (u[:-1] * np.uint32(2654435761) + u[1:] * np.uint32(2246822519)) >> np.uint32(32 - SLOT_BITS)
        hot = np.bincount(slot, minlength=1 << SLOT_BITS) >= LEAST_COUNT
        at = np.flatnonzero(hot[slot])
        left, right = seq[at], seq[at + 1]
        whole = (left >= 0) & (right >= 0)
        at, code = at[whole], left[whole].astype(np.int64) << 31 | right[whole]
        ordered = np.sort(code)
        starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        keys, n = ordered[starts], np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(n >= LEAST_COUNT)
        if not len(often):
            break
        often = often[np.argsort(-n[often], kind="stable")[:RULES_A_ROUND]]
        chosen = np.sort(keys[often])
        # A slot serves its most frequent pair now; another pair of it waits for the next round.
        by_count = keys[often][::-1]
        c = by_count.view(np.uint64)
        home = ((c >> np.uint64(31)).astype(np.uint32) * np.uint32(2654435761) + (c & np.uint64((1 << 31) - 1)).astype(np.uint32) * np.uint32(2246822519)) >> np.uint32(32 - SLOT_BITS)
        rule_of = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        rule_of[home] = np.searchsorted(chosen, by_count)
        rule = rule_of[slot[at]]
        good = (rule >= 0) & (chosen[rule] == code)
        hit, rule = at[good], rule[good]
        # Hits in a row overlap; from the left, every second one is replaced.
        fresh = np.concatenate(([True], np.diff(hit) != 1))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        odd = (np.arange(len(hit)) - run) % 2 == 0
        hit, rule = hit[odd], rule[odd]
        seq[hit] = base + rule
        keep = np.ones(len(seq), dtype=bool)
        keep[hit + 1] = False
        seq = seq[keep]
        rules.append(np.stack((chosen >> 31, chosen & ((1 << 31) - 1)), axis=1))
        base += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths = np.ones(len(table), dtype=np.int64)
    for i, (a, b) in enumerate(table.tolist()):
        lengths[i] = (lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1)
    stops = np.flatnonzero(seq == _SEP)
    symbol_at = np.concatenate(([0], stops - np.arange(len(stops))))
    symbols = seq[seq != _SEP]
    width = 2 if base <= 1 << 16 else 4
    head = np.array([len(documents), len(table), len(symbols), first, width], dtype="<u4")
    parts = [head, table.astype("<u4"), lengths.astype("<u4"), symbol_at.astype("<u4"), np.concatenate(([0], np.cumsum(counts))).astype("<u8"), symbols.astype(f"<u{width}")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def open_shard(data: bytes) -> Shard:
    """Arrays of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    docs, rules, symbols, first, width = np.frombuffer(data, "<u4", 5, 4).tolist()
    at = 24
    out = []
    for kind, n in (("<u4", 2 * rules), ("<u4", rules), ("<u4", docs + 1), ("<u8", docs + 1), (f"<u{width}", symbols)):
        out.append(np.frombuffer(data, kind, n, at).astype(np.int64) if kind != f"<u{width}" else np.frombuffer(data, kind, n, at))
        at += n * int(kind[2])
    return Shard(out[0].reshape(-1, 2), out[1], out[2], out[3], out[4], first)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode all documents in ascending order of doc_id (null first) into shard files under `path`.

    A null text counts as empty: its run is the end id alone. Rows with equal
    ids follow each other in the order of their texts. Spark's writer commits
    the files, so a lost executor leaves no half shard.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        coder, part = library(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<i4")
        ids: list = []
        runs: list[np.ndarray] = []
        held, number = 0, 0

        def shard() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "number": [number], "n_ids": [held], "doc_ids": [ids], "data": [compress(runs, coder.size)]})

        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for lo, hi in in_chunks(texts, STEP // 2):
                for doc_id, got in zip(pdf["doc_id"].iloc[lo:hi].tolist(), coder.encode_batch(texts[lo:hi]), strict=True):
                    ids.append(None if pd.isna(doc_id) else doc_id)
                    runs.append(np.concatenate((got, end)))
                    held += len(got) + 1
                    if held >= SHARD_IDS:
                        yield shard()
                        ids, runs, held, number = [], [], 0, number + 1
        if ids:
            yield shard()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInPandas(run, f"part int, number int, n_ids long, doc_ids array<{kind}>, data binary").write.parquet(path)


def read_documents(shards: DataFrame, kind: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from its shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_ids, base, data in zip(pdf["doc_ids"], pdf["base"], pdf["data"], strict=True):
                shard = open_shard(data)
                crc, counts = [], np.diff(shard.id_at)
                packed = shard.expand(shard.symbols).astype("<u4").tobytes()
                for lo, hi in zip(shard.id_at[:-1].tolist(), shard.id_at[1:].tolist(), strict=True):
                    crc.append(zlib.crc32(packed[4 * lo : 4 * hi]))
                yield pd.DataFrame({"doc_id": list(doc_ids), "start": base + shard.id_at[:-1], "n_tokens": counts, "ids_crc32": crc})

    # One row per shard of about a million ids; the shards' places are found here, the ids are not touched.
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "number", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    rows = shards.join(places, ["part", "number"]).select("doc_ids", "base", "data")
    return rows.mapInPandas(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def through_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the shard files to the shared folder and decode every document from them."""
    from uuid import uuid4

    spark = docs.sparkSession
    path = f"{work_folder(spark)}/repair-{uuid4().hex}"
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(spark.read.parquet(path), docs.schema["doc_id"].dataType.simpleString())
