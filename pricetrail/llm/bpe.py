"""Byte-level BPE through a pair occurrence index.

Distinct pieces of a batch are laid out in one array of symbols. An index maps
each pair to all its positions; active ranks are applied in ascending order, a
rank at all its positions at once, and only the lists of the pairs around a
merge change. A merge can only make pairs of a higher rank (checked on load),
so this equals merging each piece on its own, lowest rank and leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed by the byte-level format: the printable stand-in of each byte, and the split of a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept per worker; beyond it only those in use stay.
CACHE = 700_000


def _byte_names() -> list[str]:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {name: b for b, name in enumerate(_byte_names())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.start = np.array([vocab[name] for name in _byte_names()], dtype=np.int64)
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.apart = regex.compile(r"(?<=\S)(?= )")
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        made: dict[int, int] = {}
        for rank, (a, b, c) in enumerate(pairs):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank or c in made:
                raise ValueError("a merge makes a pair of a lower rank; rank order would not be greedy order")
            made[c] = rank
        self.size = size
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        keys = table[:, 0] * size + table[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.pairs = keys[order], order, table
        self.known: dict[str, bytes] = {}
        self.uneven: set[str] = set()

    @staticmethod
    def _even(piece: str) -> bool:
        """Whether a plain split at single blanks can have cut this piece rightly."""
        return bool(piece) and not piece[-1].isspace() and not piece[1:2].isspace()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for a pair that never merges."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        return np.where(self.keys[at] == code, self.ranks[at], -1)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each byte string, by the pair occurrence index over all of them."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1)
        n = int(ends[-1])
        sym = np.full(n, -1, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        sym[inside] = self.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Add the pairs that begin at these positions to the lists of their ranks."""
            left, right = sym[at], sym[after[at]]
            whole = (left >= 0) & (right >= 0)
            at = at[whole]
            if not len(at):
                return
            rank = self._rank(left[whole], right[whole])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist(), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        enter(np.arange(n - 1))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, c = self.pairs[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if not len(at):
                continue
            if len(lists) > 1:
                at = np.unique(at)
            if a == b and len(at) > 1:
                # Runs such as aaaa overlap: from the left, every second pair of a run stays.
                fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            sym[at], sym[gone] = c, -2
            after[at] = after[gone]
            before[after[at]] = at
            earlier = before[at]
            enter(np.unique(np.concatenate((earlier[earlier >= 0], at))))
        left = sym[sym != -2].astype("<i4")
        stops = np.flatnonzero(left == -1) * 4
        flat = left.tobytes()
        starts = np.concatenate(([0], stops[:-1] + 4))
        return [flat[lo:hi] for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Fill the bounded store with the packed ids of pieces, each of which tokenises on its own."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            # What this batch uses stays; the rest of the store goes.
            self.known = {p: self.known[p] for p in pieces if p in self.known}
            self.uneven.intersection_update(self.known)
        if not new:
            return
        order = list(new)
        parts = [self.pattern.findall(p) for p in order]
        words = list({w for ws in parts for w in ws})
        ids = dict(zip(words, self.merge_all([w.encode() for w in words]), strict=True))
        self.known.update((p, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for p, ws in zip(order, parts, strict=True))

    def cut(self, text: str) -> list[str]:
        """Pieces cut before each space that follows a non-blank: no token spans such a place."""
        return self.apart.split(text) if text else []

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them without added tokens."""
        cut: list[list[str]] = []
        odd = [False] * len(texts)
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                odd[i] = True
                cut.append([])
                continue
            # Most texts have single spaces between words; there a plain split gives the pieces.
            parts = text.split(" ")
            head, *rest = parts
            cut.append([head, *[" " + p for p in rest]] if text else [])
        seen: set[str] = set()
        for ps in cut:
            seen.update(ps)
        uneven = {p for p in seen.difference(self.known) if not self._even(p)} | (seen & self.uneven)
        apart: set[str] = set()
        for i, ps in enumerate(cut):
            if odd[i]:
                for part in self.split_special.split(texts[i]):
                    apart.update([] if part in self.special else self.cut(part))
            elif uneven and not uneven.isdisjoint(ps):
                cut[i] = self.cut(texts[i])
                apart.update(cut[i])
        seen = seen.difference(uneven) | apart
        self.uneven.update(p for p in apart if not self._even(p))
        self.learn(seen)
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, ps)), dtype="<i4") for ps in cut]
        for i, text in enumerate(texts):
            if odd[i]:
                packed = [np.int32(self.special[part]).tobytes() if part in self.special else b"".join(map(known, self.cut(part))) for part in self.split_special.split(text)]
                out[i] = np.frombuffer(b"".join(packed), dtype="<i4")
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; broken UTF-8 is replaced."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder per worker and file; the file must be at this path on every executor."""
    return ByteBpe(path)


#: Characters that are encoded together; bounds the arrays of one step.
STEP = 4_000_000


def round_trips(docs: DataFrame, path: str, id_type: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them.

    Rows (doc_id, ids, decoded). Null text counts as empty: no ids, empty text.
    """
    from pricetrail.llm.common import in_chunks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for lo, hi in in_chunks(texts, STEP):
                ids = coder.encode_batch(texts[lo:hi])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo:hi].array, "ids": ids, "decoded": [coder.decode(x.tolist()) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_type: str) -> DataFrame:
    """Per row: n_tokens and the SHA-256 of the ids' text and of the decoded text, made in the same pass.

    A null text is empty: no ids, and the digests of nothing. Rows are encoded one
    by one, also where doc_id is null or repeats; an empty table gives no rows.
    """
    from pricetrail.llm.common import in_chunks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(path)
        number = [str(i) for i in range(coder.size)]
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for lo, hi in in_chunks(texts, STEP):
                rows = []
                for packed in coder.encode_batch(texts[lo:hi]):
                    ids = packed.tolist()
                    joined = ",".join(map(number.__getitem__, ids)).encode()
                    decoded = coder.decode(ids).encode("utf-8", "surrogatepass")
                    rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", pdf["doc_id"].iloc[lo:hi].array)
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
