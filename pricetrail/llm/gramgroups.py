"""Spelling variants by blocked Gram matrices of letter counts.

One inserted or deleted letter moves a word's letter counts by a squared distance
of 1, one replaced letter by 2. The alphabet is cut into an even number of groups
of letters of about equal weight. Words of equal length that differ by a replaced
letter agree on all but two groups, words of adjacent lengths on all but one; so
words meet in blocks that are named by their length, or pair of lengths, and their
counts in the groups but two. Inside a block the squared distances of all words
come from one NumPy product, |x|^2 + |y|^2 - 2 x.y; pairs at most two apart are
verified letter by letter.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import write_out

LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
TILE = 128
#: Pairs within a squared distance of two that are held before they are verified.
PAIRS = 500_000
#: A block with more words is dealt out as pairs of pieces of half as many.
SPLIT = 8192
#: Words up to which the alphabet is cut into four groups; sixteen times as many take two more.
FOUR_GROUPS = 4_000_000
#: Longer words are verified one by one, not as rows of a matrix.
MATRIX_LENGTH = 64


def damaged_counts(doc: str | None, text: bytes | None, least: int = LEAST_LENGTH) -> Counter:
    """How often a document gives each word: maximal letter runs, A-Z lower-cased, some with one letter deleted."""
    out: Counter = Counter()
    if text is None:
        return out
    start = zlib.crc32(f"{doc or ''}:".encode())
    for run, n in Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= least:
            out[run] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words, counted per batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: Counter = Counter()
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                held.update(damaged_counts(doc, text))
            yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": np.fromiter(held.values(), dtype=np.int64, count=len(held))})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """The group of each letter (latin-1 code), the groups of about equal weight over all words; others take group 0."""
    letter = F.explode(F.split("word", "")).alias("letter")
    counts = {r["letter"]: r["n"] for r in words.select(letter).groupBy("letter").agg(F.count("*").alias("n")).collect() if r["letter"]}
    out, load = np.zeros(256, dtype=np.int64), [0] * groups
    for x, n in sorted(counts.items(), key=lambda p: (-p[1], p[0])):
        out[ord(x)] = least = load.index(min(load))
        load[least] += n
    return out


def letter_counts(words: list[str]) -> np.ndarray:
    """(words, 256) counts of latin-1 codes."""
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * 256 + codes, minlength=len(words) * 256).reshape(len(words), 256)


class Blocks:
    """The names of the blocks a word is in, and which of them compares a pair."""

    def __init__(self, group: np.ndarray, groups: int) -> None:
        self.onehot = (group[:, None] == np.arange(groups)).astype(np.uint64)
        self.left_out = list(itertools.combinations(range(groups), 2))
        #: For adjacent lengths each group is left out once.
        self.across = [k for k, (a, b) in enumerate(self.left_out) if a % 2 == 0 and b == a + 1]
        self.letter = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64)
        keeps = np.array([[g not in pair for pair in self.left_out] for g in group], dtype=np.uint64)
        self.value = self.letter[:, None] * keeps
        #: By the bits of the groups in which a pair differs: the first block of equal lengths that has it.
        self.first = np.full(1 << groups, -1)
        for bits in range(1 << groups):
            for k, pair in reversed(list(enumerate(self.left_out))):
                if not bits & ~sum(1 << g for g in pair):
                    self.first[bits] = k

    def names(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, block): the low byte of a block tells the groups left out, and 128 that it pairs two lengths."""
        sums = letter_counts(words).astype(np.uint64) @ self.value
        length = np.array([len(w) for w in words], dtype=np.uint64)[:, None]

        def mixed(base: np.ndarray, code: np.ndarray) -> np.ndarray:
            x = (base + length * np.uint64(0x9E3779B97F4A7C15) + code) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            return x << np.uint64(8) | code

        code = np.arange(len(self.left_out), dtype=np.uint64)[None, :]
        same = mixed(sums, code)
        over = code[:, self.across] + np.uint64(128)
        longer = mixed(sums[:, self.across], over)
        length = length - np.uint64(1)
        shorter = mixed(sums[:, self.across], over)
        out = np.concatenate([same, longer, shorter], axis=1)
        return np.repeat(np.arange(len(words)), out.shape[1]), out.ravel().view(np.int64)

    def prints(self, counts: np.ndarray) -> np.ndarray:
        """(words, groups): a print of a word's counts in each group."""
        return counts.astype(np.uint64) @ (self.letter[:, None] * self.onehot)

    def compared_here(self, bits: np.ndarray, code: np.ndarray, across: np.ndarray) -> np.ndarray:
        """Whether a pair that differs in the groups of `bits` is for a block of this code to report."""
        outside = np.array([~sum(1 << g for g in pair) for pair in self.left_out])
        return np.where(across, (code >= 128) & (bits & outside[code % 128] == 0), code == self.first[bits])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a != b and a[at + (len(a) == len(b)):] == b[at + 1:]


def letter_rows(words: list[str], size: np.ndarray) -> np.ndarray:
    """(words, MATRIX_LENGTH + 2) latin-1 codes of the words, 0 behind their ends."""
    cut = [w[:MATRIX_LENGTH] for w in words]
    size = np.minimum(size, MATRIX_LENGTH)
    out = np.zeros((len(words), MATRIX_LENGTH + 2), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer("".join(cut).encode("latin-1"), dtype=np.uint8)
    return out


def verified(words: list[str], size: np.ndarray, letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """one_edit for each pair of word numbers."""
    out = np.zeros(len(i), dtype=bool)
    long = np.maximum(size[i], size[j]) > MATRIX_LENGTH
    out[long] = [one_edit(words[a], words[b]) for a, b in zip(i[long], j[long], strict=True)]
    at = np.flatnonzero(~long)
    swap = size[i[at]] > size[j[at]]
    a, b = np.where(swap, j[at], i[at]), np.where(swap, i[at], j[at])
    same = size[a] == size[b]
    out[at[same]] = (letters[a[same]] != letters[b[same]]).sum(axis=1) == 1
    x, y = letters[a[~same], :-1], letters[b[~same]]
    # The shorter word is a prefix of the longer, and from there on the longer moved by one.
    head = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    out[at[~same]] = (head + tail >= x.shape[1]) & (size[b] - size[a] == 1)[~same]
    return out


def close_rows(counts: np.ndarray, starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows at a squared distance of two at most, tile by tile.

    Every pair of one block is looked at; `starts` are the blocks' first rows.
    Blocks below TILE rows share a tile, larger ones are cut into pairs of tiles.
    """
    x = counts.astype(np.float32 if len(counts) and counts.sum(axis=1).max() < 2048 else np.float64)
    norm, one = (x * x).sum(axis=1, keepdims=True), np.ones((n, 1), dtype=x.dtype)
    # One product gives |x|^2 + |y|^2 - 2 x.y.
    left, right = np.hstack([x, norm, one]), np.hstack([-2 * x, one, norm]).T
    ends = np.append(starts[1:], n)
    lo = 0
    while lo < n:
        hi = ends[max(np.searchsorted(ends, lo + TILE, side="right") - 1, np.searchsorted(ends, lo, side="right"))]
        for a in range(lo, hi, TILE):
            for b in range(a, hi, TILE):
                i, j = np.divmod(np.flatnonzero(left[a:min(a + TILE, hi)] @ right[:, b:min(b + TILE, hi)] <= 2), min(b + TILE, hi) - b)
                good = i + a < j + b
                yield i[good] + a, j[good] + b
        lo = hi


def near_in(rows: pd.DataFrame, starts: np.ndarray, blocks: Blocks) -> pd.DataFrame:
    """Near pairs, both ways, among the rows of whole blocks: (word, other, other_n)."""
    words, n = rows["word"].tolist(), rows["n"].to_numpy()
    block, part = rows["block"].to_numpy(), rows["part"].to_numpy()
    counts = letter_counts(words)
    size, prints, letters = counts.sum(axis=1), blocks.prints(counts), letter_rows(words, counts.sum(axis=1))
    number = np.zeros(len(rows), dtype=np.int64)
    number[starts[1:]] = 1
    number = np.cumsum(number)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        bits = ((prints[i] != prints[j]) << np.arange(prints.shape[1])).sum(axis=1)
        good = blocks.compared_here(bits, block[i] & 255, size[i] != size[j])
        # Of a block in pieces, each pair of words is compared where their two pieces meet.
        piece = part & 0xFFFFF
        good &= part[i] >> 20 == (np.minimum(piece[i], piece[j]) << 20 | np.maximum(piece[i], piece[j]))
        i, j = i[good], j[good]
        good = verified(words, size, letters, i, j)
        found.append((i[good], j[good]))

    held = 0
    for i, j in close_rows(counts[:, counts.any(axis=0)], starts, len(rows)):
        good = (number[i] == number[j]) & (np.abs(size[i] - size[j]) <= 1)
        waiting.append((i[good], j[good]))
        held += len(waiting[-1][0])
        if held > PAIRS:
            settle()
            held = 0
    if waiting:
        settle()
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    name = np.array(words, dtype=object)
    return pd.DataFrame({"word": pd.Series(name[a], dtype=object), "other": pd.Series(name[b], dtype=object), "other_n": n[b]})


def near_pairs(words: DataFrame, groups: int, split: int = SPLIT) -> DataFrame:
    """(word, other, other_n): every ordered pair of near words of (word, n), once."""
    blocks = Blocks(letter_groups(words, groups), groups)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                words = pdf["word"].to_numpy(dtype=object)
                at, block = blocks.names(words.tolist())
                yield pd.DataFrame({"block": block, "word": pd.Series(words[at], dtype=object), "n": pdf["n"].to_numpy()[at]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in itertools.chain(batches, [None]):
            rows = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rows is None or not len(rows):
                continue
            block, group = rows["block"].to_numpy(), rows["part"].to_numpy() >> 20
            start = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (group[1:] != group[:-1])))
            ends = np.append(start[1:], len(rows))
            if pdf is not None:
                # The last block may go on in the next batch.
                held, ends = rows.iloc[start[-1]:], ends[:-1]
            if len(ends):
                yield near_in(rows.iloc[:ends[-1]], start[:len(ends)], blocks)

    rows = words.mapInPandas(named, "block long, word string, n long")
    hot = write_out(rows.groupBy("block").count().where(F.col("count") > split).select(F.col("block").alias("hot"), F.expr(f"CAST(ceil(count / {split // 2}) AS BIGINT)").alias("pieces")), "gram-hot")
    own = F.expr("pmod(xxhash64(word), pieces)")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    dealt = rows.join(hot, F.col("block") == F.col("hot"), "left").where("hot IS NOT NULL").withColumn("own", own).withColumn("other", other)
    whole = F.least("own", "other") * (1 << 20) + F.greatest("own", "other")
    dealt = dealt.select("block", (whole * (1 << 20) + F.col("own")).alias("part"), "word", "n")
    rest = rows.join(hot, F.col("block") == F.col("hot"), "left_anti").select("block", F.lit(0).cast("long").alias("part"), "word", "n")
    met = rest.unionByName(dealt)
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "block", F.shiftright("part", 20)).sortWithinPartitions("block", "part")
    return met.mapInPandas(compare, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last word that the forms lead to. Forms never lead back."""
    now = write_out(forms.select("word", F.col("form").alias("root")), "gram-roots")
    while True:
        # Each round doubles the steps taken; counts grow tenfold at a step, so there are few.
        up = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = now.join(up, F.col("root") == F.col("at"), "left")
        if step.where("next IS NOT NULL").isEmpty():
            return now
        now = write_out(step.select("word", F.coalesce("next", "root").alias("root")), "gram-roots")


def groups_for(n_words: int) -> int:
    """Letter groups: four, and two more for each further factor of sixteen, so that blocks stay small."""
    groups = 4
    while n_words > FOUR_GROUPS * 16 ** ((groups - 4) // 2):
        groups += 2
    return groups


def variants(docs: DataFrame, groups: int | None = None, split: int = SPLIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (doc_id, text).

    Words have at least 7 letters and 2 occurrences; near words differ by one
    inserted, deleted or replaced letter. A word's form is its most frequent near
    word, ties to the first in code-point order, if that is at least ten times as
    frequent. Null and empty texts have no words; a null doc_id counts as an empty
    string in the checksum; repeated rows count each; other columns are not read;
    an empty table gives no rows. The result does not depend on `groups` (an even
    number) nor on `split`, the block size from which pieces are compared.
    """
    words = write_out(word_counts(docs).where(F.col("n") >= LEAST_COUNT), "gram-words")
    pairs = near_pairs(words, groups or groups_for(words.count()), split)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select(F.col("word").alias("of"), "n_near", F.col("best.form").alias("likely"), (-F.col("best.minus")).alias("likely_n"))
    rows = words.join(near, F.col("word") == F.col("of"), "left")
    formed = F.col("likely_n") >= FORM_TIMES * F.col("n")
    rows = write_out(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("likely")).alias("form"), F.when(formed, F.col("likely_n")).alias("form_n")), "gram-forms")
    last = roots(rows.where("form IS NOT NULL")).select(F.col("word").alias("of"), "root")
    out = rows.join(last, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
