"""Language identification with bit-sliced Bloom filters of character n-grams.

Each row of the filter holds one bit per language, so the AND of an n-gram's
probes is the set of all languages that contain it. A text's hits per language
are popcounts over its n-grams, corrected for the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import in_chunks

SIZES = (2, 3, 4)
PIECE = 1_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code of each code point that is a letter, 0 for every other."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _letters()[points]


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k]
    return x ^ (x >> np.uint64(29))


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams: n letters, or letters with a word edge at either end."""
    n = len(codes)
    wide = codes.astype(np.uint64)
    out = []
    letter = codes != 0
    for size in SIZES:
        if n < size:
            break
        m = n - size + 1
        h = np.full(m, np.uint64(size))
        for j in range(size):
            h = (h * _MIX[1] + wide[j : j + m]) ^ (h >> np.uint64(33))
        good = np.ones(m, dtype=bool)
        for j in range(1, size - 1):
            good &= letter[j : j + m]
        good &= (letter[:m] | letter[size - 1 :]) if size == 2 else True
        out.append(h[good])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Windows of PIECE starts, so that each n-gram of a long text comes once or, over a seam, at most once more."""
    for at in range(0, max(1, len(codes)), PIECE):
        yield codes[at : at + PIECE + max(SIZES) - 1]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole text of every row with a text and a lang."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, group in pdf.groupby("lang", sort=True):
                texts = group["text"].tolist()
                for lo, hi in in_chunks(texts, PIECE):
                    joined = _codes("\n" + "\n".join(texts[lo:hi]) + "\n")
                    for part in pieces(joined):
                        keys, n = np.unique(grams(part), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n.astype(np.int64)})

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class BloomLanguages:
    """The learned filter: one row per slot, one bit per language."""

    langs: list[str]
    rows: np.ndarray
    false_rate: np.ndarray
    probes: int

    def members(self, hashes: np.ndarray) -> np.ndarray:
        """Bit set of the languages whose filter holds each n-gram: (n, words) uint64."""
        found = None
        for k in range(self.probes):
            hit = self.rows[_mix(hashes, k) & np.uint64(len(self.rows) - 1)]
            found = hit if found is None else found & hit
        return found

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, score); ('und', 0) without a letter or without any language learned."""
        if text is None or not self.langs:
            return "und", 0.0
        codes = _codes("\n" + text + "\n")
        if not codes.any():
            return "und", 0.0
        hits, total = np.zeros(len(self.langs)), 0
        for part in pieces(codes):
            sets = self.members(grams(part))
            total += len(sets)
            for i in range(len(self.langs)):
                hits[i] += np.count_nonzero(sets[:, i // 64] & np.uint64(1 << (i % 64)))
        # Of the n-grams a language lacks, its false rate answers yes all the same.
        true = np.clip((hits - self.false_rate * total) / (1 - self.false_rate), 0, None)
        best = int(np.argmax(true))
        return self.langs[best], float(min(1.0, true[best] / total))


def fit(docs: DataFrame, min_share: float = 2e-5, bits: int = 19, probes: int = 3) -> BloomLanguages:
    """Learn filters from rows (text, lang).

    A language's filter holds the n-grams that are at least `min_share` of all
    its n-grams: a mark of the language rather than a stray word, and at most
    1 / min_share of them per language, which bounds what reaches the driver.
    Rows without text or lang teach nothing; an empty table gives a model that
    answers 'und'. Ties go to the language first by code point.
    """
    counts = gram_counts(docs).where("n > 0")
    counts = counts.withColumn("share_of", F.col("n"))
    from pricetrail.llm.common import discard, write_out

    held = write_out(counts.select("lang", "gram", "n"), "langid-grams")
    totals = held.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = held.join(F.broadcast(totals), "lang").where(F.col("n") >= min_share * F.col("total")).select("lang", "gram")
    table = kept.toPandas()
    discard(held)
    langs = sorted(table["lang"].unique())
    words = max(1, -(-len(langs) // 64))
    rows = np.zeros((1 << bits, words), dtype=np.uint64)
    for i, lang in enumerate(langs):
        hashes = table.loc[table["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for k in range(probes):
            slots = np.unique(_mix(hashes, k) & np.uint64(len(rows) - 1))
            rows[slots, i // 64] |= np.uint64(1 << (i % 64))
    fill = np.array([np.count_nonzero(rows[:, i // 64] & np.uint64(1 << (i % 64))) / len(rows) for i in range(len(langs))])
    return BloomLanguages(langs, rows, fill**probes, probes)


def predict(docs: DataFrame, model: BloomLanguages, id_columns: list[str]) -> DataFrame:
    """id_columns with lang_pred and score for every row, over whole texts.

    A text that is null or has no letter is `und` with score 0, and so is every
    text where nothing was learned. Rows are judged one by one, equal ones alike,
    whatever their ids; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(text: pd.Series) -> pd.DataFrame:
        got = [shared.value.judge(t) for t in text]
        return pd.DataFrame(got, columns=["lang_pred", "score"])

    verdict = F.pandas_udf(judge, "lang_pred string, score double")
    named = docs.select(*id_columns, verdict("text").alias("_v"))
    return named.select(*id_columns, F.col("_v.lang_pred").alias("lang_pred"), F.col("_v.score").alias("score"))


def keep_identified(docs: DataFrame, model: BloomLanguages, least: float) -> DataFrame:
    """Rows whose language is identified with at least that score; all columns stay, repeated rows too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sure(text: pd.Series) -> pd.Series:
        return pd.Series([lang != "und" and score >= least for lang, score in (shared.value.judge(t) for t in text)], dtype=bool)

    return docs.where(F.pandas_udf(sure, "boolean")(docs["text"]))
