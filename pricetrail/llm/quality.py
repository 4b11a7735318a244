"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A
text resembles the side whose dictionary shrinks it more: the normalised
difference of the two compressed sizes is turned into a probability by a
logistic calibration on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bounds of the labelled sample: rows per class, characters of a row, size of a dictionary.
PER_CLASS = 3000
MAX_CHARS = 20_000
DICT_BYTES = 112_640
#: A dictionary works at the head of what it compresses, so texts are compressed in blocks, all of them.
BLOCK = 2048


@dataclass
class CompressionModel:
    """Dictionaries and calibration; `weights` is None without both labels."""

    good: bytes
    bad: bytes
    weights: np.ndarray | None
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1; texts that are null or empty get the prior."""
        out = np.full(len(texts), self.prior)
        if self.weights is None:
            return out
        for i, text in enumerate(texts):
            if text:
                z = float(features(text, self.good, self.bad) @ self.weights)
                out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=3)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=data)


def features(text: str, good: bytes, bad: bytes) -> np.ndarray:
    """Normalised difference of the compressed sizes, with what calibrates it: compressibility and length."""
    raw = text.encode("utf-8", "surrogatepass")
    sizes = np.zeros(3)
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        for k, d in enumerate((good, bad, b"")):
            sizes[k] += len(_compressor(d).compress(block))
    d = (sizes[1] - sizes[0]) / (sizes[1] + sizes[0])
    r = sizes[0] / len(raw)
    p = sizes[2] / len(raw)
    n = np.log1p(len(raw)) / 10
    return np.array([1, d * 10, d * n * 10, d * d * 100, r, r * r, p, p * p, n, n * n])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """At most PER_CLASS texts per class, chosen by the hash of their ids.

    Ids whose label rows disagree, and rows without a label, teach nothing. The
    ids are chosen from the labels alone, so that only the chosen texts move.
    """
    clear = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    clear = clear.where("quality = most").select("doc_id", "quality")
    pick = [clear.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for q in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))
    texts = docs.where((F.length("text") > 0) & (F.length("text") <= MAX_CHARS)).select("doc_id", "text")
    return texts.join(chosen, "doc_id").toPandas().sort_values(["doc_id", "text"], ignore_index=True)


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    blocks = [t.encode("utf-8", "surrogatepass")[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    blocks = [b for b in blocks if len(b) >= 8]
    if len(blocks) < 16:
        return b"".join(blocks)[:DICT_BYTES]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained one: its text itself serves
        return b"".join(blocks)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """Learn from rows (doc_id, text) and labels (doc_id, quality 0/1).

    Half of each class builds its dictionary, the other half calibrates. The
    weight of a class in the calibration is its share among all labels. Without
    texts of both classes every score is the prior, 0.5 where nothing is known.
    """
    counts = {r["quality"]: r["n"] for r in labels.where("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    rows = labelled_sample(docs, labels)
    sides = [rows.loc[rows["quality"] == q, "text"].drop_duplicates().tolist() for q in (0, 1)]
    if min(map(len, sides)) < 4:
        return CompressionModel(b"", b"", None, prior)
    bad, good = (_dictionary(s[::2]) for s in sides)
    x = np.array([features(t, good, bad) for s in sides for t in s[1::2]])
    y = np.repeat([0.0, 1.0], [len(s[1::2]) for s in sides])
    weights = _logistic(x, y)
    # The sample is balanced; the odds are moved back to those of the labels.
    drawn = y.mean()
    weights[0] += np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return CompressionModel(good, bad, weights, prior)


def score(docs: DataFrame, model: CompressionModel, id_columns: list[str]) -> DataFrame:
    """id_columns and score for every row, over whole texts.

    Null and empty texts have the model's score of nothing, between 0 and 1 as all
    are. Rows are scored one by one, equal ones alike, whatever their ids; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score([t if isinstance(t, str) else None for t in texts]))

    return docs.select(*id_columns, F.pandas_udf(run, "double")("text").alias("score"))
