"""Ranked search, repeated substrings and spelling variants: messy rows, empty tables, brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pricetrail.llm import blockrank, bucketrefine, gramgroups
from tests.llm.test_operators import LINE, SCHEMA, messy_rows

CLASH = "item long, term string, c long, w long, n long, turn int, row long, key string, spans string, kept string, first long, names string, to string, block long, part long, hot long, root string, form string, own long"


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


def ranked(docs, items, top=20):
    """(item_id, rank, doc_id, score) by brute force; docs and items are (id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, collections.Counter(split(t))) for i, t in docs]
    held = [(i, tf, sum(tf.values())) for i, tf in held if tf]
    total, size = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scored = []
        for i, tf, n in held:
            m = 75 + 25 * n * total // size
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in split(text) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:top])]
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_rank_messy_and_empty(spark, messy):
    items = [(0, LINE), (0, LINE), (1, None), (2, ""), (3, "!?"), (4, "nowhere"), (None, "BAUM Haus haus"), (5, "été w1 and")]
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, item long, doc_id string")
    want = ranked([r[:2] for r in messy_rows()], items)
    assert plain(blockrank.search(spark, messy, benchmark).collect()) == plain(want)
    assert plain(blockrank.search(spark, messy, benchmark, per_pass=3).collect()) == plain(want)
    assert blockrank.search(spark, messy.limit(0), benchmark).count() == 0
    assert blockrank.search(spark, messy, benchmark.limit(0)).count() == 0


def test_rank_ties_and_large_ids(spark):
    rng = random.Random(3)
    docs = [(2**60 + 7 * i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 3, 3, 9))))) for i in range(400)]
    items = [(i, " ".join(rng.choice("abcdefghz") for _ in range(5))) for i in range(30)]
    got = blockrank.search(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert plain(got.collect()) == plain(ranked(docs, items))


def test_tiles_stay_exact():
    # A repeated term whose sum passes 2**53 is spread over tiles; a wide item is cut.
    items = np.array([0] * 5 + [1] * 3000)
    terms = np.array([f"t{i}" for i in range(5)] + [f"t{i}" for i in range(3000)], dtype=object)
    counts = np.array([1_000_000, 450_000, 1, 7, 900_001] + [2] * 3000)
    weights = np.array([20_000, 19_999, 3, 1, 12_345] + [1 + i for i in range(3000)])
    tiles = blockrank.Tiles(items, terms, counts, weights, 1, 1024)
    assert all(q.sum(axis=1).max() * blockrank.IMPACT < blockrank.EXACT for block in tiles.blocks for _, q in block)
    rng = np.random.default_rng(1)
    place = np.arange(len(tiles.place))
    impact = rng.integers(1, blockrank.IMPACT, len(place))
    name = {v: k for k, v in tiles.place.items()}
    for k in (0, 1):
        got = tiles.scores(k, np.zeros(len(place), dtype=int), place, impact, 1)[0, 0]
        worth = {name[i]: int(x) for i, x in enumerate(impact)}
        assert got == sum(int(c) * int(w) * worth[t] for i, t, c, w in zip(items, terms, counts, weights, strict=True) if i == k)


def cut(docs, length):
    """(doc_id, spans, kept) by brute force; docs are (id, text)."""
    least = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for p in range(len(b) - length + 1):
            if i is not None:
                least[b[p:p + length]] = min(i, least.get(b[p:p + length], i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and least[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, spans, bytes(c for c, x in zip(b, gone, strict=True) if not x)))
    return out


def cut_rows(df):
    return sorted(((r["doc"]["doc_id"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=str)


def repeating(seed, n, alphabet):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(8)]
    text = lambda: " ".join(rng.choice(passages) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 4)] + [(n * 2, "ab" * 400), (n * 2 + 1, "ba" * 300), (n * 2 + 2, "x" * 49), (n * 2 + 3, "x" * 49), (n * 2 + 4, "é" * 25), (n * 2 + 5, "é" * 25)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("length", "gram", "hot"), [(50, 20, 100_000), (50, 20, 2), (12, 5, 4)])
def test_repeats_equal_brute_force(spark, length, gram, hot):
    docs = repeating(length + hot, 60, "abcé")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert cut_rows(bucketrefine.without_repeats(df, length, gram, hot)) == sorted(cut(docs, length), key=str)


def test_repeats_messy_and_empty(spark, messy):
    want = sorted(cut([r[:2] for r in messy_rows()], 50), key=str)
    assert cut_rows(bucketrefine.without_repeats(messy)) == want
    clash = messy.select("doc_id", "text").selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS `{c.split()[0]}`" for c in CLASH.split(", ")], "1 AS `_doc`", "'d' AS doc")
    assert cut_rows(bucketrefine.without_repeats(clash)) == want
    assert bucketrefine.without_repeats(messy.limit(0)).count() == 0


def test_suffix_buckets_and_pieces(monkeypatch):
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(40)] + [b"a" * 70]
    for length in (3, 8, 13, 50):
        joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts])
        place, bucket = bucketrefine.suffix_buckets(joined, sizes, length)
        at = {p: b for p, b in zip(place.tolist(), bucket.tolist(), strict=True)}
        seen, base, windows = collections.defaultdict(list), 0, collections.defaultdict(list)
        for t in texts:
            for p in range(len(t) - length + 1):
                windows[t[p:p + length]].append(base + p)
            base += len(t)
        for p, b in at.items():
            seen[b].append(p)
        # Windows that are alone may have left before; all others have one bucket per string.
        assert sorted(sorted(v) for v in seen.values() if len(v) > 1) == sorted(v for v in windows.values() if len(v) > 1)
    long = bytes(rng.choice(b"abcdefgh") for _ in range(5000))
    whole = bucketrefine.runs_of(long, np.array([5000]), 50, 20)
    monkeypatch.setattr(bucketrefine, "PIECE", 300)
    covered = []
    for _, parts, joined in bucketrefine.pieces_of([long], 50):
        base = np.cumsum(parts[:, 1]) - parts[:, 1]
        h, piece, first, n = bucketrefine.runs_of(joined, parts[:, 1], 50, 20)
        covered += [(int(x), int(p - base[k] + parts[k, 0]) + d) for x, k, p, m in zip(h, piece, first, n, strict=True) for d in range(m)]
    assert sorted(covered, key=lambda c: c[1]) == [(int(x), int(p) + d) for x, p, m in zip(whole[0], whole[2], whole[3], strict=True) for d in range(m)]


def near_words(docs, least=7):
    """(word, form, root, n, n_near, form_n) by brute force; docs are (id, text)."""
    count = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= 2}
    near = {w: [o for o in words if gramgroups.one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_one_edit_and_verified():
    def slow(a, b):
        edits = {a[:k] + a[k + 1:] for k in range(len(a))} | {a[:k] + c + a[k + 1:] for k in range(len(a)) for c in b} | {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in b}
        return b in edits and a != b

    rng = random.Random(2)
    words = ["".join(rng.choice("aéÿ") for _ in range(rng.randint(5, 8))) for _ in range(150)]
    words += ["b" * 64, "b" * 65, "b" * 66, "b" * 30 + "c" + "b" * 35, "b" * 300, "b" * 299 + "c", "b" * 301]
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words))]
    want = [slow(words[i], words[j]) for i, j in pairs]
    assert [gramgroups.one_edit(words[i], words[j]) for i, j in pairs] == want
    size = np.array([len(w) for w in words])
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    assert gramgroups.verified(words, size, gramgroups.letter_rows(words, size), i, j).tolist() == want


@pytest.mark.parametrize(("groups", "split"), [(None, 8192), (4, 6), (6, 8192)])
def test_variants_equal_brute_force(spark, groups, split):
    rng = random.Random(21)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 10))) for _ in range(25)]
    docs = []
    for i in range(120):
        text = []
        for _ in range(80):
            w = stems[min(int(rng.expovariate(0.25)), 24)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abÉ"), w[k] + "a"]) + w[k + 1:]
            text.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = gramgroups.variants(df, groups, split)
    assert plain(got.collect()) == plain(near_words(docs))


def test_variants_messy_and_empty(spark, messy):
    run = "q" * 5000
    more = [(None, "variant", *[None] * 10), (None, "variant", *[None] * 10), (90, f"{run} {run}a {run} {run}a", *[None] * 10)]
    docs = spark.createDataFrame([*messy_rows(), *more], SCHEMA)
    assert plain(gramgroups.variants(docs).collect()) == plain(near_words([r[:2] for r in [*messy_rows(), *more]]))
    assert gramgroups.variants(messy.limit(0)).count() == 0


def test_registered(spark, root):
    from pricetrail.llm.queries import QUERIES

    rows = QUERIES["op12_bucket_refine"](spark, root).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, s, k in cut(docs, 50)}
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
