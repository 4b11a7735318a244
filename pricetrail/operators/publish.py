"""Closed public projections and the checks that guard them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.functions.money import half_up, permille
from pricetrail.functions.nested import json_leaves, typed_leaves
from pricetrail.functions.periods import month_label
from pricetrail.functions.reasons import duplicated, failed, reason_codes, stacked, violations


def milli(x: Column) -> Column:
    return half_up(x * 1000)


def project_index(index: DataFrame) -> DataFrame:
    """Index rows as integers in thousandths, named columns only."""
    return index.select(
        "period_id",
        "state",
        milli(F.col("index_value")).alias("index_milli"),
        milli(F.col("link")).alias("link_permille"),
        half_up((F.col("link") - 1) * 1000).alias("change_permille"),
        "matched_product_count",
        "distinct_products_in_period",
        F.col("reference_period").alias("is_reference"),
    )


def project_index_summary(index: DataFrame) -> DataFrame:
    """Latest level against the reference, with a direction word."""
    seen = index.where("state = 'observed'")
    row = seen.agg(
        F.max(F.struct("period_id", "index_value")).alias("latest"),
        F.max(F.when(F.col("reference_period"), F.col("index_value"))).alias("reference"),
    )
    last = F.col("latest.index_value")
    return row.select(
        F.col("latest.period_id").alias("latest_period"),
        milli(last).alias("latest_index_milli"),
        half_up((last / F.col("reference") - 1) * 1000).alias("change_from_reference_permille"),
        F.when(last.isNull() | F.col("reference").isNull(), F.lit("unknown")).when(last > F.col("reference"), F.lit("higher"))
        .when(last < F.col("reference"), F.lit("lower")).otherwise(F.lit("level")).alias("direction"),
    )


def project_product_points(points: DataFrame) -> DataFrame:
    """Each product relative to its own first observed month; no level leaves.

    A product has at most one row per calendar month, so its window is small.
    """
    first = F.first("median_minor").over(Window.partitionBy("mpn").orderBy("month"))
    return points.where("state = 'observed'").withColumn("base", first).select(
        "mpn", month_label(F.col("month")).alias("month"), permille(F.col("median_minor"), F.col("base")).alias("relative_permille"),
        "seller_count", "single_seller",
    )


def project_products(product_points: DataFrame, summary: DataFrame) -> DataFrame:
    """One closed row per product above the floors of `summary`."""
    last = product_points.groupBy("mpn").agg(F.max(F.struct("month", "relative_permille")).alias("last"))
    return summary.join(last, "mpn").select(
        "mpn", "month_count", "seller_count", "multi_seller_month_count", "first_month", "last_month",
        (F.col("last.relative_permille") - 1000).alias("change_permille"),
    )


def excluded_below_floor(every: DataFrame, kept: DataFrame) -> DataFrame:
    """How many products the floors hold back."""
    return every.select("mpn").join(kept.select("mpn"), "mpn", "left_anti").agg(F.count(F.lit(1)).alias("excluded_below_floor_count"))


def project_events(explanations: DataFrame) -> DataFrame:
    """Markers with content ids and attribution; movement ids never leave."""
    return explanations.select(
        F.concat(F.lit("ev-"), F.substring(F.sha2("explanation_id", 256), 1, 12)).alias("marker_id"),
        "period_id", "causal_language_level",
        F.col("source_title").alias("title"), F.col("source_author").alias("author"),
        F.col("source_publisher").alias("publisher"), F.col("source_url").alias("url"), "published_on",
    )


def event_counts(explanations: DataFrame, movements: DataFrame) -> DataFrame:
    """Measured, explained and unexplained movements."""
    n = movements.agg(F.count(F.lit(1)).alias("movement_count"))
    explained = explanations.agg(F.count(F.lit(1))).scalar()
    return n.select(
        "movement_count", explained.alias("explained_movement_count"), (F.col("movement_count") - explained).alias("unexplained_movement_count"),
        F.when(F.col("movement_count") == explained, F.lit(None)).otherwise(F.lit("pending_review")).alias("pending_reason"),
    )


def explanation_totals(datasets: DataFrame) -> DataFrame:
    """Totals over per-dataset counts."""
    return datasets.agg(
        F.sum("movement_count").alias("measured"), F.sum("explained_movement_count").alias("markers"),
        F.sum("unexplained_movement_count").alias("unexplained"),
    )


def align_markers(markers: DataFrame, periods: DataFrame) -> DataFrame:
    """Each marker on its period; an unknown period stays unplaced."""
    p = periods.select("period_id", F.lit(True).alias("placed"))
    return markers.join(p, "period_id", "left").withColumn("placed", F.coalesce("placed", F.lit(False)))


def event_line_contract(markers: DataFrame, status: str, allowed: list[str]) -> DataFrame:
    """Marker rows complete and the line's status in step with their number."""
    def blank(name: str) -> Column:
        return failed(F.length(name) == 0)

    rows = violations(markers, F.col("event_id"), [
        ("source_url_not_https", failed(~F.col("source_url").startswith("https://"))),
        ("headline_missing", blank("headline")),
        ("publisher_missing", blank("publisher")),
        ("author_blank", F.coalesce(F.col("author") == "", F.lit(False))),
        ("interpretation_missing", blank("interpretation")),
        ("uncertainty_missing", blank("uncertainty")),
        ("counter_evidence_missing", failed(F.size("counter_evidence") <= 0)),
    ])
    count = markers.agg(F.count(F.lit(1)).alias("n"))
    state = violations(count, F.lit(status), [
        ("empty_line_has_markers", (F.lit(status) == "empty_pending_review") & (F.col("n") > 0)),
        ("published_line_is_empty", (F.lit(status) == "reviewed_markers_published") & (F.col("n") == 0)),
    ], F.col("n"))
    unknown = [c for c in markers.columns if c not in allowed]
    columns = violations(count, F.lit("columns"), [(f"unknown_field_{c}", F.lit(True)) for c in unknown]) if unknown else None
    return stacked(rows, state, *([columns] if columns is not None else []))


# Names that speak of money, and what a two-decimal figure looks like.
MONEY_NAME = r"(?i)minor|amount|price|gbp|cost|pence|sterling"
TWO_DECIMALS = r"[0-9]\.[0-9]{2}($|[^0-9])"


def _nested(kind: T.DataType, path: str) -> list[tuple[str, str, T.DataType]]:
    """(name, path, type) of every field inside a type; element steps add no name."""
    if isinstance(kind, T.ArrayType):
        return _nested(kind.elementType, path)
    if isinstance(kind, T.MapType):
        return _nested(kind.keyType, path) + _nested(kind.valueType, path)
    if isinstance(kind, T.StructType):
        return [t for f in kind.fields for t in [(f.name, f"{path}.{f.name}", f.dataType), *_nested(f.dataType, f"{path}.{f.name}")]]
    return []


def _holds(kind: T.DataType, leaf: tuple[type, ...]) -> bool:
    """Whether a type is, or holds at any depth, one of the leaf types."""
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, leaf)
    if isinstance(kind, T.MapType):
        return _holds(kind.keyType, leaf) or _holds(kind.valueType, leaf)
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, leaf) for f in kind.fields)
    return isinstance(kind, leaf)


def _leaves(value: Column, kind: T.DataType, leaf: tuple[type, ...]) -> Column:
    """All leaf values of the named types under a value, as an array of text."""
    none = F.array().cast("array<string>")
    if not _holds(kind, leaf):
        return none
    if isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda v: _leaves(v, kind.elementType, leaf)))
    elif isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        found = F.concat(_leaves(F.map_keys(value), keys, leaf), _leaves(F.map_values(value), values, leaf))
    elif isinstance(kind, T.StructType):
        found = F.concat(*[_leaves(value.getField(f.name), f.dataType, leaf) for f in kind.fields])
    else:
        found = F.array(value.cast("string"))
    return F.coalesce(found, none)


def assert_public_safe(df: DataFrame, allowed: list[str], private: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Columns against the allow-list and the money rule, values against leaks.

    `private` and `codes` hold tokens that no serialised row may contain.

    Structs, arrays and maps are walked to their leaves, map keys included; a
    nested field is named by its path, and its own name must be allowed too.
    Values fold to one count per rule and column in a single aggregate.
    """
    import re

    text_kinds, broken_kinds = (T.StringType,), (T.FloatType, T.DoubleType, T.DecimalType)
    structural = []
    for name, path, kind in _nested(df.schema, "$"):
        path = path.removeprefix("$.")
        if name not in allowed:
            structural.append(("not_in_public_schema", path))
        if re.search(MONEY_NAME, name):
            structural.append(("money_bearing_name", path))
        if not isinstance(kind, T.StructType) and _holds(kind, broken_kinds) and not _nested(kind, ""):
            structural.append(("non_integer_number", path))
    for path, kind in [("", df.schema), *[(p.removeprefix("$."), k) for _, p, k in _nested(df.schema, "$")]]:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType) and {"mpn_expected", "mpn_observed"} <= set(kind.names):
            structural.append(("identity_comparison", f"{path}.mpn_expected,mpn_observed".removeprefix(".")))

    checks: list[Column] = []
    names: list[tuple[str, str]] = []
    for field in df.schema.fields:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        plain = isinstance(kind, (*text_kinds, *broken_kinds))

        def met(leaf: tuple[type, ...], test, value=value, kind=kind, plain=plain) -> Column:
            return F.count_if(test(value.cast("string")) if plain else F.exists(_leaves(value, kind, leaf), test))

        if _holds(kind, text_kinds):
            checks.append(met(text_kinds, lambda t: F.contains(t, F.lit("£")) | t.rlike(r"\bGBP\b")))
            names.append(("currency_text", field.name))
        if _holds(kind, (*text_kinds, *broken_kinds)):
            checks.append(met((*text_kinds, *broken_kinds), lambda t: t.rlike(TWO_DECIMALS)))
            names.append(("two_decimal_text", field.name))
    found = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("key"), F.lit(1).cast("long").alias("n")) for r, k in structural]) if structural else None
    counted = [F.struct(F.lit(r).alias("rule"), F.lit(k).alias("key"), F.col(f"c{i}").alias("n")) for i, (r, k) in enumerate(names)]
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)]) if checks else df.agg(F.count(F.lit(1)).alias("c"))
    parts = [p for p in ([found] if found is not None else []) + ([F.array(*counted)] if counted else [])]
    if not parts:
        parts = [F.array().cast("array<struct<rule:string,key:string,n:bigint>>")]
    rules = row.select(F.explode(F.concat(*parts)).alias("v")).where("v.n > 0").select(
        "v.rule", "v.key", F.col("v.n").cast("string").alias("detail")
    )
    given = [(rule, tokens) for rule, tokens in (("private_token", private), ("reason_code", codes)) if tokens is not None]
    return stacked(rules, *[_serialised_leaks(df, rule, tokens) for rule, tokens in given]) if given else rules


def _serialised_leaks(df: DataFrame, rule: str, tokens: DataFrame) -> DataFrame:
    """Tokens found in rows as JSON, with the number of rows."""
    rows = df.select(F.lit(0).alias("text_id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("text"))
    found = leak_scan(rows, tokens).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.lit(rule).alias("rule"), F.col("token").alias("key"), F.col("n").cast("string").alias("detail"))


# Columns whose values must never be published.
PRIVATE_COLUMNS = [
    "tranche_id", "observation_id", "source_key", "source_url", "archive_url", "original_url", "extract_path",
    "extract_sha256", "response_sha256", "observed_at", "legal_name", "review_id", "approval_id",
]


# Keys that hold reason codes, and how a code looks.
REASON_KEYS = ["reason_codes", "reasons", "reason_code", "exclusion_reason", "abstention_reasons", "rejection_reasons", "code"]
REASON_SHAPE = "^[A-Z][A-Z0-9_]{5,}$"


def _rendered(minor: Column) -> list[Column]:
    """A price above a pound in the three ways it is written."""
    figure = F.format_string("%d.%02d", F.floor(minor / 100), minor % 100)
    return [F.when(minor > 100, F.concat(F.lit(p), figure)) for p in ("£", "", "GBP ")]


def private_tokens(rows: DataFrame, amount: str | None = None) -> DataFrame:
    """Values under private names at any depth, and prices in their three renderings.

    Plain columns give their values as text; columns of structs, arrays and maps
    are walked, where only text counts, as it does in free-form JSON.
    """
    named = [F.col(c).cast("string") for c in rows.columns if c in PRIVATE_COLUMNS]
    shown = _rendered(F.col(amount)) if amount is not None else []
    top = rows.select(F.explode(F.array_compact(F.array(*named, *shown))).alias("token")) if named or shown else None
    nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    deep = _private_leaves(typed_leaves(rows, nested)) if nested else None
    parts = [p for p in (top, deep) if p is not None]
    return stacked(*parts).distinct() if parts else rows.sparkSession.createDataFrame([], "token string")


def private_json_tokens(texts: DataFrame, json_column: str) -> DataFrame:
    """The same for documents of free-form JSON."""
    return _private_leaves(json_leaves(texts, json_column)).distinct()


def _private_leaves(leaves: DataFrame) -> DataFrame:
    kind = F.schema_of_variant("leaf")
    last, above = F.try_element_at("names", F.lit(-1)), F.try_element_at("names", F.lit(-2))
    minor = F.when((kind == "BIGINT") & (last == "amount_minor") & (above == "item_price"), F.try_variant_get("leaf", "$", "bigint"))
    text = F.when((kind == "STRING") & last.isin(*PRIVATE_COLUMNS), F.try_variant_get("leaf", "$", "string"))
    return leaves.select(F.explode(F.array_compact(F.array(text, *_rendered(minor)))).alias("token"))


def reason_tokens(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Code-shaped reasons in columns of text or arrays, and in nested columns under the keys that hold reasons."""
    types = dict(rows.dtypes)
    flat = [c for c in columns if types[c] in ("string", "array<string>")]
    nested = [c for c in columns if c not in flat]
    parts = []
    if flat:
        arrays = [F.col(c) if types[c].startswith("array") else F.array(c) for c in flat]
        parts.append(rows.select(F.explode(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in arrays])).alias("token")).where(F.col("token").rlike(REASON_SHAPE)))
    if nested:
        parts.append(_reason_leaves(typed_leaves(rows, nested)))
    return stacked(*parts).distinct()


def reason_json_tokens(texts: DataFrame, json_column: str) -> DataFrame:
    """The same for documents of free-form JSON, `{CODE: count}` maps included."""
    return _reason_leaves(json_leaves(texts, json_column)).distinct()


def _reason_leaves(leaves: DataFrame) -> DataFrame:
    last, above = F.try_element_at("names", F.lit(-1)), F.try_element_at("names", F.lit(-2))
    # A text under the key itself, or in an array under it; a null name is a place in an array.
    under = F.coalesce(last.isin(*REASON_KEYS), F.lit(False)) | (last.isNull() & F.coalesce(above.isin(*REASON_KEYS), F.lit(False)))
    own = F.when(under & (F.schema_of_variant("leaf") == "STRING"), F.try_variant_get("leaf", "$", "string"))
    # The names of a map under the key.
    pairs = F.arrays_zip(F.col("names").alias("key"), F.slice("names", 2, F.greatest(F.size("names"), F.lit(1))).alias("below"))
    maps = F.transform(F.filter(pairs, lambda p: p["key"].isin(*REASON_KEYS)), lambda p: p["below"])
    found = leaves.select(F.explode(F.array_compact(F.array_append(F.coalesce(maps, F.array().cast("array<string>")), own))).alias("token"))
    return found.where(F.col("token").rlike(REASON_SHAPE))


#: Bytes of the longest piece; pieces are powers of two long.
ANCHOR = 64
#: The two sieves of anchors: so many pieces of 32768 bits each, whatever the number of tokens.
SIEVE_PIECES = 128
SIEVE_SLOTS = SIEVE_PIECES * 32768
#: Bytes of short texts that are hashed together.
TOGETHER = 1 << 18


def _grams(data: bytes, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes): of each size, powers of two that ascend, the hash of every piece of it; two halves make a whole."""
    h, n, factor = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    for size in sizes:
        while n < size:
            h = h[:-n] * np.uint64(factor) + h[n:] if len(h) > n else h[:0]
            n, factor = 2 * n, factor * factor % (1 << 64)
        yield size, h


def _slots(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's slot in the first sieve and in the second, which lies behind it."""
    mixed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * size)
    # Upper bits of a product depend on all of the piece's.
    first, second = mixed >> np.uint64(42), mixed * np.uint64(0x94D049BB133111EB) >> np.uint64(42)
    return first.astype(np.int64) % SIEVE_SLOTS, second.astype(np.int64) % SIEVE_SLOTS + SIEVE_SLOTS


def _anchors(tokens: DataFrame) -> DataFrame:
    """(token, size, gram, first, second): of each token the longest piece, of those the one that fewest tokens hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for token in pdf["token"]:
                text = token.encode()
                size = min(1 << (len(text).bit_length() - 1), ANCHOR)
                grams = np.unique(next(_grams(text, [size]))[1])
                first, second = _slots(grams, size)
                yield pd.DataFrame({"token": pd.Series([token] * len(grams), dtype=object), "size": size, "gram": grams.view(np.int64), "first": first, "second": second})

    every = tokens.where("length(token) > 0").select("token").distinct().mapInPandas(run, "token string, size int, gram long, first long, second long")
    rarity = every.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("seen"))
    best = F.min(F.struct("seen", "gram", "first", "second")).alias("a")
    return every.join(rarity, ["size", "gram"]).groupBy("token", "size").agg(best).select("token", "size", "a.gram", "a.first", "a.second")


def _sieve(anchors: DataFrame) -> tuple[np.ndarray, list[int]]:
    """One byte per slot of both sieves, set where an anchor hashes to it, and the anchors' sizes."""
    at = F.col("slot")
    slots = anchors.select("size", F.explode(F.array("first", "second")).alias("slot"))
    pieces = slots.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"), F.collect_set("size").alias("sizes")
    ).collect()
    sieve = np.zeros(2 * SIEVE_SLOTS + 1, dtype=bool)
    for r in pieces:
        # Bucket b starts at 32768 * (b - 1) + 1; bucket 0 holds 0 alone.
        held = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")) + 32768 * (r["piece"] - 1) + 1
        sieve[held if r["piece"] else 0] = True
    return sieve, sorted({n for r in pieces for n in r["sizes"]})


def _passing(texts: list[bytes], sieve: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, size, gram, places) of every piece that both sieves let through; texts are hashed together, end to end."""
    starts = np.cumsum([0, *map(len, texts)])
    for size, grams in _grams(b"".join(texts), sizes):
        first, _ = _slots(grams, size)
        at = np.flatnonzero(sieve[first])
        at = at[sieve[_slots(grams[at], size)[1]]]
        text = np.searchsorted(starts, at, side="right") - 1
        # A piece that goes on into the next text is none.
        inside = at + size <= starts[text + 1]
        at, text = at[inside], text[inside]
        order = np.lexsort((at, grams[at], text))
        at, text = at[order], text[order]
        if len(at):
            new = np.flatnonzero((np.diff(text) != 0) | (np.diff(grams[at]) != 0)) + 1
            for places, i in zip(np.split(at, new), text[np.r_[0, new]], strict=True):
                yield int(i), size, int(grams[places[0]].view(np.int64)), places - starts[i]


def _windows(data: bytes, at: np.ndarray, reach: int) -> list[bytes]:
    """The parts of a text within `reach` bytes of these places, which ascend; parts that meet are one."""
    apart = np.flatnonzero(np.diff(at) > 2 * reach) + 1
    return [data[max(0, w[0] - reach) : w[-1] + reach] for w in np.split(at, apart)]


def leak_scan(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(text_id, token) for every private token that occurs in a public text.

    A token is looked up by one of its own pieces, as long as fits and the one rarest among
    the tokens. Texts are read once: their pieces pass through two sieves of fixed
    size before anything is shuffled, so a text in which no piece could be an
    anchor ends there. What is left meets the anchors on equality, with its text
    as far as the longest token reaches to either side, and the full token is
    verified; sieves that many tokens fill let more pieces through and change
    no row. Null texts hold nothing.
    """
    anchors = _anchors(tokens)
    sieve, sizes = _sieve(anchors)
    reach = tokens.agg(F.max(F.octet_length("token"))).first()[0] or 0
    kind = dict(texts.dtypes)["text_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = pdf["text"].tolist()
            # Runs of texts of a bounded size; a longer text is one by itself.
            ends = np.cumsum([len(t) for t in data])
            start = 0
            while start < len(data):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right")))
                found = list(_passing(data[start:stop], sieve, sizes))
                if found:
                    ids = pdf["text_id"].iloc[[start + i for i, _, _, _ in found]].array
                    parts = [_windows(data[start + i], at, reach) for i, _, _, at in found]
                    yield pd.DataFrame({"text_id": ids, "parts": parts, "size": [n for _, n, _, _ in found], "gram": [g for _, _, g, _ in found]})
                start = stop

    held = texts.where("text IS NOT NULL").select("text_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, f"text_id {kind}, parts array<binary>, size int, gram long")
    met = held.join(anchors.select("token", "size", "gram"), ["size", "gram"])
    return met.where(F.exists("parts", lambda p: F.contains(p, F.col("token").cast("binary")))).select("text_id", "token")


# Shapes of credentials.
SECRET_SHAPES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": r"\bBearer\s+[A-Za-z0-9._~+/=-]{12,}",
    "basic": r"\bBasic\s+[A-Za-z0-9+/=]{12,}",
    "vendor_key": r"\b(?:sk|ghp|gho|ghu|glpat|AKIA)[-_A-Za-z0-9]{12,}",
    "chat_token": r"\bxox[a-z]-[A-Za-z0-9-]{10,}",
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "url_credentials": r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@",
    "named_field": r"(?i)\b(?:password|passwd|secret|credential|api[_-]?key|token|authorization|cookie|private[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9._~+/=-]{12,}",
}


def secret_scan(texts: DataFrame) -> DataFrame:
    """How often each credential shape occurs in each text; the values stay out."""
    hits = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.regexp_count("text", F.lit(shape)).cast("long").alias("hits")) for kind, shape in SECRET_SHAPES.items()
    ])
    return texts.select("text_id", F.explode(F.filter(hits, lambda h: h["hits"] > 0)).alias("h")).select("text_id", "h.kind", "h.hits")


#: Words that name a credential, as parts of a column's name.
SECRET_WORDS = ("password", "passwd", "secret", "credential", "token", "cookie", "apikey", "privatekey", "authorization", "authentication")
SECRET_PARTS = {*SECRET_WORDS, "auth", "header", "headers"}


def secret_columns(df: DataFrame) -> list[str]:
    """Columns whose very name says they hold a credential.

    A name is cut at separators and humps; one part, or two neighbours together,
    must be such a word. A name without separators tells by its end.
    """
    import re

    def tells(name: str) -> bool:
        parts = [p.lower() for p in re.findall("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
        joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
        return bool(SECRET_PARTS & {*parts, *joined}) or any(p.endswith(SECRET_WORDS) for p in parts)

    return [c for c in df.columns if tells(c)]
