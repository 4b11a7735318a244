"""Quality rules with thresholds that adapt to each language and source.

Every measure is summarised in a mergeable quantile sketch per (lang, source);
sketches merge up to the language and to the whole where a group is small. The
fences drawn from their quartiles replace fixed cutoffs and are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import BLANKS, WORD, write_out

SYMBOLS = "#*$%&|<>"
#: Ratio, and the least distance of its upper and its lower fence from the quartiles (None: no such fence).
RATIOS: dict[str, tuple[float | None, float | None]] = {
    "symbol_share": (0.02, None),
    "upper_share": (0.10, None),
    "dup_line_share": (0.30, None),
    "repeat_share": (0.15, None),
    "word_length": (1.5, 1.5),
    "distinct_share": (None, 0.25),
}
SPREAD = 4.0
LEAST_ROWS = 200
SKETCH_K = 2048


def measures(docs: DataFrame) -> DataFrame:
    """Counts over each whole text; a null text counts as empty. Rows keep doc_id, lang and source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("h"),
    )
    h = lambda i: F.get("h", i)
    starts = F.when(F.size("h") >= 5, F.sequence(F.lit(0), F.size("h") - 5)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(h(i), h(i + 1), h(i + 2), h(i + 3), h(i + 4)).alias("g"), i.alias("p")))).alias("grams"),
    ).drop("lines", "h")
    # Equal windows are neighbours in the sorted array; the words they cover are counted once.
    other = lambda i: F.get(F.col("grams"), i)["g"]
    repeated = F.transform("grams", lambda x, i: F.when((other(i - 1) == x["g"]) | (other(i + 1) == x["g"]), x["p"]))
    rows = rows.withColumn("repeated", F.array_sort(F.filter(repeated, lambda p: p.isNotNull()))).drop("grams")
    covered = F.aggregate(
        "repeated",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("repeated")


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


def with_ratios(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))
    return rows.withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        # Texts repeat more words the longer they are, so short and long ones share a scale by the root of the count.
        "distinct_share": F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.col("n_distinct") / F.sqrt(F.col("n_words") * 10.0))),
    })


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One mergeable quantile sketch per ratio and group; partial sketches merge before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, SKETCH_K).alias(r) for r in RATIOS])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, SKETCH_K).alias(r) for r in RATIOS])


def fences(suffix: str) -> list[Column]:
    """Upper and lower fence of each ratio: quartile and SPREAD interquartile ranges, or the least distance."""
    out = []
    for r, (up, down) in RATIOS.items():
        q1, q3 = (F.kll_sketch_get_quantile_double(r, F.lit(q).cast("double")) for q in (0.25, 0.75))
        reach = SPREAD * (q3 - q1)
        if up is not None:
            out.append((q3 + F.greatest(reach, F.lit(up))).alias(f"{r}_high{suffix}"))
        if down is not None:
            out.append((q1 - F.greatest(reach, F.lit(down))).alias(f"{r}_low{suffix}"))
    return out


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source) with fences; a group under LEAST_ROWS takes those of its language, a small language those of all."""
    parts = write_out(sketches(rows.where(~base_failed()), ["lang", "source"]), "rules-sketches")
    own = parts.select("lang", "source", F.col("n").alias("n_own"), *fences("_own"))
    by_lang = merged(parts, ["lang"])
    by_lang = by_lang.select(F.col("lang").alias("_lang"), F.col("n").alias("n_lang"), *fences("_lang"))
    everything = merged(parts, [])
    # One row of a dozen numbers, whatever the input.
    whole = everything.where("n > 0").select(*fences("_all")).first()
    if whole is None:
        whole = dict.fromkeys((f"{r}_{side}_all" for r in RATIOS for side in ("high", "low")))
    everything = whole if isinstance(whole, dict) else whole.asDict()
    joined = own.join(by_lang, own["lang"].eqNullSafe(by_lang["_lang"])).withColumns({k: F.lit(v).cast("double") for k, v in everything.items()})
    names = [f"{r}_{side}" for r, (up, down) in RATIOS.items() for side, has in (("high", up), ("low", down)) if has is not None]
    chosen = [
        F.when(F.col("n_own") >= LEAST_ROWS, F.col(f"{x}_own")).when(F.col("n_lang") >= LEAST_ROWS, F.col(f"{x}_lang")).otherwise(F.col(f"{x}_all")).alias(x)
        for x in names
    ]
    return joined.select("lang", "source", *chosen)


def judge(docs: DataFrame) -> DataFrame:
    """Measures with base_failed and kept for every row of (doc_id, lang, source, text).

    kept is false where base_failed, else whether all ratios lie within the
    fences of the row's language and source. Null lang or source form groups of
    their own. A text without words fails the base rule.
    """
    rows = with_ratios(write_out(measures(docs), "rules-measures"))
    limits = write_out(thresholds(rows), "rules-limits").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for r, (up, down) in RATIOS.items():
        if up is not None:
            inside = inside & (F.col(r) <= F.col(f"{r}_high"))
        if down is not None:
            inside = inside & (F.col(r) >= F.col(f"{r}_low"))
    held = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"),
    )
