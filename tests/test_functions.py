from __future__ import annotations

import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetrail.functions.exact import ratio_micros
from pricetrail.functions.money import (
    basis_points, format_gbp, format_index, format_signed_percent, grouped_median, half_up, mean_minor, permille, round_dp,
)
from pricetrail.functions.periods import london_date, month_offset, month_span, quarter_label, valid_instant
from pricetrail.functions.text import canonical_json, nfkc, normalise_manufacturer, normalise_mpn, pounds_to_minor, slug, strip_markup
from pricetrail.functions.windows import lag_in_chunks
from tests.helpers import rows


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_median_examples(spark):
    df = spark.createDataFrame(
        [("a", 100), ("a", 101), ("b", 100), ("b", 102), ("c", 301), ("c", 100), ("c", 200), ("d", 7), ("d", 7), ("d", 7), ("d", 1)], "k string, x long"
    )
    assert rows(grouped_median(df, ["k"], "x", "m")) == [("a", 101), ("b", 101), ("c", 200), ("d", 7)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40))
def test_median_matches_statistics(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, x long")
    expected = int(statistics.median(values) + 0.5)
    assert grouped_median(df, ["k"], "x", "m").first()["m"] == expected


def test_roundings(spark):
    assert one(spark, half_up(F.lit(-2.5))) == -2
    assert one(spark, half_up(F.lit(2.5))) == 3
    assert one(spark, basis_points(F.lit(-501).cast("long"), F.lit(9999).cast("long"))) == -501
    # Halves go away from zero in both directions.
    assert one(spark, basis_points(F.lit(1).cast("long"), F.lit(20000).cast("long"))) == 1
    assert one(spark, basis_points(F.lit(-1).cast("long"), F.lit(20000).cast("long"))) == -1
    assert one(spark, basis_points(F.lit(0).cast("long"), F.lit(11000).cast("long"))) == 0
    assert one(spark, permille(F.lit(1100), F.lit(1000))) == 1100
    assert one(spark, round_dp(F.lit(1.00005), 4)) == 1.0001


def test_formats(spark):
    assert one(spark, format_gbp(F.lit(123456))) == "£1,234.56"
    assert one(spark, format_signed_percent(F.lit(-501))) == "-5.01%"
    assert one(spark, format_signed_percent(F.lit(0))) == "0.00%"
    assert one(spark, format_index(F.lit(103568))) == "103.6"


def test_periods(spark):
    assert one(spark, quarter_label(F.lit("2024-05-01").cast("date"))) == "2024Q2"
    assert one(spark, quarter_label(F.lit("2024-05-01").cast("date"), "-")) == "2024-Q2"
    assert str(one(spark, london_date(F.to_timestamp(F.lit("2026-08-16 23:30:00"))))) == "2026-08-17"
    assert str(one(spark, london_date(F.to_timestamp(F.lit("2026-01-16 23:30:00"))))) == "2026-01-16"
    assert one(spark, month_offset(F.lit("2025-02"), F.lit("2023-11"))) == 15
    assert one(spark, month_span(F.lit("2023-11"), F.lit("2023-11"))) == 1
    for text, ok in [("2026-01-02T03:04:05Z", True), ("2026-02-30T03:04:05Z", False), ("2026-01-02 03:04:05", False), (None, False)]:
        assert one(spark, valid_instant(F.lit(text).cast("string"))) is ok


def test_text(spark):
    assert one(spark, slug(F.lit("Corner Shop UK!"))) == "corner-shop-uk"
    assert one(spark, strip_markup(F.lit("<b>a</b>\n &amp; &pound;5"))) == "a & £5"
    assert one(spark, pounds_to_minor(F.lit("now £ 1,101 .64 inc VAT"))) == 110164
    assert one(spark, pounds_to_minor(F.lit("call us"))) is None
    assert one(spark, normalise_manufacturer(F.lit("G.Skill Intl"))) == "gskillintl"
    assert one(spark, nfkc(F.lit("ＡＢ①"))) == "AB1"
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert df.select(canonical_json("b", "a")).first()[0] == '{"a":null,"b":1}'


def test_ratio_is_exact(spark):
    value, num, den = 999_999_999_999, 12_345_678_901, 98_765_432_109
    expected = (2 * value * num + den) // (2 * den)
    got = one(spark, ratio_micros(F.lit(value).cast("long"), F.lit(num).cast("long"), F.lit(den).cast("long")))
    assert got == expected


def test_lag_in_chunks_equals_lag(spark):
    data = [(k, i * 7 % 101, i) for k in ("hot", "cold") for i in range(101) if k == "hot" or i % 10 == 0]
    df = spark.createDataFrame(data, "k string, at long, v long").dropDuplicates(["k", "at"])
    out = lag_in_chunks(df, ["k"], ["at"], ["v", "at"], F.floor(F.col("at") / 10))
    got = {(r["k"], r["at"]): (r["prior"]["v"] if r["prior"] else None) for r in out.collect()}
    for key in ("hot", "cold"):
        ordered = sorted((at, v) for k, at, v in data if k == key)
        previous = None
        for at, v in ordered:
            assert got[(key, at)] == previous
            previous = v


def test_lag_in_chunks_keeps_rows_with_null_keys_and_order(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 12, 2), ("a", None, 3), ("a", 5, 4)], "k string, at long, v long")
    out = lag_in_chunks(df, ["k"], ["at"], ["v"], F.floor(F.col("at") / 10))
    assert sorted((r["v"], r["prior"]["v"] if r["prior"] else None) for r in out.collect()) == [(1, None), (2, 1), (3, None), (4, 3)]


def test_part_numbers_are_composed_and_trimmed_of_all_white_space(spark):
    df = spark.createDataFrame([("\t ab-1\u00a0\n",), ("\uff21\uff22\uff0d\uff11",), ("\ufeffx y\u3000",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(normalise_mpn(F.col("t"))).collect()]
    assert got == ["AB-1", "AB-1", "X Y", None, ""]
    assert [r[0] for r in df.select(normalise_manufacturer(F.col("t"))).collect()] == ["ab1", "ab1", "xy", None, ""]


def test_mean_of_large_amounts_is_exact(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740993,)], "x long")
    assert df.agg(mean_minor("x")).first()[0] == 9007199254740993
    assert spark.createDataFrame([(None,)], "x long").agg(mean_minor("x")).first()[0] is None
