"""Exact fractions against Python's, and coverage runs against a grid laid out by hand."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from pricetrail.functions import exact
from pricetrail.functions.money import mean_minor
from pricetrail.operators import realseries


def test_mean_of_a_million_rows_is_exact(spark):
    n = 1_000_000
    df = spark.range(2 * n + 1).select((F.col("id") < n).cast("int").alias("x"))
    assert df.agg(mean_minor("x")).first()[0] == 0
    for values, want in (([1, 2], 2), ([-1, -2], -1), ([-3], -3), ([10**18] * 3, 10**18), ([0, 0, 1], 0), ([None, 4], 4)):
        assert spark.createDataFrame([(v,) for v in values], "x long").agg(mean_minor("x")).first()[0] == want


def test_fractions_are_exact(spark):
    rng = random.Random(1)
    rows = [([(rng.randint(1, 10**6), rng.randint(1, 60)) for _ in range(rng.randint(1, 6))], rng.randint(1, 10**7), rng.randint(1, 10**5)) for _ in range(40)]
    wide = [([(Decimal(n), Decimal(d)) for n, d in parts], Decimal(a), Decimal(b)) for parts, a, b in rows]
    df = spark.createDataFrame(wide, "parts array<struct<num: decimal(38,0), den: decimal(38,0)>>, a decimal(38,0), b decimal(38,0)")
    total, other = exact.sum_of(F.col("parts")), exact.fraction(F.col("a"), F.col("b"))
    got = df.select(total.alias("t"), exact.times(total, exact.inverse(other)).alias("q"), exact.rounded(total, 6).alias("r")).collect()
    for (parts, a, b), r in zip(rows, got, strict=True):
        t = sum(Fraction(n, d) for n, d in parts)
        assert (r["t"]["num"], r["t"]["den"]) == (t.numerator, t.denominator)
        q = t / Fraction(a, b)
        assert (r["q"]["num"], r["q"]["den"]) == (q.numerator, q.denominator)
        assert r["r"] == (t * 10**6 + Fraction(1, 2)) // 1


def test_mean_micros_rounds_the_exact_value(spark):
    rng = random.Random(7)
    groups = {f"g{i}": [(rng.randint(1, 10**7), rng.randint(1, 10**7), rng.randint(1, 3)) for _ in range(rng.randint(1, 60))] for i in range(12)}
    # Rests that add up to a whole number exactly, to one just missed, and values that end in half a micro.
    groups |= {
        "whole": [(1, 2, 1), (1, 3, 1), (1, 6, 1)], "thirds": [(1, 3, 1), (1, 3, 1), (1, 3, 1)], "sevenths": [(k, 7, 1) for k in range(1, 7)],
        "half": [(1, 200_000_000, 1)], "below": [(1, 200_000_001, 1)], "missed": [(1, 2, 1), (1, 3, 1), (10**17, 6 * 10**17 + 1, 1)], "wide": [(10**10, 3, 1), (1, 999_999_937, 1)],
    }
    df = spark.createDataFrame([(k, *r) for k, rows in groups.items() for r in rows], "k string, num long, den long, n int")
    got = {r["k"]: (r["count"], r["level_micros"]) for r in exact.mean_micros(df, "k", "num", "den", "n").collect()}
    for k, rows in groups.items():
        count = sum(n for _, _, n in rows)
        level = sum(Fraction(a, d) * n for a, d, n in rows) / count * 100
        assert got[k] == (count, (level * 10**6 + Fraction(1, 2)) // 1), k
    terms = exact.lowest_terms(df, "k", "num", "den", "n").collect()
    for k, rows in groups.items():
        assert sum(Fraction(int(t["numerator"]), int(t["denominator"])) for t in terms if t["k"] == k) == sum(Fraction(a, d) * n for a, d, n in rows)


def test_coverage_runs_equal_a_grid(spark):
    rng = random.Random(11)
    day = lambda k: dt.date(2026, 1, 1) + dt.timedelta(days=k)
    base = 5
    seen = {}
    for line in [(m, s) for m in ("A", "B", "C", "D", None) for s in ("x", None)]:
        for k in range(0, 25):
            if k % 6 != 4 and rng.random() < (0.9 if k == base else 0.4):
                seen[line, k] = rng.random() < 0.7
    daily = spark.createDataFrame([(*line, day(k), good, f"o{k}", 100 + k, [] if good else [f"r{k}"]) for (line, k), good in seen.items()],
                                  "mpn string, seller string, date date, eligible boolean, observation_id string, amount_minor long, reasons array<string>")
    dates = sorted({k for _, k in seen})
    want = {}
    for line in {line for line, _ in seen}:
        own = sorted(k for other, k in seen if other == line)
        at_base = seen.get((line, base))
        for k in dates:
            if k < own[0]:
                continue
            prior = max((p for p in own if p < k and seen[line, p]), default=None)
            if not at_base:
                want[line, k] = ("no_baseline_observation", None, ["no_observation_on_immutable_base_date"], None) if at_base is None else ("baseline_ineligible", None, [f"r{base}"], None)
            elif (line, k) not in seen:
                want[line, k] = ("missing_current_observation_no_imputation", prior, ["no_same_date_observation"], None)
            elif seen[line, k]:
                want[line, k] = ("eligible_paired_line", None, [], f"o{k}")
            else:
                want[line, k] = ("current_observation_ineligible_no_imputation", None, [f"r{k}"], f"o{k}")
    runs = realseries.coverage_runs(daily, str(day(base)))
    number = lambda d: None if d is None else (d - day(0)).days
    got = {}
    for r in runs.collect():
        assert r["base_observation_id"] == (f"o{base}" if "baseline" not in r["status"] else None)
        for k in range(number(r["start_date"]), number(r["end_date"]) + 1):
            assert ((r["mpn"], r["seller"]), k) not in got
            got[(r["mpn"], r["seller"]), k] = (r["status"], number(r["last_eligible_date"]), r["reasons"], r["current_observation_id"])
    assert {key: v for key, v in got.items() if key[1] in dates} == want
    assert runs.count() <= 2 * len(seen) + 10
    per = realseries.coverage_by_date(runs, daily).collect()
    assert sorted(number(r["date"]) for r in per) == dates
    for r in per:
        held = [v[0] for (_, k), v in want.items() if k == number(r["date"])]
        for status in [*realseries.BASED, *realseries.UNBASED]:
            assert r[f"{status}_count"] == held.count(status)
        assert r["baseline_eligible_line_count"] == sum(1 for line in {line for line, _ in seen} if seen.get((line, base)))
    spans = realseries.run_dates(runs, realseries.observed_days(daily)).collect()
    for r in spans:
        inside = [k for k in dates if number(r["start_date"]) <= k <= number(r["end_date"])]
        assert r["date_count"] == len(inside)
        if r["last_eligible_date"] is not None:
            assert r["stale_days"] == sum(k - number(r["last_eligible_date"]) for k in inside)


def test_a_doubled_deflator_month_doubles_nothing(spark):
    months = spark.sql("SELECT '2026-01' AS month, named_struct('num', CAST(30 AS DECIMAL(38,0)), 'den', CAST(7 AS DECIMAL(38,0))) AS exact UNION ALL SELECT '2026-02', named_struct('num', CAST(1 AS DECIMAL(38,0)), 'den', CAST(1 AS DECIMAL(38,0)))")
    deflator = spark.sql("SELECT * FROM VALUES ('2026-01', 1.5D), ('2026-02', 2D), ('2026-02', 3D) AS t(month, value)")
    got = realseries.constant_price(months, deflator, "2026-01").orderBy("month").collect()
    assert [(r["value"], r["unavailable_reason"]) for r in got] == [(4.2857, None), (None, "duplicate_observation_month")]
    assert [r["unavailable_reason"] for r in realseries.constant_price(months, deflator, "2026-02").orderBy("month").collect()] == ["constant_price_reference_month_missing", "duplicate_observation_month"]
