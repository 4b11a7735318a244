"""Exact fractions where a decimal would lose digits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_micros(value: Column, num: Column, den: Column) -> Column:
    """value x num / den for positive integers, rounded half-up once."""
    wide = value.cast("decimal(19,0)") * num.cast("decimal(19,0)")
    d = den.cast("decimal(19,0)")
    rest = wide % d
    quotient = ((wide - rest) / d).cast("decimal(38,0)")
    return (quotient + F.when(rest * 2 >= d, F.lit(1)).otherwise(F.lit(0))).cast("long")


WIDE = "decimal(38,0)"
#: Primes below 2**31, so that products of residues stay in 64 bits.
PRIMES = (2147483647, 2147483629, 2147483587)


def whole_div(a: Column, b: Column) -> Column:
    """a div b for integers in decimals, a not negative, b positive."""
    return ((a - a % b) / b).cast(WIDE)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two wide integers; 185 steps are enough for 38 digits."""
    start = F.struct(a.cast(WIDE).alias("a"), b.cast(WIDE).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(WIDE).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(185)), start, step)["a"]


def fraction(num: Column, den: Column) -> Column:
    """struct(num, den) in lowest terms, num not negative, den positive; more than 38 digits raise."""
    g = gcd(num, den)
    return F.struct(whole_div(num.cast(WIDE), g).alias("num"), whole_div(den.cast(WIDE), g).alias("den"))


def times(a: Column, b: Column) -> Column:
    """Product of two fractions, reduced crosswise first so that it stays short."""
    x, y = fraction(a["num"], b["den"]), fraction(b["num"], a["den"])
    return F.struct((x["num"] * y["num"]).cast(WIDE).alias("num"), (x["den"] * y["den"]).cast(WIDE).alias("den"))


def inverse(a: Column) -> Column:
    return F.struct(a["den"].alias("num"), a["num"].alias("den"))


def sum_of(fractions: Column) -> Column:
    """Sum of an array of fractions."""

    def plus(s: Column, x: Column) -> Column:
        share = whole_div(x["den"], gcd(s["den"], x["den"]))
        num = s["num"] * share + x["num"] * whole_div(s["den"] * share, x["den"])
        return fraction(num.cast(WIDE), (s["den"] * share).cast(WIDE))

    return F.aggregate(fractions, F.struct(F.lit(0).cast(WIDE).alias("num"), F.lit(1).cast(WIDE).alias("den")), plus)


def rounded(value: Column, places: int) -> Column:
    """A fraction in units of the last place, half-up, by long division."""
    num, den = value["num"], value["den"]
    start = F.struct(whole_div(num, den).alias("q"), (num % den).cast(WIDE).alias("r"))

    def digit(s: Column, _: Column) -> Column:
        ten = (s["r"] * 10).cast(WIDE)
        return F.struct((s["q"] * 10 + whole_div(ten, den)).cast(WIDE).alias("q"), (ten % den).cast(WIDE).alias("r"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(places)), start, digit) if places else start
    return done["q"] + F.when(done["r"] * 2 >= den, F.lit(1)).otherwise(F.lit(0))


def inverse_mod(d: Column, prime: int) -> Column:
    """The inverse of d modulo a prime, 0 if the prime divides it."""
    power = F.lit(prime - 2)
    start = F.struct(F.lit(1).cast("long").alias("r"), (d % prime).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        bit = F.call_function("getbit", power.cast("long"), i) == 1
        return F.struct(F.when(bit, s["r"] * s["b"] % prime).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % prime).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, step)["r"]


def folded_terms(relatives: DataFrame, key: str, num: str, den: str, weight: str) -> DataFrame:
    """(key, den, num_sum, weight_sum): an exact sum of fractions, one row per denominator, that merges map-side."""
    return relatives.groupBy(key, den).agg(
        F.sum(F.col(num).cast(WIDE) * F.col(weight)).alias("num_sum"), F.sum(weight).alias("weight_sum")
    )


def lowest_terms(relatives: DataFrame, key: str, num: str, den: str, weight: str) -> DataFrame:
    """(key, denominator, numerator): the sum of num/den per key as reduced fractions, one per denominator."""
    folded = folded_terms(relatives, key, num, den, weight)
    f = fraction(F.col("num_sum"), F.col(den).cast(WIDE))
    return folded.select(key, f.alias("f")).groupBy(key, F.col("f.den").alias("denominator")).agg(F.sum("f.num").alias("numerator"))


def mean_micros(relatives: DataFrame, key: str, num: str, den: str, weight: str) -> DataFrame:
    """(key, count, level_micros): 100 x mean of num/den in micros, half-up of the exact value.

    With the sum S of fractions and the count n the answer is
    floor((floor(2e8 S) + n) / 2n). Of each term 2e8 num/den the whole part is
    kept and the rest taken to 36 digits, in two limbs. Only where the rests come
    within the last digit of a whole number can that be in doubt: there the sum
    equals it exactly if it does modulo each prime. Everything is a sum per key.
    """
    folded = folded_terms(relatives, key, num, den, weight)
    d = F.col(den).cast("decimal(19,0)")
    unit = F.lit(10**18).cast("decimal(19,0)")
    scaled = (F.col("num_sum").cast("decimal(28,0)") * F.lit(200_000_000).cast("decimal(9,0)")).cast(WIDE)
    terms = folded.withColumns({"t_whole": whole_div(scaled, d), "t_rest": (scaled % d).cast("decimal(19,0)")})
    first = (F.col("t_rest") * unit).cast(WIDE)
    terms = terms.withColumns({"t_first": whole_div(first, d), "t_over": (first % d).cast("decimal(19,0)")})
    residues = {f"t_mod{i}": (F.col("t_rest") % p).cast("long") * inverse_mod(F.col(den), p) % p for i, p in enumerate(PRIMES)}
    terms = terms.withColumns(residues | {"t_second": whole_div((F.col("t_over") * unit).cast(WIDE), d)})
    sums = terms.groupBy(key).agg(
        F.sum("weight_sum").alias("count"), F.count(F.lit(1)).alias("t_terms"), *[F.sum(c).cast(WIDE).alias(c) for c in ("t_whole", "t_first", "t_second")],
        *[F.sum(c).alias(c) for c in residues], *[F.max((F.col(den) % p == 0).cast("int")).alias(f"t_skip{i}") for i, p in enumerate(PRIMES)],
    )
    high = (F.col("t_first") + whole_div(F.col("t_second"), unit)).cast(WIDE)
    whole = whole_div(high, unit)
    close = (high % unit == unit - 1) & (F.col("t_second") % unit >= unit - F.col("t_terms"))
    for i, p in enumerate(PRIMES):
        close = close & ((F.col(f"t_skip{i}") == 1) | (F.col(f"t_mod{i}") % p == (whole + 1) % p))
    total = (F.col("t_whole") + whole + F.when(close, F.lit(1)).otherwise(F.lit(0)) + F.col("count")).cast(WIDE)
    return sums.select(key, "count", whole_div(total, (F.col("count") * 2).cast("decimal(20,0)")).cast("long").alias("level_micros"))


def exact_mean(relatives: DataFrame, key: str, num: str, den: str, weight: str) -> DataFrame:
    """Mean of num/den per key as one reduced fraction of 100, as text, and in micros.

    The fraction has as many digits as its denominators need, which no column
    type holds; `mean_micros` and `lowest_terms` do without it. Rows are (key, num, den, weight). Numerators fold per denominator with
    built-in sums first; the fractions left, one per distinct denominator, are
    added per task and only the partial sums meet per key.
    """
    folded = folded_terms(relatives, key, num, den, weight)
    key_type = dict(relatives.dtypes)[key]
    partial_schema = f"{key} {key_type}, num string, den string, count long"

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from fractions import Fraction

        sums: dict = {}
        for pdf in batches:
            for k, d, n, c in zip(pdf[key], pdf[den], pdf["num_sum"], pdf["weight_sum"], strict=True):
                held, seen = sums.get(k, (Fraction(0), 0))
                sums[k] = (held + Fraction(int(n), int(d)), seen + int(c))
        rows = [(k, str(f.numerator), str(f.denominator), c) for k, (f, c) in sums.items()]
        yield pd.DataFrame(rows, columns=[key, "num", "den", "count"])

    def final_sum(pdf: pd.DataFrame) -> pd.DataFrame:
        from fractions import Fraction

        total = sum((Fraction(int(n), int(d)) for n, d in zip(pdf["num"], pdf["den"], strict=True)), Fraction(0))
        count = int(pdf["count"].sum())
        level = total / count * 100
        scaled = level * 1_000_000
        micros = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
        return pd.DataFrame(
            [(pdf[key].iloc[0], count, str(level.numerator), str(level.denominator), micros)],
            columns=[key, "count", "level_num", "level_den", "level_micros"],
        )

    parts = folded.mapInPandas(partial_sums, partial_schema)
    return parts.groupBy(key).applyInPandas(
        final_sum, f"{key} {key_type}, count long, level_num string, level_den string, level_micros long"
    )
