"""Sieves of bounded size over a set of keys: let every key through, and few others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: 64-bit words of a sieve, two megabytes. More keys let more others through and change no result.
WORDS = 1 << 18
# Words in a row of a sieve of prints, and its fewest and most rows, 64 kB and 32 MB.
ROW_WORDS, LEAST_ROWS, MOST_ROWS = 1 << 10, 1 << 3, 1 << 12


def _place(value: Column) -> tuple[Column, Column]:
    """The word of a value and its bit in it."""
    slot = F.pmod(F.xxhash64(value), F.lit(WORDS * 64))
    return F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))


def may_be_in(value: Column, keys: DataFrame, key: str) -> Column:
    """False only for values that are not among the keys; what passes is to be joined with them."""
    word, bit = _place(F.col(key))
    held = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(WORDS).join(held, F.col("id") == F.col("word"), "left")
    in_order = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    words = every.agg(F.transform(in_order, lambda entry: entry["bits"])).scalar()
    word, bit = _place(value)
    return F.get(words, word).bitwiseAND(bit) != 0


class PrintSieve:
    """A sieve of 64-bit prints, sixteen bits a print as far as it may grow; the prints are counted, so written before."""

    def __init__(self, prints: DataFrame, key: str):
        rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (prints.count() * 16 // (ROW_WORDS * 64)).bit_length()))
        self.size = rows * ROW_WORDS
        word, bit = self._place(F.col(key))
        held = prints.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        every = prints.sparkSession.range(self.size).join(held, F.col("id") == F.col("word"), "left")

        def in_order(at: str, value: Column) -> Column:
            return F.transform(F.sort_array(F.collect_list(F.struct(F.col(at), value.alias("value")))), lambda entry: entry["value"])

        # Put together row by row, so that no task sorts all words.
        parts = every.groupBy(F.shiftright("id", 10).alias("row")).agg(in_order("id", F.coalesce("bits", F.lit(0).cast("long"))).alias("words"))
        self.words = parts.agg(F.flatten(in_order("row", F.col("words")))).scalar()

    def _place(self, value: Column) -> tuple[Column, Column]:
        """The word of a print and its bit in it, from bits of the print that do not overlap."""
        bit = F.shiftrightunsigned(value, 40).bitwiseAND(63).cast("int")
        return value.bitwiseAND(F.lit(self.size - 1).cast("long")).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit)

    def may_hold(self, value: Column) -> Column:
        """False only for prints that are not in it; null for those not known."""
        word, bit = self._place(value)
        return F.get(self.words, word).bitwiseAND(bit) != 0
