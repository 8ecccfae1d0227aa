"""SimHash votes with DataFrame functions only.

A text's terms are 64-bit hashes, one row each. Bits are counted four to a long, in lanes of 16 bits: the nibble's bits
are spread by a product, and a sum adds four counters at once. A text longer than SEGMENT terms comes in segments, so
that no lane overflows; segments are added up in lanes of 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms in a segment; below 2**16.
SEGMENT = 32_768
_SPREAD, _LANES = 1 | 1 << 15 | 1 << 30 | 1 << 45, 1 | 1 << 16 | 1 << 32 | 1 << 48
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, lower: bool = True) -> Column:
    """Longest runs of characters other than U+0020 and U+0009 to U+000D; lower: A-Z are lower-cased first."""
    blank = "\t\n\x0b\x0c\r"
    old, new = (blank + _UPPER, " " * 5 + _LOWER) if lower else (blank, " " * 5)
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), old, new), " "), "")


def segments(df: DataFrame, words: str, overlap: int) -> DataFrame:
    """A row for each SEGMENT words: segment (its first word's index) and the words, with `overlap` more that belong to the next one."""
    df = df.withColumn("segment", F.explode(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(SEGMENT))))
    short = F.size(words) <= SEGMENT
    return df.withColumn(words, F.when(short, F.col(words)).otherwise(F.slice(F.col(words), F.col("segment") + 1, F.lit(SEGMENT + overlap))))


def tally(df: DataFrame, keys: list[str], terms: Column, planes: list[Callable[[Column], Column]]) -> DataFrame:
    """Keys, and a signature string: for each plane, which maps a term to a 64-bit hash, 16 hexadecimal digits of the bits that over half the terms set.

    df has a column segment; a (keys, segment) has no more than SEGMENT terms. Without a term all bits are 0.
    """
    one = df.select(*keys, "segment", F.explode_outer(terms).alias("term"))
    hashed = one.select(*keys, "segment", *(f(F.col("term")).alias(f"h{p}") for p, f in enumerate(planes)), F.col("term").isNotNull().cast("long").alias("one"))
    nibble = lambda h, k: (F.shiftrightunsigned(h, 4 * k).bitwiseAND(F.lit(15)) * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES))
    narrow = [(p, k) for p in range(len(planes)) for k in range(16)]
    by_segment = hashed.groupBy(*keys, "segment").agg(F.sum("one").alias("n"), *(F.sum(F.when(F.col("one") == 1, nibble(F.col(f"h{p}"), k)).otherwise(F.lit(0))).alias(f"n{p}_{k}") for p, k in narrow))
    lane = lambda c, i: F.shiftrightunsigned(c, 16 * i).bitwiseAND(F.lit(0xFFFF))
    wide = [(p, k, half) for p, k in narrow for half in (0, 2)]
    unpacked = by_segment.select(*keys, "n", *((lane(F.col(f"n{p}_{k}"), half) + F.shiftleft(lane(F.col(f"n{p}_{k}"), half + 1), 32)).alias(f"w{p}_{k}_{half}") for p, k, half in wide))
    total = unpacked.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"w{p}_{k}_{half}").alias(f"w{p}_{k}_{half}") for p, k, half in wide))
    count = lambda p, b: F.shiftrightunsigned(F.col(f"w{p}_{b // 4}_{b % 4 // 2 * 2}"), 32 * (b % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    digit = lambda p, k: sum((F.when(count(p, 4 * k + i) * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(1, 4)), F.when(count(p, 4 * k) * 2 > F.col("n"), F.lit(1)).otherwise(F.lit(0)))
    return total.select(*keys, F.lower(F.concat(*(F.hex(digit(p, k).cast("long")) for p in range(len(planes)) for k in range(15, -1, -1)))).alias("fingerprint"))


def as_long(hex_digits: Column) -> Column:
    """Sixteen hexadecimal digits as a long with the same bits."""
    high, low = (F.conv(F.substring(hex_digits, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def differing(a: Column, b: Column, planes: int) -> Column:
    """Bits that differ between two signature strings."""
    parts = [F.bit_count(as_long(F.substring(a, 16 * p + 1, 16)).bitwiseXOR(as_long(F.substring(b, 16 * p + 1, 16)))) for p in range(planes)]
    return sum(parts[1:], parts[0])
