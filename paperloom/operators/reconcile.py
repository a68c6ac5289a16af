"""Comparison of two tables by multiset hashes.

Rows get two hashes; their sums over a key range don't depend on order, and equal sums prove equal
ranges. A tree of ranges (by hash of the key, BITS bits a level) is descended only where sums differ,
until what differs is small; only these ranges' rows are compared. Equal tables are read once and
shuffle a few thousand sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

#: Bits of the key's hash that a level of the tree takes, levels at most, and rows up to which differing ranges are compared.
BITS, LEVELS, ROWS = 12, 4, 1_000_000


def range_of(key: list[str], level: int) -> Column:
    """The range of a row at a level: the first BITS * level bits of its key's hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - BITS * level)


def hashes(rows: DataFrame, key: list[str], level: int, sign: int) -> DataFrame:
    """at and two hashes of each row, with its table's sign; nulls count by their column."""
    marked = [x for c in rows.columns for x in (F.col(c), F.col(c).isNull())]
    return rows.select(range_of(key, level).alias("at"), F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(1), *marked).alias("b"), F.lit(sign).alias("sign"))


def differing(expected: DataFrame, stored: DataFrame, key: list[str], level: int) -> DataFrame:
    """Ranges whose sums differ, with the rows of either side: the halves of hashes, added for one table and taken off for the other, don't make 0."""
    both = hashes(expected, key, level, 1).unionByName(hashes(stored, key, level, -1))
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    parts = {"a_low": low(F.col("a")), "a_high": high(F.col("a")), "b_low": low(F.col("b")), "b_high": high(F.col("b"))}
    sums = both.groupBy("at").agg(F.count("*").alias("n"), F.sum("sign").alias("rows"), *[F.sum(F.col("sign") * x).alias(c) for c, x in parts.items()])
    return sums.where(" or ".join(f"{c} <> 0" for c in ("rows", *parts))).select("at", "n")


def inside(rows: DataFrame, key: list[str], level: int, ranges: DataFrame) -> DataFrame:
    return rows.withColumn("_at", range_of(key, level)).join(ranges.select(F.col("at").alias("_at")), "_at", "left_semi").drop("_at")


def differences(expected: DataFrame, stored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows in one table only, with multiplicity, and the side they are missing from (as metrics.differences).

    Tables have the same columns in the same order. The key (all columns by default) only says how rows are dealt.
    """
    key = key or expected.columns
    one, two, level = expected, stored, 0
    while level < LEVELS:
        level += 1
        # The first levels' ranges are at most 2^BITS; later ones at most as many as there are rows to compare.
        found = cut(differing(one, two, key, level))
        total = found.agg(F.count("*").alias("ranges"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        if not total.ranges:
            return expected.limit(0).withColumn("missing_from", F.lit("stored"))
        one, two = inside(expected, key, level, found), inside(stored, key, level, found)
        if total.rows <= ROWS:
            break
    counts = one.withColumn("_n", F.lit(1)).unionByName(two.withColumn("_n", F.lit(-1))).groupBy(*expected.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "stored").otherwise("expected")
    return counts.withColumn("missing_from", F.explode(F.array_repeat(side, F.abs("_n").cast("int")))).drop("_n")
