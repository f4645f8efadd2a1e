"""Reconciliation of two tables by digests: only ranges of keys that differ are joined.

Both sides are reduced, in the map tasks, to one digest per range of hashed keys: the
row count and the sum of the row hashes, which do not depend on the order of the
rows. Ranges whose digests differ are cut again in the same way, and only the rows
of the fine ranges that still differ are shuffled and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.operators.quality import stock_drift
from shelfline.session import durable, small_side

# Ranges at each of the two levels.
RANGES = 4096


def _range(key: str, ranges: int, level: int) -> Column:
    """Number of the range of ``key``, of ``ranges ** level``; the finer number divided by ``ranges`` is the coarser."""
    return F.floor(F.pmod(F.xxhash64(F.col(key)), F.lit(ranges * ranges)) / F.lit(ranges ** (2 - level))).cast("bigint")


def _digests(side: DataFrame, key: str, value: str, ranges: int, level: int) -> DataFrame:
    row = F.xxhash64(F.col(key).cast("string"), F.col(value).cast("bigint"))
    # Sums of hashes as exact numbers: they can't overflow, and equal rows don't cancel out.
    total = F.sum(row.cast("decimal(20,0)"))
    return side.groupBy(_range(key, ranges, level).alias("_range")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


def differing_ranges(left: DataFrame, right: DataFrame, key: str, value: str, ranges: int, level: int) -> DataFrame:
    """(_range) of those whose (key, value) rows differ between both sides; at most ``ranges ** level``."""
    a, b = (_digests(side, key, value, ranges, level).alias(name) for side, name in ((left, "a"), (right, "b")))
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.total").eqNullSafe(F.col("b.total"))
    both = a.join(b, F.col("a._range") == F.col("b._range"), "full_outer").where(~same)
    return durable(both.select(F.coalesce("a._range", "b._range").alias("_range")))


def _within(side: DataFrame, found: DataFrame, key: str, ranges: int, level: int) -> DataFrame:
    return side.withColumn("_range", _range(key, ranges, level)).join(small_side(found), "_range", "left_semi").drop("_range")


def suspects(left: DataFrame, right: DataFrame, key: str, value: str, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in fine ranges that differ: all that a join of the whole sides could find different."""
    for level in (1, 2):
        found = differing_ranges(left, right, key, value, ranges, level)
        left, right = (_within(side, found, key, ranges, level) for side in (left, right))
    return left, right


def stock_drift_by_digest(products: DataFrame, counters: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``stock_drift`` for tables that mostly agree.

    Three scans of each side and no shuffle of rows that agree. Null keys and
    repeated ones are rows like others. Rows that differ go unseen only if the
    64-bit hashes of their range add up alike.
    """
    key = F.col("product_id").cast(products.schema["id"].dataType).alias("product_id")
    stock = products.select(F.col("id").alias("product_id"), F.col("stock").alias("_value"), "stock")
    counted = counters.select(key, F.col("counter").alias("_value"), "counter")
    left, right = suspects(stock, counted, "product_id", "_value", ranges)
    return stock_drift(left.select(F.col("product_id").alias("id"), "stock"), right)
