"""Table checks and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfline.functions.rules import Rule, split_by_rules


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with the number of rows as ``copies``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def orphan_orders(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Orders whose product does not exist."""
    return orders.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti").select(orders.columns)


def check_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break a rule, each with all broken rules in ``reasons``; one pass."""
    return split_by_rules(df, rules).rejects


def invalid_requests(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return split_by_rules(df, rules).rejects


def stock_drift(products: DataFrame, counters: DataFrame) -> DataFrame:
    """Products whose counter disagrees with the table, or which only one side knows.

    ``counters`` has ``product_id`` and ``counter``.
    """
    stock = products.select(F.col("id").alias("product_id"), F.col("stock"))
    both = stock.join(counters.select("product_id", "counter"), "product_id", "full_outer")
    drift = F.col("counter") - F.col("stock")
    return both.withColumn("drift", drift).where(F.col("drift").isNull() | (F.col("drift") != 0))
