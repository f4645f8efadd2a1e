"""Predicates, projections and key lookups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

LOW_STOCK = 10


class Lookup(NamedTuple):
    hits: DataFrame
    misses: DataFrame


def confirmed(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") == "CONFIRMED")


def since(orders: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``; there is no upper bound.

    The bound folds to a literal of the column's own type, so it reaches the
    Parquet filter.
    """
    kind = orders.schema["created_at"].dataType
    return orders.where(F.col("created_at") >= (F.lit(as_of).cast(kind) - F.expr(f"INTERVAL {days} DAYS")).cast(kind))


def low_stock(products: DataFrame, threshold: int = LOW_STOCK) -> DataFrame:
    return products.where(F.col("stock") < threshold)


def stock_tier(stock: Column, none: str, few: str, rest: str) -> Column:
    """Urgency label for nothing left, under five left, or more."""
    return F.when(stock == 0, none).when(stock < 5, few).otherwise(rest)


def find_by_ids(df: DataFrame, ids: DataFrame) -> Lookup:
    """Rows of ``df`` with a requested id, and the requested ids that do not exist."""
    wanted = ids.select("id").distinct()
    return Lookup(df.join(wanted, "id", "left_semi"), wanted.join(df.select("id"), "id", "left_anti"))


def exists_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The requested ids that exist."""
    return ids.select("id").distinct().join(df.select("id"), "id", "left_semi")


def product_response(products: DataFrame) -> DataFrame:
    return products.select(
        "id", "name", "description", "price", "currency", "stock", "category", F.col("created_at").alias("createdAt")
    )


def order_response(orders: DataFrame) -> DataFrame:
    return orders.select(
        "id",
        F.col("customer_id").alias("customerId"),
        F.col("product_id").alias("productId"),
        "quantity",
        "amount",
        "currency",
        "status",
        F.col("payment_ref").alias("paymentReference"),
        F.col("created_at").alias("createdAt"),
    )


def availability(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Whether stock covers each request; an unknown product is unavailable.

    A plain left join, in which AQE splits the requests when one product dominates.
    """
    stock = products.select(F.col("id").alias("product_id"), "stock")
    return requests.join(stock, "product_id", "left").withColumn(
        "available", F.coalesce(F.col("stock") >= F.col("quantity"), F.lit(False))
    )
