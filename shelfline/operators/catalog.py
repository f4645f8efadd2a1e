"""Bulk create, update and delete of products, with a reject row for every refused request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfline.functions.money import to_money
from shelfline.functions.rules import Split, product_request_rules, split_by_rules
from shelfline.functions.text import stable_uuid

NOT_FOUND = "Product not found"
HAS_ORDERS = "Product has orders"


def create_products(requests: DataFrame, created_at: str) -> Split:
    """Products for all valid requests, priced in USD; the id derives from the request id."""
    valid, rejects = split_by_rules(requests, product_request_rules())
    products = valid.select(
        stable_uuid(F.lit("product"), F.col("request_id")).alias("id"),
        "name",
        "description",
        to_money(F.col("price")).alias("price"),
        F.lit("USD").alias("currency"),
        "stock",
        "category",
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.lit(0).cast("bigint").alias("version"),
    )
    return Split(products, rejects)


def update_products(products: DataFrame, requests: DataFrame) -> Split:
    """The product table after all valid updates, later ones winning; and the refused requests.

    ``requests`` is the create layout plus the product ``id``. Only the last
    request of a product matters, and each map task keeps one per product
    before the shuffle.
    """
    valid, rejects = split_by_rules(requests, product_request_rules())
    latest = Window.partitionBy("id").orderBy(F.col("seq").desc(), F.col("request_id").desc())
    changes = (
        valid.withColumn("_nth", F.row_number().over(latest))
        .where(F.col("_nth") == 1)
        .select(
            "id",
            F.struct("name", "description", to_money(F.col("price")).alias("price"), "stock", "category").alias("_new"),
        )
    )
    changed = ("name", "description", "price", "stock", "category")
    updated = products.join(changes, "id", "left").select(
        *[
            F.coalesce(F.col(f"_new.{name}"), products[name]).alias(name) if name in changed else products[name]
            for name in products.columns
        ]
    )
    missing = valid.join(products.select("id"), "id", "left_anti").withColumn("reasons", F.array(F.lit(NOT_FOUND)))
    return Split(updated, rejects.unionByName(missing))


def delete_products(products: DataFrame, requests: DataFrame, orders: DataFrame | None = None) -> Split:
    """The product table without the requested ids, and the requests that found nothing.

    The first request for an id deletes it, so a repeated one finds nothing.
    The first is found by aggregation, not by ordering all requests of an id.
    With ``orders`` a product that has some is not deleted, and all requests
    for it are refused.
    """
    if orders is not None:
        ordered = orders.select(F.col("product_id").alias("id")).distinct()
        bound = requests.join(products.join(ordered, "id", "left_semi").select("id"), "id", "left_semi")
        free = delete_products(products, requests.join(bound.select("id").distinct(), "id", "left_anti"))
        refused = bound.select(*requests.columns, F.array(F.lit(HAS_ORDERS)).alias("reasons"))
        return Split(free.accepted, free.rejects.unionByName(refused))
    kept = products.join(requests.select("id").distinct(), "id", "left_anti").select(products.columns)
    first = requests.groupBy("id").agg(F.min(F.struct("seq", "request_id")).alias("_first"))
    effective = first.join(products.select("id"), "id", "left_semi").select("id", "_first.seq", "_first.request_id")
    # Matching on all three columns spreads the requests of one id over the tasks.
    rejects = requests.join(effective, ["id", "seq", "request_id"], "left_anti").select(
        *requests.columns, F.array(F.lit(NOT_FOUND)).alias("reasons")
    )
    return Split(kept, rejects)


def stock_adjustments(before: DataFrame, after: DataFrame) -> DataFrame:
    """How far an update moved each product's stock: ``direction`` and the absolute ``units``."""
    moved = F.col("_after") - F.col("stock")
    return (
        before.select("id", "stock")
        .join(after.select("id", F.col("stock").alias("_after")), "id")
        .where(moved != 0)
        .select("id", F.when(moved > 0, "INCREASE").otherwise("DECREASE").alias("direction"), F.abs(moved).alias("units"))
    )
