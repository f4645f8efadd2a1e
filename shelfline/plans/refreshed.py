"""Reports kept up to date by increments: only months whose files changed are aggregated again.

For every month of the fact table, as ``write_orders_by_month`` lays it out, two
partial aggregates are stored: per product, and per customer and product. Sums,
counts and extremes merge, so a report over all months is a merge of partials. A
manifest names for each month the digest of the files it was made from and where
its partials are. A refresh compares digests, which takes a listing and no data,
aggregates what differs into folders of its own, and replaces the manifest in one
step: a refresh that is interrupted leaves the old state, one that is repeated
finds nothing to do.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfline.operators.filters import confirmed
from shelfline.plans.reports import ranked_sales, revenue_growth, summed_customers
from shelfline.schemas import WIDE_MONEY
from shelfline.session import file_exists, list_folders, remove_folder
from shelfline.sources.tables import KEPT_SECONDS, has_report, is_old, materialize_report, orders_with_month, read_report

BY_PRODUCT, BY_CUSTOMER = "by_product", "by_customer"
_MONEY = WIDE_MONEY.simpleString()
SCHEMAS = {
    BY_PRODUCT: f"product_id string, total_orders bigint, total_revenue {_MONEY}, order_month date",
    BY_CUSTOMER: f"customer_id string, product_id string, orders bigint, spent {_MONEY}, first timestamp, last timestamp, order_month date",
}
# In the manifest, in place of a month: keeps the manifest of an empty table from being empty itself.
_NO_MONTH = ""
# Folder of the orders without a date.
_UNDATED = "__HIVE_DEFAULT_PARTITION__"


class Refresh(NamedTuple):
    changed: list[str]
    removed: list[str]


def month_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """For each month a digest of the paths, sizes and times of its files; the files are listed and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    digest = F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")))
    month = F.regexp_extract("path", "/order_month=([^/]*)/", 1)
    # One row per calendar month.
    return {r.month: r.digest for r in files.groupBy(month.alias("month")).agg(digest.alias("digest")).collect()}


def _month() -> Column:
    """The month as its folder is called."""
    return F.coalesce(F.col("order_month").cast("string"), F.lit(_UNDATED))


def _manifest(spark: SparkSession, store: str) -> dict[str, tuple[str, str | None]]:
    if not has_report(spark, f"{store}/manifest"):
        return {}
    return {r.month: (r.digest, r.folder) for r in read_report(spark, f"{store}/manifest").collect() if r.month != _NO_MONTH}


def changed_orders(spark: SparkSession, orders_path: str, months: list[str]) -> DataFrame:
    """The orders of ``months``; a partition filter, so other months are not opened."""
    return orders_with_month(spark, orders_path).where(_month().isin(months))


def refresh(spark: SparkSession, orders_path: str, store: str, kept_seconds: float = KEPT_SECONDS) -> Refresh:
    """Bring the partials in ``store`` up to date with the orders at ``orders_path``; tells which months it aggregated."""
    now, kept = month_digests(spark, orders_path), _manifest(spark, store)
    changed = sorted(m for m, digest in now.items() if m not in kept or kept[m][0] != digest)
    removed = sorted(kept.keys() - now.keys())
    if not changed and not removed:
        return Refresh([], [])
    folder = f"refresh-{time.time_ns()}-{uuid.uuid4().hex}"
    held: set[str] = set()
    if changed:
        _aggregate(spark, changed_orders(spark, orders_path, changed), store, folder)
        held = {name.partition("=")[2] for name in list_folders(spark, f"{store}/{BY_PRODUCT}/{folder}")}
    # A month without confirmed orders has no partials.
    entries = {m: (now[m], kept[m][1]) for m in now if m not in changed} | {m: (now[m], folder if m in held else None) for m in changed}
    rows = [(_NO_MONTH, None, None), *((m, *entry) for m, entry in entries.items())]
    materialize_report(spark.createDataFrame(rows, "month string, digest string, folder string").coalesce(1), f"{store}/manifest", kept_seconds)
    used = {f for _, f in entries.values()} | {f for _, f in kept.values()}
    for kind in SCHEMAS:
        for old in list_folders(spark, f"{store}/{kind}") if file_exists(spark, f"{store}/{kind}") else []:
            if old not in used and is_old(old, kept_seconds):
                remove_folder(spark, f"{store}/{kind}/{old}")
    return Refresh(changed, removed)


def _aggregate(spark: SparkSession, orders: DataFrame, store: str, folder: str) -> None:
    """Write both partials; the facts are read for the finer one, which gives the other."""
    finer = (
        confirmed(orders)
        .groupBy("order_month", "customer_id", "product_id")
        .agg(
            F.count("id").alias("orders"),
            F.sum("amount").cast(WIDE_MONEY).alias("spent"),
            F.min("created_at").alias("first"),
            F.max("created_at").alias("last"),
        )
    )
    _write(finer, "customer_id", f"{store}/{BY_CUSTOMER}/{folder}")
    finer = spark.read.schema(SCHEMAS[BY_CUSTOMER]).parquet(f"{store}/{BY_CUSTOMER}/{folder}")
    coarser = finer.groupBy("order_month", "product_id").agg(
        F.sum("orders").alias("total_orders"), F.sum("spent").cast(WIDE_MONEY).alias("total_revenue")
    )
    _write(coarser, "product_id", f"{store}/{BY_PRODUCT}/{folder}")


def _write(partials: DataFrame, key: str, path: str) -> None:
    partials.repartitionByRange("order_month", F.xxhash64(key)).write.partitionBy("order_month").parquet(path)


def partials(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """The stored partials of all months, each from the folder that the manifest names."""
    months: dict[str, list[str]] = {}
    for month, (_, folder) in _manifest(spark, store).items():
        if folder:
            months.setdefault(folder, []).append(month)
    rows = spark.createDataFrame([], SCHEMAS[kind])
    for folder, named in months.items():  # one for each refresh that is still in use
        base = f"{store}/{kind}/{folder}"
        paths = [f"{base}/order_month={month}" for month in named]
        rows = rows.unionByName(spark.read.schema(SCHEMAS[kind]).option("basePath", base).parquet(*paths))
    return rows


def refreshed_revenue_trend(spark: SparkSession, store: str, fill_gaps: bool = True) -> DataFrame:
    """``monthly_revenue_trend`` from the partials."""
    monthly = partials(spark, store, BY_PRODUCT).groupBy(F.col("order_month").alias("month_start"))
    return revenue_growth(monthly.agg(F.sum("total_revenue").cast(WIDE_MONEY).alias("total_revenue")), fill_gaps)


def refreshed_top_products(spark: SparkSession, store: str, products: DataFrame, k: int = 5) -> DataFrame:
    """``top_products_by_category`` from the partials."""
    sales = partials(spark, store, BY_PRODUCT).groupBy("product_id")
    sales = sales.agg(F.sum("total_orders").alias("total_orders"), F.sum("total_revenue").cast(WIDE_MONEY).alias("total_revenue"))
    return ranked_sales(products, sales, k)


def refreshed_customer_summary(spark: SparkSession, store: str, products: DataFrame) -> DataFrame:
    """``customer_order_summary`` from the partials; a product's category is the present one."""
    bought = partials(spark, store, BY_CUSTOMER).join(products.select(F.col("id").alias("product_id"), "category"), "product_id")
    return summed_customers(
        bought.groupBy("customer_id", "category").agg(
            F.sum("orders").alias("_orders"),
            F.sum("spent").cast(WIDE_MONEY).alias("_spent"),
            F.min("first").alias("_first"),
            F.max("last").alias("_last"),
        )
    )
