"""Product and order tables, and report snapshots."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfline.schemas import ORDERS, PRODUCTS
from shelfline.session import file_exists, list_folders, remove_folder, replace_file, touch

POINTER = "CURRENT"
# In a version that the pointer has named. Readers of Parquet pass over the file.
PUBLISHED = "_PUBLISHED"
# For how long a version that the pointer has not named is kept: its writer may be about to.
KEPT_SECONDS = 3600


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCTS).parquet(path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(path)


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Parallel read of a database table, split by ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, **options)
        .options(lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
    )


def write_orders_by_month(orders: DataFrame, path: str, only_these: bool = False) -> None:
    """Month-partitioned copy of the fact table, for date-bounded reports to prune.

    Rows are dealt by month and, within it, by id: a large month is spread over
    tasks, a small one is not cut into a file per task. With ``only_these`` the
    months that occur in ``orders`` are replaced and the others stay. Read it
    back with :func:`read_orders_by_month`, whose ``since`` bound becomes a
    partition filter.
    """
    dealt = orders.withColumn("order_month", F.trunc("created_at", "MM")).repartitionByRange("order_month", F.xxhash64("id"))
    mode = "dynamic" if only_these else "static"
    dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("order_month").parquet(path)


def orders_with_month(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*ORDERS, T.StructField("order_month", T.DateType())])).parquet(path)


def read_orders_by_month(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    orders = orders_with_month(spark, path)
    if since is not None:
        orders = orders.where(F.col("order_month") >= F.trunc(F.lit(since).cast("date"), "MM"))
    return orders.drop("order_month")


def normalize_currency(df: DataFrame) -> DataFrame:
    """Drop the padding a fixed-width currency column leaves behind."""
    return df.withColumn("currency", F.rtrim("currency"))


def materialize_report(df: DataFrame, path: str, kept_seconds: float = KEPT_SECONDS) -> bool:
    """Store a report; an empty result keeps the previous snapshot. Returns whether it wrote.

    The result is written once, as a version of its own under ``path``; a small
    file that names the version is then replaced in one step, so readers find
    the old snapshot or the new one. The version before stays for readers that
    have begun; ones written before it go, but those that were not pointed to
    stay for ``kept_seconds``, as their writer may be about to. So of two writers
    at once the one that finishes last is read, and neither loses its version.
    """
    spark = df.sparkSession
    name = f"version-{time.time_ns()}-{uuid.uuid4().hex}"
    version = f"{path.rstrip('/')}/{name}"
    df.write.parquet(version)
    if spark.read.schema(df.schema).parquet(version).isEmpty():
        remove_folder(spark, version)
        return False
    before = _current(spark, path)
    spark.createDataFrame([(name,)], "version string").coalesce(1).write.text(f"{version}-pointer")
    replace_file(spark, f"{version}-pointer", f"{path.rstrip('/')}/{POINTER}")
    touch(spark, f"{version}/{PUBLISHED}")
    folders = [f for f in list_folders(spark, path) if f.startswith("version-") and before and _written(f) < _written(before)]
    stale = [f for f in folders if file_exists(spark, f"{path.rstrip('/')}/{f}/{PUBLISHED}") or is_old(f, kept_seconds)]
    current = _current(spark, path)  # may be another writer's by now
    for folder in stale:
        if folder != current:
            remove_folder(spark, f"{path.rstrip('/')}/{folder}")
    return True


def _written(version: str) -> int:
    return int(version.split("-")[1])


def is_old(version: str, seconds: float) -> bool:
    return time.time_ns() - _written(version) > seconds * 1e9


def _current(spark: SparkSession, path: str) -> str | None:
    pointer = f"{path.rstrip('/')}/{POINTER}"
    return spark.read.text(pointer).first().value if file_exists(spark, pointer) else None


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot that :func:`materialize_report` stored."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no report has been stored at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def has_report(spark: SparkSession, path: str) -> bool:
    return _current(spark, path) is not None


def materialize_reports(reports: dict[str, DataFrame], root: str) -> dict[str, bool]:
    """Store several reports; one that fails does not stop the others."""
    written: dict[str, bool] = {}
    failures: dict[str, Exception] = {}
    for name, report in reports.items():
        try:
            written[name] = materialize_report(report, f"{root}/{name}")
        except Exception as failure:  # noqa: BLE001 - reported below with its report name
            failures[name] = failure
    if failures:
        raise ExceptionGroup("reports not written: " + ", ".join(failures), list(failures.values()))
    return written
