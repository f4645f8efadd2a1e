"""A table stored in page order, with an index of how many rows each file holds.

A page then needs no counting and no sort of more than its own rows: the index names
the one or two files in which it lies and the rows' numbers there, and a filter on
that range of numbers leaves the other row groups of these files unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ROWS_PER_FILE = 4_000_000
_INDEX, _ROWS = "index", "rows"
# The row number within its task, of which monotonically_increasing_id holds the task in the bits above.
_IN_TASK = (1 << 33) - 1


def write_ordered(
    df: DataFrame, path: str, sort: str = "created_at", key: str = "id", rows_per_file: int = ROWS_PER_FILE, row_group_bytes: int = 8 << 20
) -> None:
    """Store ``df`` by ``sort`` ascending, ties by ``key`` and then by a hash of the other columns, and its index.

    One range shuffle and a sort within each file. Rows that agree in all columns
    have one place in the order and so lie in one file.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c not in (sort, key)]
    place = [sort, key, "_hash"]
    files = max(-(-df.count() // rows_per_file), 1)
    ordered = (
        df.withColumn("_hash", F.xxhash64(*others) if others else F.lit(0).cast("bigint"))
        .repartitionByRange(files, *place)
        .sortWithinPartitions(*place)
        .withColumn("_file", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)))
        .drop("_hash")
    )
    ordered.write.option("parquet.block.size", row_group_bytes).parquet(f"{path}/{_ROWS}")
    stored = spark.read.schema(ordered.schema).parquet(f"{path}/{_ROWS}")
    # One row per file from here on.
    sizes = stored.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.min("_metadata.file_path").alias("place"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("before", before).coalesce(1).write.parquet(f"{path}/{_INDEX}")


def _stored(spark: SparkSession, path: str, *files: str) -> DataFrame:
    whole = spark.read.parquet(f"{path}/{_ROWS}")
    return spark.read.schema(whole.schema).parquet(*files) if files else whole


def read_page(spark: SparkSession, path: str, page: int, size: int = 20) -> DataFrame:
    """Slice ``page`` (from 0) of a table that :func:`write_ordered` stored, in order; empty past the end."""
    start = page * size
    index = spark.read.parquet(f"{path}/{_INDEX}")
    # A page spans few files: as many as have fewer rows than it has.
    hits = index.where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).orderBy("_file").collect()
    if not hits:
        return _stored(spark, path).drop("_file", "_row").limit(0)
    # The numbers count within a file; files between the first and the last are taken whole.
    wanted = F.lit(False)
    for hit in hits:
        lowest, highest = max(start - hit.before, 0), min(start + size - hit.before, hit.n) - 1
        wanted = wanted | ((F.col("_file") == hit["_file"]) & F.col("_row").between(lowest, highest))
    return _stored(spark, path, *(hit.place for hit in hits)).where(wanted).orderBy("_file", "_row").drop("_file", "_row")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their ``position`` in the order, from 0."""
    offsets = spark.read.parquet(f"{path}/{_INDEX}").select("_file", "before")
    rows = _stored(spark, path).join(offsets, "_file")
    return rows.withColumn("position", F.col("before") + F.col("_row")).drop("_file", "_row", "before")


def page_total(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/{_INDEX}").agg(F.sum("n")).first()[0] or 0
