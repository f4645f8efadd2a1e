"""Ordered work within a key when one key may hold a large share of all rows.

A key with more than ``chunk_rows`` rows is cut along its sequence number into
chunks of about that many rows; every other key is one chunk. Work then runs per
(key, chunk), and a table with one row per chunk carries what a chunk needs from
those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfline.session import durable, small_side, written

CHUNK_ROWS = 1_000_000


def key_sizes(df: DataFrame, key: str, *extra) -> DataFrame:
    """Rows of each key, plus further aggregates, in one pass."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *extra)


def hot_keys(sizes: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """The keys to be cut with their ``_rows``: fewer than all rows / chunk_rows."""
    return sizes.where(F.col("_rows") > chunk_rows).select(key, "_rows")


def cut_rows(df: DataFrame, key: str, seq: str, hot: DataFrame, chunk_rows: int) -> DataFrame:
    """The rows of the ``hot`` keys with the ``chunk`` each is in, stored.

    The rows are range-partitioned by key and sequence number, so a chunk is cut
    by rows wherever they crowd. Its number is that of its partition, which is
    fixed by storing it; along a key the numbers ascend.
    """
    total = hot.agg(F.sum("_rows")).first()[0] or 0
    parts = max(-(-total // chunk_rows), 1)
    rows = df.join(small_side(hot.select(key)), key, "left_semi").repartitionByRange(parts, key, seq)
    return written(rows.withColumn("chunk", F.spark_partition_id().cast("bigint")), "chunks")


def with_previous(df: DataFrame, key: str, seq: str, value: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``LAG(value)`` per key by ``seq``, without one task per hot key.

    Inside a chunk it is a plain window. The first row of a later chunk takes
    the last value of the chunk before it, from a table with one row per chunk.
    """
    hot = durable(hot_keys(key_sizes(df, key), key, chunk_rows))
    if hot.isEmpty():
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(seq)))
    calm = df.join(hot.select(key), key, "left_anti")
    cut = cut_rows(df, key, seq, hot, chunk_rows)
    within = Window.partitionBy(key, "chunk").orderBy(seq)
    edges = cut.groupBy(key, "chunk").agg(F.max_by(F.struct(value), F.col(seq)).alias("_edge"))
    carried = edges.select(key, "chunk", F.lag("_edge").over(Window.partitionBy(key).orderBy("chunk")).alias("_carried"))
    lagged = (
        cut.withColumn("_position", F.row_number().over(within))
        .withColumn("_lag", F.lag(value).over(within))
        .join(carried, [key, "chunk"], "left")
        .withColumn(name, F.when(F.col("_position") == 1, F.col(f"_carried.{value}")).otherwise(F.col("_lag")))
        .drop("chunk", "_position", "_lag", "_carried")
    )
    return calm.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(seq))).unionByName(lagged)


def with_next(df: DataFrame, key: str, seq: str, value: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The first ``value`` that is not null after each row of its key by ``seq``, without one task per hot key."""
    hot = durable(hot_keys(key_sizes(df, key), key, chunk_rows))

    def ahead(*keys: str):
        # Read backward, so that the frame only grows.
        back = Window.partitionBy(*keys).orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(value, ignorenulls=True).over(back)

    if hot.isEmpty():
        return df.withColumn(name, ahead(key))
    calm = df.join(hot.select(key), key, "left_anti")
    cut = cut_rows(df, key, seq, hot, chunk_rows)
    edges = cut.where(F.col(value).isNotNull()).groupBy(key, "chunk").agg(F.min_by(value, seq).alias("_edge"))
    every = cut.select(key, "chunk").distinct().join(edges, [key, "chunk"], "left")
    later = Window.partitionBy(key).orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(key, "chunk", F.last("_edge", ignorenulls=True).over(later).alias("_carried"))
    followed = cut.withColumn("_inside", ahead(key, "chunk")).join(carried, [key, "chunk"], "left")
    found = followed.withColumn(name, F.coalesce("_inside", "_carried")).drop("chunk", "_inside", "_carried")
    return calm.withColumn(name, ahead(key)).unionByName(found)
