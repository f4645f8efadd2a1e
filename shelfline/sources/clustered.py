"""The fact table clustered by day and product together, in files of bounded size.

Orders are laid out along a curve that interleaves the bits of the day and of the
product's rank by category. A file then covers a short range of days and few
categories, and its row groups say so in their statistics, so that a report over
some days of one category skips most of them, as an index on both would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfline.operators.filters import since
from shelfline.operators.paging import row_positions

ROWS_PER_FILE = 4_000_000
# Bits of each of the two coordinates.
BITS = 16
_RANKS, _ROWS = "ranks", "rows"
RANK = "product_rank"


def interleaved(x: Column, y: Column, bits: int = BITS) -> Column:
    """The lowest ``bits`` of both numbers, alternately, from those of ``x`` at the odd places."""
    place = F.lit(0).cast("bigint")
    for n in range(bits):
        for offset, number in ((1, x), (0, y)):
            bit = F.shiftright(number.cast("bigint"), n).bitwiseAND(F.lit(1).cast("bigint"))
            place = place.bitwiseOR(F.shiftleft(bit, 2 * n + offset))
    return place


def _scaled(value: Column, least: Column, most: Column) -> Column:
    """A number between ``least`` and ``most`` as one between 0 and ``2 ** BITS - 1``."""
    return F.coalesce(F.floor((value - least) * F.lit((1 << BITS) - 1) / F.greatest(most - least, F.lit(1))), F.lit(0)).cast("bigint")


def write_clustered(
    orders: DataFrame, products: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, row_group_bytes: int = 16 << 20
) -> None:
    """Store ``orders`` clustered, and the products' ranks.

    Files are ranges of the curve and, where many orders of one product fall on one
    day, of a hash of the order's id, so a hot product is spread over files. Orders of
    products that don't exist have rank -1, those without a date are put first.
    """
    spark = orders.sparkSession
    ranks = row_positions(products, "category", "id").join(products.select("id", "category"), "id")
    ranks.select(F.col("id").alias("product_id"), "category", F.col("position").cast("bigint").alias(RANK)).write.parquet(f"{path}/{_RANKS}")
    ranks = spark.read.parquet(f"{path}/{_RANKS}")
    day = F.unix_date(F.to_date("created_at"))
    facts = orders.agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first"), F.max(day).alias("last")).first()
    most = ranks.agg(F.max(RANK)).first()[0] or 0
    # The fact side can be split if one product dominates.
    ranked = orders.join(ranks.drop("category"), "product_id", "left").withColumn(RANK, F.coalesce(RANK, F.lit(-1).cast("bigint")))
    days = _scaled(day, F.lit(facts.first or 0), F.lit(facts.last or 0))
    curve = interleaved(days, _scaled(F.greatest(F.col(RANK), F.lit(0)), F.lit(0), F.lit(most)))
    files = max(-(-facts.n // rows_per_file), 1)
    placed = ranked.withColumn("_curve", curve).withColumn("_spread", F.xxhash64("id"))
    placed = placed.repartitionByRange(files, "_curve", "_spread").sortWithinPartitions("_curve", "_spread")
    placed.drop("_curve", "_spread").select(*orders.columns, RANK).write.option("parquet.block.size", row_group_bytes).parquet(f"{path}/{_ROWS}")


def read_clustered(
    spark: SparkSession, path: str, as_of: str | None = None, days: int | None = None, category: str | None = None
) -> DataFrame:
    """The stored orders no older than ``days`` before ``as_of`` and of one ``category`` as it was when they were stored.

    Both bounds reach the scan: the time as it is, the category as the range of its
    products' ranks.
    """
    rows = spark.read.parquet(f"{path}/{_ROWS}")
    if as_of is not None and days is not None:
        rows = since(rows, as_of, days)
    if category is not None:
        ranks = spark.read.parquet(f"{path}/{_RANKS}").where(F.col("category") == category)
        bounds = ranks.agg(F.min(RANK).alias("low"), F.max(RANK).alias("high")).first()
        rows = rows.where(F.lit(False) if bounds.low is None else F.col(RANK).between(bounds.low, bounds.high))
    return rows.drop(RANK)
