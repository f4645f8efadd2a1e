"""Pages of a sorted table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfline.session import durable

# Offsets up to this many rows are served by a per-task top-n, which holds that many rows.
SHALLOW_ROWS = 100_000
# Bounds drawn in each step towards a deeper page.
BOUNDS = 63


class Page(NamedTuple):
    rows: DataFrame
    total: int


def page_rows(
    df: DataFrame, page: int, size: int = 20, sort: str = "created_at", key: str = "id", shallow_rows: int = SHALLOW_ROWS
) -> DataFrame:
    """Slice ``page`` (from 0) by ``sort`` ascending, ties broken by ``key`` and then by the other columns; empty past the end.

    A page further in than ``shallow_rows`` is approached by counting: drawn
    bounds cut the order into cells, the rows of each are counted, and the cell
    in which the page starts is cut again until it starts near its beginning.
    Rows are filtered by place in the order, so repeated and null keys count as
    what they are. ``df`` is read three times, the first two for sort and key
    alone; its rows from the first cell are kept and cut further by themselves.
    Only the rows from the last cell on are sorted, for a top-n.
    """
    start = page * size
    others = [c for c in df.columns if c not in (sort, key)]
    first = [_plain(df, sort).alias("s"), _plain(df, key).alias("k")]
    whole = F.struct(*first, (F.xxhash64(*others) if others else F.lit(0)).alias("h"))
    placed, rows = df.withColumn("_place", F.struct(*first)), None
    while start + size > shallow_rows:
        kind = placed.schema["_place"].dataType
        # Rows are drawn, not places: one that very many rows have is a bound, and a cell of its own.
        drawn = placed.select("_place").orderBy(F.rand(7)).limit(BOUNDS).agg(F.sort_array(F.collect_set("_place"))).first()[0]
        bounds = [_literal(row, kind) for row in drawn]
        if not bounds:
            break
        # Cell 2 n lies before bound n, cell 2 n + 1 is bound n.
        known = F.array(*bounds)
        cell = 2 * F.size(F.filter(known, lambda bound: bound < F.col("_place"))) + F.array_contains(known, F.col("_place")).cast("int")
        counts = sorted((r.cell, r.n) for r in placed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
        total, before, wanted = sum(n for _, n in counts), 0, []
        for number, n in counts:  # one for each cell
            if before + n > start and before < start + size:
                wanted.append(number)
            elif not wanted:
                start, before = start - n, before - n
            before += n
        if not wanted:
            return df.limit(0)
        if total == rows:
            break  # all alike
        low, high = (bounds[n // 2] if n // 2 < len(bounds) else None for n in (wanted[0] - 1, wanted[-1]))
        if wanted[0] > 0:
            placed = placed.where(F.col("_place") > low if wanted[0] % 2 == 0 else F.col("_place") >= low)
        if high is not None:
            placed = placed.where(F.col("_place") < high if wanted[-1] % 2 == 0 else F.col("_place") <= high)
        if rows is None:
            placed = durable(placed.drop("_place")).withColumn("_place", whole)
        rows = total
    else:
        placed = placed.withColumn("_place", whole)
    return placed.orderBy("_place").offset(start).limit(size).drop("_place")


def _plain(df: DataFrame, name: str) -> Column:
    """The column, instants as numbers."""
    return F.unix_micros(F.col(name)) if isinstance(df.schema[name].dataType, T.TimestampType) else F.col(name)


def _literal(place, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(place[f.name]).cast(f.dataType).alias(f.name) for f in kind])


def page(df: DataFrame, page: int, size: int = 20, sort: str = "created_at", key: str = "id") -> Page:
    return Page(page_rows(df, page, size, sort, key), df.count())


def row_positions(df: DataFrame, sort: str, key: str) -> DataFrame:
    """1-based ``position`` of every key in the sort order, without a single-task window.

    The keys are range-partitioned and pinned, so that the partition number
    can serve as an identifier; positions count within a partition and add up
    the (few) partition totals before it.
    """
    placed = durable(
        df.select(key, sort).repartitionByRange(F.col(sort), F.col(key)).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(sort, key))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("position", F.col("_before") + inside)
        .select(key, "position")
    )
