"""Top-k with ties that stays distributed however many rows tie."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k_with_ties(
    df: DataFrame, by: Sequence[str], scores: Sequence[str], k: int, rank: str, row: Column | None = None
) -> DataFrame:
    """Rows whose ``RANK()`` over ``scores`` descending, per ``by``, is at most ``k``.

    Ranking the rows themselves would send a whole group, with all its ties,
    through one task. Only the ``k`` best distinct scores of a group can hold
    ranks up to ``k``, so those are found first: each map task keeps ``k`` of
    them (``WindowGroupLimit``), and the rank of a score is one plus the rows
    above it. The rows then pick up their rank by an equality join.

    ``df`` is thus used twice. Where it is an aggregate, give as ``row`` an
    expression over its other results that is never null: rows are counted by
    it, both uses need the same columns, and Spark runs the aggregate once.
    """
    order = [F.col(name).desc_nulls_first() for name in scores]
    keys = [*by, *scores]
    distinct = df.groupBy(*keys).agg(F.count(F.lit(1) if row is None else row).alias("_rows"))
    group = Window.partitionBy(*by).orderBy(*order)
    best = distinct.withColumn("_position", F.row_number().over(group)).where(F.col("_position") <= k)
    above = F.sum("_rows").over(group.rowsBetween(Window.unboundedPreceding, -1))
    ranked = (
        best.withColumn(rank, (F.coalesce(above, F.lit(0)) + 1).cast("int"))
        .where(F.col(rank) <= k)
        .select(*[F.col(name).alias(f"_{name}") for name in keys], rank)
    )
    if not by:
        ranked = F.broadcast(ranked)  # at most k rows
    same = reduce(lambda left, right: left & right, [df[name].eqNullSafe(ranked[f"_{name}"]) for name in keys])
    return df.join(ranked, same).select(*df.columns, rank)
