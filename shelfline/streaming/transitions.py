"""Checks of order life cycles over a stream of status changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfline.operators.ordering import STATUS_STEPS
from shelfline.streaming.reorder import BUCKETS, LEAF_ROWS, Reordered, bucketed, timed

_STEPS = frozenset(STATUS_STEPS)


def allowed(before: str | None, after: str | None) -> bool:
    return after == "FAILED" or (before is None and after == "PENDING") or (before, after) in _STEPS


class _Status:
    """The fold: the status so far."""

    def take(self, values: dict, rows: pd.DataFrame) -> pd.DataFrame:
        before, forbidden = [], []
        for order, status in zip(rows["key"], rows["status"]):
            after = None if pd.isna(status) else status
            before.append(values.get(order))
            forbidden.append(not allowed(before[-1], after))
            values[order] = after
        return self._rows(rows, before, False)[forbidden]

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        return self._rows(rows, None, True)

    def _rows(self, rows: pd.DataFrame, before, late: bool) -> pd.DataFrame:
        return rows[["key", "seq", "status"]].assign(previous_status=before, late=late)


def check_order_transitions_stream(
    history: DataFrame, delay: str = "1 minute", leaf_rows: int = LEAF_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """Status changes that the life cycle forbids, as ``operators.ordering.check_order_transitions`` finds them.

    ``history`` also has ``at``. Changes of one order may come in any order up to
    ``delay`` late; those that come after a later one was checked are returned
    unchecked with ``late``. State is kept by bucket of orders; a stream can't go on
    with another number of ``buckets``. Start the query inside
    ``streaming.state.stateful``.
    """
    found = (
        timed(history, "at", delay, *bucketed("order_id", buckets), "seq", "status")
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=Reordered(_Status(), leaf_rows, by="key"),
            outputStructType="key string, seq bigint, status string, previous_status string, late boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    order = F.col("key").cast(history.schema["order_id"].dataType).alias("order_id")
    return found.select(order, "seq", "status", "previous_status", "late")
