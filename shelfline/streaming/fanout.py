"""What follows a placed order: a confirmation and an event, independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfline.operators.events import order_placed_events
from shelfline.operators.notifications import order_confirmations


def post_order_fanout(orders: DataFrame, out: str, checkpoint: str, **trigger) -> dict[str, StreamingQuery]:
    """Start one query per follow-up on the order stream.

    Each has its own progress and sink, so one that fails neither stops nor
    repeats the other, and resumes where it stood.
    """
    follow_ups = {"confirmations": order_confirmations(orders), "events": order_placed_events(orders)}
    return {
        name: rows.writeStream.format("parquet")
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(**(trigger or {"availableNow": True}))
        .start(f"{out}/{name}")
        for name, rows in follow_ups.items()
    }
