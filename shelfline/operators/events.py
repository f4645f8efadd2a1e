"""Product and order events: encode, decode, route and count.

The same functions serve batch and streaming DataFrames, except
:func:`dead_letter`, whose streaming form is in ``shelfline.streaming``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfline.functions.text import STRICT_JSON
from shelfline.operators.filters import LOW_STOCK
from shelfline.schemas import EVENT_TYPES

# Fixed value: failed deliveries after which a message goes to the dead letters.
MAX_ATTEMPTS = 5

_WRITTEN = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_ENVELOPE = "eventType string, entityId string, payload string, malformed string"


def product_events(products: DataFrame, event_type: str) -> DataFrame:
    """One ``message`` per product; a deleted product carries a null payload."""
    payload = (
        F.lit(None).cast("string")
        if event_type == "PRODUCT_DELETED"
        else F.struct(
            F.struct(F.col("id").cast("string").alias("value")).alias("id"),
            "name",
            "description",
            F.struct(F.col("price").alias("amount"), "currency").alias("price"),
            F.struct(F.col("stock").alias("quantity"), (F.col("stock") == 0).alias("empty")).alias("stock"),
            "category",
            F.col("created_at").alias("createdAt"),
            (F.col("stock") < LOW_STOCK).alias("lowStock"),
        )
    )
    envelope = F.struct(F.lit(event_type).alias("eventType"), F.col("id").cast("string").alias("entityId"), payload.alias("payload"))
    return products.select(F.to_json(envelope, _WRITTEN).alias("message"))


def order_placed_events(orders: DataFrame) -> DataFrame:
    """One ``message`` per order; both ids are text."""
    placed = F.struct(F.col("id").cast("string").alias("orderId"), F.col("customer_id").cast("string").alias("customerId"), "status")
    return orders.select(F.to_json(placed, _WRITTEN).alias("message"))


def parse_events(raw: DataFrame) -> DataFrame:
    """Decode ``raw`` into type, entity and payload text; ``malformed`` marks what is no event object."""
    options = {**STRICT_JSON, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    event = F.from_json("raw", _ENVELOPE, options)
    broken = F.col("_event").isNull() | F.col("_event.malformed").isNotNull()
    return (
        raw.withColumn("_event", event)
        .withColumn("malformed", broken)
        .select(*raw.columns, "malformed", "_event.eventType", "_event.entityId", "_event.payload")
    )


def route_events(events: DataFrame) -> DataFrame:
    """Add ``outcome``: handled, unknown (accepted with a warning) or failed (to be delivered again)."""
    outcome = (
        F.when(F.col("malformed") | F.col("eventType").isNull(), "failed")
        .when(F.col("eventType").isin(*EVENT_TYPES), "handled")
        .otherwise("unknown")
    )
    return events.withColumn("outcome", outcome)


def acknowledged_once(routed: DataFrame, keep: str = "7 days") -> DataFrame:
    """``routed`` deliveries without the repeats of messages that were acknowledged before.

    Delivery is at least once: a message comes again if its acknowledgement is
    lost. A failed delivery is no repeat; each counts as an attempt. In a stream
    a message id is remembered for ``keep`` after its first arrival, as long as
    the source may deliver it again, and then leaves the state. Time is that of
    arrival, so no row comes too late to be looked at. Rows without a message id
    are kept.
    """
    named = F.col("message_id").isNotNull()
    taken = F.col("outcome") != "failed"
    acknowledged, others = routed.where(taken & named), routed.where(~taken | ~named)
    if not routed.isStreaming:
        return acknowledged.dropDuplicates(["message_id"]).unionByName(others)
    arrived = acknowledged.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep)
    return arrived.dropDuplicatesWithinWatermark(["message_id"]).drop("_arrived").unionByName(others)


def event_outcome_counts(events: DataFrame) -> DataFrame:
    """Messages per type and outcome, and whether they were acknowledged."""
    return (
        events.groupBy("eventType", "outcome")
        .agg(F.count(F.lit(1)).alias("messages"))
        .withColumn("acknowledged", F.col("outcome") != "failed")
    )


def delivery_counters(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row: deliveries ``processed``, ``acked``, ``nacked``, and messages ``dead_lettered``.

    Counting per message first gives all four in one pass.
    """
    failed = F.sum(F.when(F.col("outcome") == "failed", 1).otherwise(0))
    per_message = events.groupBy("message_id").agg(F.count(F.lit(1)).alias("_all"), failed.alias("_failed"))
    return per_message.agg(
        F.coalesce(F.sum("_all"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(F.col("_all") - F.col("_failed")), F.lit(0)).alias("acked"),
        F.coalesce(F.sum("_failed"), F.lit(0)).alias("nacked"),
        F.count(F.when(F.col("_failed") >= max_attempts, 1)).alias("dead_lettered"),
    )


def dead_letter(failed: DataFrame, max_attempts: int = MAX_ATTEMPTS, order: str = "raw") -> DataFrame:
    """Messages that failed ``max_attempts`` times or more, with their ``attempts`` and the ``raw`` text of the last by ``order``."""
    return (
        failed.groupBy("message_id")
        .agg(F.count(F.lit(1)).alias("attempts"), F.max_by("raw", order).alias("raw"))
        .where(F.col("attempts") >= max_attempts)
    )
