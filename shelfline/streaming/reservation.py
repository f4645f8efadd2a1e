"""Stock reservation over a request stream, with a counter per product as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from shelfline.operators.ordered import CHUNK_ROWS
from shelfline.operators.reservation import (
    INSUFFICIENT,
    INVALID_OPERATION,
    INVALID_QUANTITY,
    RELEASED,
    RESERVED,
    remaining_stock,
    reserve_stock,
)
from shelfline.session import durable, remove_folder
from shelfline.streaming.reorder import BUCKETS, LEAF_ROWS, Reordered, bucketed, opening_values, packed, timed, unpacked

SYNCED = "SYNCED"
LATE = "LATE"

_COLUMNS = ("request_id", "seq", "quantity", "op")


def decide(op: str, quantity: int | None, left: int | None) -> tuple[str, int | None]:
    """Outcome of one request and the stock left after it; ``left`` is None for an unknown product."""
    if op == "SYNC" and quantity is not None and quantity >= 0:
        return SYNCED, quantity
    if quantity is None or quantity < 1:
        return INVALID_QUANTITY, left
    if op == "RELEASE":
        return RELEASED, None if left is None else left + quantity
    if op != "RESERVE":
        return INVALID_OPERATION, left
    if left is None or left < quantity:
        return INSUFFICIENT, left
    return RESERVED, left - quantity


def decide_all(left: dict, requests: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of ``requests``, in their order; brings the stock ``left`` of their products up to date."""
    outcomes, remaining = [], []
    for product, op, quantity in zip(requests["key"], requests["op"], requests["quantity"]):
        units = None if pd.isna(quantity) else int(quantity)
        outcome, now = decide(op, units, left.get(product))
        if now is not None:
            left[product] = now
        outcomes.append(outcome)
        remaining.append(None if outcome in (INVALID_QUANTITY, INVALID_OPERATION) else now)
    result = requests[[*_COLUMNS, "key"]].assign(outcome=outcomes)
    return result.assign(remaining=pd.array(remaining, dtype="Int64"))


class _Counters(StatefulProcessor):
    """Counters of a bucket of products."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "left binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        left = self._load()
        for product, stock in opening_values(initialState):
            left.setdefault(product, stock)
        self._save(left)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        left = self._load()
        result = decide_all(left, batch)
        self._save(left)
        yield result

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        if not self.counters.exists():
            return {}
        return dict(zip(*(c.to_pylist() for c in unpacked(self.counters.get()[0]).columns)))

    def _save(self, left: dict) -> None:
        self.counters.update((packed(pa.table({"key": list(left), "left": list(left.values())})),))


class _Stock:
    """The fold of :func:`reserve_stock_reordered`: stock left."""

    def take(self, values: dict, rows: pd.DataFrame) -> pd.DataFrame:
        return decide_all(values, rows)

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[[*_COLUMNS, "key"]].assign(outcome=LATE, remaining=pd.array([None] * len(rows), dtype="Int64"))


def _output(requests: DataFrame) -> str:
    request_kind = requests.schema["request_id"].dataType.simpleString()
    return f"request_id {request_kind}, seq bigint, quantity int, op string, key string, outcome string, remaining bigint"


def _named(outcomes: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcomes with the product under its own name and type."""
    product = F.col("key").cast(requests.schema["product_id"].dataType).alias("product_id")
    return outcomes.select(*_COLUMNS, product, "outcome", "remaining")


def _opening(requests: DataFrame, products: DataFrame, buckets: int):
    product = F.col("id").cast(requests.schema["product_id"].dataType)
    return products.select(*bucketed(product, buckets), F.col("stock").cast("bigint").alias("value")).groupBy("bucket")


def reserve_stock_stream(requests: DataFrame, products: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Outcome per request, in ``seq`` order within each micro-batch.

    Counters start from the product table; a SYNC request overwrites one with
    its ``quantity``. They are kept by bucket of products; a stream can't go on
    with another number of ``buckets``. The requests of a bucket in one micro-batch
    are sorted in its task, so bound the batch at the source
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). For large batches with hot
    products use :func:`reserve_stock_batches`, which splits them. Start the query
    inside ``streaming.state.stateful``.
    """
    outcomes = (
        requests.select(*bucketed("product_id", buckets), *_COLUMNS)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_Counters(),
            outputStructType=_output(requests),
            outputMode="Append",
            timeMode="None",
            initialState=_opening(requests, products, buckets),
        )
    )
    return _named(outcomes, requests)


def reserve_stock_reordered(
    requests: DataFrame, products: DataFrame, delay: str = "1 minute", leaf_rows: int = LEAF_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """Outcome per request, in ``seq`` order across micro-batches, for requests that may come up to ``delay`` late.

    ``requests`` also has ``at``, the time of the request. Each waits until the
    watermark, ``delay`` behind the latest ``at``, has passed its time and that of
    the requests before it. One that comes after a later request of its product
    was decided moves no stock and has outcome LATE; ``where outcome = 'LATE'``
    is the side output. The last requests wait until later ones come. State is
    kept by bucket of products; a stream can't go on with another number of
    ``buckets``. Start the query inside ``streaming.state.stateful``.
    """
    outcomes = (
        timed(requests, "at", delay, *bucketed("product_id", buckets), *_COLUMNS)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=Reordered(_Stock(), leaf_rows, by="key"),
            outputStructType=_output(requests),
            outputMode="Append",
            timeMode="EventTime",
            initialState=_opening(requests, products, buckets),
        )
    )
    return _named(outcomes, requests)


def reserve_stock_batches(
    requests: DataFrame, products: DataFrame, out: str, checkpoint: str, chunk_rows: int = CHUNK_ROWS
) -> DataStreamWriter:
    """Run the batch operator on every micro-batch, hot products cut into chunks.

    Batch ``n`` reads the stock left by batch ``n - 1`` and owns the folders
    ``outcomes/batch_id=n`` and ``stock/batch_id=n`` under ``out``, which it
    replaces when it is run again; stock that no later run needs is removed. It writes the whole (id, stock) table each
    time, so it suits large batches; the counter state suits small ones.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = durable(batch)  # read by several passes
        before = products.select("id", "stock")
        if batch_id > 0:
            before = spark.read.schema(before.schema).parquet(f"{out}/stock/batch_id={batch_id - 1}")
        outcomes = durable(reserve_stock(before, batch, chunk_rows))
        outcomes.write.mode("overwrite").parquet(f"{out}/outcomes/batch_id={batch_id}")
        remaining_stock(before, outcomes).write.mode("overwrite").parquet(f"{out}/stock/batch_id={batch_id}")
        if batch_id > 1:  # a batch that runs again reads the stock of the one before
            remove_folder(spark, f"{out}/stock/batch_id={batch_id - 2}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
