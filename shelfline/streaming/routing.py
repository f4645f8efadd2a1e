"""Product event streams: routed sinks and dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from shelfline.operators.events import MAX_ATTEMPTS, acknowledged_once, event_outcome_counts, parse_events, route_events


def routed_sinks(raw: DataFrame, out: str, checkpoint: str, once_for: str | None = None) -> DataStreamWriter:
    """Write handled, unknown and failed events apart, in one pass over each micro-batch.

    With ``once_for`` (say ``7 days``) a message that was acknowledged is not
    written again if the source delivers it again within that time; start the
    query inside ``streaming.state.stateful`` then.

    A batch owns its folder and replaces it when it is run again, so a restart
    neither loses nor doubles rows. Read the sinks back with
    ``spark.read.parquet(out).where("outcome = 'failed'")``, a partition filter.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/batch_id={batch_id}")

    routed = route_events(parse_events(raw))
    routed = acknowledged_once(routed, once_for) if once_for else routed
    return routed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class _Attempts(StatefulProcessor):
    """Counts failures per message and reports the message once, when it reaches the limit."""

    def __init__(self, max_attempts: int, keep_ms: int):
        self.max_attempts, self.keep_ms = max_attempts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "attempts bigint", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.failures.get()[0] if self.failures.exists() else 0
        attempts, last = before, None
        for batch in rows:
            attempts += len(batch)
            newest = batch.loc[batch["place"].idxmax()]
            last = newest if last is None or newest["place"] > last["place"] else last
        self.failures.update((attempts,))
        if before < self.max_attempts <= attempts:
            yield pd.DataFrame({"message_id": [key[0]], "attempts": [attempts], "raw": [last["raw"]]})

    def close(self) -> None:
        pass


def dead_letter_stream(failed: DataFrame, order: str, max_attempts: int = MAX_ATTEMPTS, keep_hours: int = 24) -> DataFrame:
    """Messages as they reach ``max_attempts`` failures, with the ``raw`` text of the last by the number ``order``.

    Counts untouched for ``keep_hours`` are dropped. Start the query inside ``streaming.state.stateful``.
    """
    return failed.select("message_id", F.coalesce(F.col(order).cast("bigint"), F.lit(-1)).alias("place"), "raw").groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=_Attempts(max_attempts, keep_hours * 3_600_000),
        outputStructType="message_id string, attempts bigint, raw string",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def outcome_counts_stream(routed: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Running counts per type and outcome: every micro-batch writes those that it changed. Read with :func:`latest_counts`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    counts = event_outcome_counts(routed).writeStream.outputMode("update")
    return counts.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last count of each type and outcome; what it holds per key is one row for each batch that changed it."""
    schema = "eventType string, outcome string, messages bigint, acknowledged boolean, batch_id bigint"
    last = spark.read.schema(schema).parquet(out).groupBy("eventType", "outcome")
    return last.agg(F.max_by(F.struct("messages", "acknowledged"), "batch_id").alias("l")).select("eventType", "outcome", "l.*")
