"""The states of deliveries over a stream, one small state per message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfline.operators.deliveries import ACK_DEADLINE_SECONDS, ACKED, DEAD, DELIVERED, FAILED, OPEN
from shelfline.operators.events import MAX_ATTEMPTS

_DEADLINE_MS = ACK_DEADLINE_SECONDS * 1000
# In place of a deadline: it has passed, and the delivery has had no answer since.
_EXPIRED = -1
OUTPUT = "message_id string, state string, failures bigint, dead_at bigint, place bigint"


class _Deliveries(StatefulProcessor):
    """State: failures in a row, the open delivery's seq and deadline, the last seq seen, and where the message died.

    A timer at the deadline of an open delivery makes it a failure if the
    watermark passes it without another entry.
    """

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "failures bigint, open_seq bigint, deadline bigint, seen bigint, dead_at bigint")

    def _load(self) -> list:
        return list(self.kept.get()) if self.kept.exists() else [0, None, None, -1, None]

    def _fail(self, kept: list, seq: int) -> None:
        kept[0] += 1
        if kept[0] >= self.max_attempts:
            kept[4] = seq

    def _row(self, key, kept: list) -> pd.DataFrame:
        state = DEAD if kept[4] is not None else OPEN if kept[1] is not None else FAILED if kept[0] else ACKED
        row = {"message_id": [key[0]], "state": [state], "failures": [kept[0]], "dead_at": pd.array([kept[4]], "Int64"), "place": [2 * kept[3]]}
        return pd.DataFrame(row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = pd.concat([batch[["seq", "ms", "kind"]] for batch in rows]).sort_values("seq")
        kept = self._load()
        if kept[1] is not None:
            self.handle.deleteTimer(kept[2])
        for seq, ms, kind in entries.itertuples(index=False):
            if kept[4] is not None:
                break
            kept[3] = int(seq)
            late = kept[1] is not None and (kind == DELIVERED or ms >= kept[2])
            counted = late or kept[2] == _EXPIRED
            if late:
                self._fail(kept, kept[1])
            kept[1] = kept[2] = None
            if kept[4] is not None:
                break
            if kind == DELIVERED:
                kept[1], kept[2] = int(seq), int(ms) + _DEADLINE_MS
            elif kind == ACKED:
                kept[0] = 0
            elif not counted:
                self._fail(kept, int(seq))
        if kept[4] is not None:
            kept[1] = kept[2] = None
        elif kept[1] is not None:
            self.handle.registerTimer(kept[2])
        self.kept.update(tuple(kept))
        yield self._row(key, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._load()
        if kept[1] is not None and kept[2] == expiredTimerInfo.getExpiryTimeInMs():
            self._fail(kept, kept[1])
            kept[1], kept[2] = None, _EXPIRED
            self.kept.update(tuple(kept))
            row = self._row(key, kept)
            row["place"] += 1
            yield row

    def close(self) -> None:
        pass


def delivery_states_stream(log: DataFrame, late: str = "1 minute", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """A message's state whenever entries of ``log`` (message_id, seq, at, kind) or its deadline change it.

    Of a message's rows the one with the greatest ``place`` holds. Entries of one
    message must arrive by ``seq`` across micro-batches; inside one they are sorted.
    Start the query inside ``streaming.state.stateful``.
    """
    known = log.where(F.col("message_id").isNotNull() & F.col("kind").isin(DELIVERED, ACKED, FAILED))
    entries = known.withWatermark("at", late).select("message_id", "seq", "at", F.unix_millis("at").alias("ms"), "kind")
    return entries.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=_Deliveries(max_attempts), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def latest_states(changes: DataFrame) -> DataFrame:
    """The last state of every message from the stored rows of :func:`delivery_states_stream`."""
    last = F.max_by(F.struct("state", "failures", "dead_at"), "place").alias("l")
    return changes.groupBy("message_id").agg(last).select("message_id", "l.*")
