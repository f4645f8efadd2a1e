"""Ordered work per key over a stream whose rows come out of order, across micro-batches.

Keys are dealt into a fixed number of buckets, and state is kept by bucket, as one
visit of the state costs about the same for one key and for a thousand. Rows wait
until the watermark has passed their event time and that of all rows of their key
before them, and are then taken in ``seq`` order. The buffer of a bucket is a row of
leaves in a map state, each with at most ``leaf_rows`` rows (or those of one ``seq``)
sorted by ``seq``, under the first of them and the earliest event time. New rows
touch the leaves that they fall into and a release the leaves up to the last with a
time that has passed, so a task holds one leaf at a time and one batch of arrivals,
however many rows of a hot key are waiting.

A row that comes after a later one of its key has been taken can't take its place
any more: it leaves at once, marked late. So do rows without ``seq`` or event time,
and rows that repeat a ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEAF_ROWS = 4096


# Keys of a bucket are read and written together: some ten million keys suit this number.
BUCKETS = 4096


class Fold(Protocol):
    """What is carried along each key, and what becomes of the rows; both by their column ``key``."""

    def take(self, values: dict, rows: pd.DataFrame) -> pd.DataFrame:
        """Output of ``rows``, which are in order; ``values`` has what the keys carry, and is brought up to date."""

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Output of rows that came too late."""


class Reordered(StatefulProcessor):
    """``by`` names the column of the key if a group is a bucket of keys."""

    def __init__(self, fold: Fold, leaf_rows: int = LEAF_ROWS, by: str | None = None) -> None:
        self.fold, self.leaf_rows, self.by = fold, leaf_rows, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "keys binary")
        self.leaves = handle.getMapState("leaves", "first bigint, ms bigint", "rows binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        values, taken = self._load()
        for name, value in opening_values(initialState):
            values.setdefault(name, value)
        self._save(values, taken)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values, taken = self._load()
        for batch in rows:
            in_time = batch["seq"].notna() & batch["ms"].notna()
            after = [taken.get(name) is None or seq > taken[name] for name, seq in zip(batch[self.by], batch["seq"])]
            in_time &= np.array(after, bool)
            late = [batch[~in_time], *self._keep(batch[in_time].astype({"seq": "int64", "ms": "int64"}))]
            late = [part for part in late if len(part)]
            if late:
                yield self.fold.late(pd.concat(late))
        yield from self._release(values, taken, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(*self._load(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict, dict]:
        """What the keys of the bucket carry, and the last ``seq`` taken of each."""
        if not self.carried.exists():
            return {}, {}
        names, values, taken = (c.to_pylist() for c in unpacked(self.carried.get()[0]).columns)
        return dict(zip(names, values)), dict(zip(names, taken))

    def _save(self, values: dict, taken: dict) -> None:
        names = list(dict.fromkeys([*values, *taken]))
        table = pa.table({"key": names, "value": [values.get(k) for k in names], "taken": [taken.get(k) for k in names]})
        self.carried.update((packed(table),))

    def _firsts(self) -> list[tuple[int, int]]:
        return sorted(tuple(first) for first in self.leaves.keys())

    def _leaf(self, first: tuple[int, int]) -> pd.DataFrame:
        return unpacked(self.leaves.getValue(first)[0]).to_pandas()

    def _store(self, rows: pd.DataFrame) -> None:
        first = int(rows["seq"].iloc[0]), int(rows["ms"].min())
        self.leaves.updateValue(first, (packed(pa.Table.from_pandas(rows, preserve_index=False)),))

    def _keep(self, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Put rows into their leaves; returns those that repeat a ``seq`` of their key."""
        firsts = self._firsts()
        spots = np.searchsorted(np.array([seq for seq, _ in firsts], np.int64), batch["seq"].to_numpy(), "right") - 1
        for spot, rows in batch.groupby(np.maximum(spots, 0)):
            if firsts:
                rows = pd.concat([self._leaf(firsts[spot]), rows])
                self.leaves.removeKey(firsts[spot])
            again = rows.duplicated(["seq"] if self.by is None else [self.by, "seq"])
            yield rows[again]
            rows = rows[~again].sort_values("seq")
            begin, seqs = 0, rows["seq"].to_numpy()
            while begin < len(rows):
                end = begin + self.leaf_rows
                if end < len(rows):  # a leaf has all rows of a seq
                    end = int(np.searchsorted(seqs, seqs[end]))
                    if end == begin:
                        end = int(np.searchsorted(seqs, seqs[begin], "right"))
                self._store(rows.iloc[begin:end])
                begin = end

    def _release(self, values: dict, taken: dict, watermark: int) -> Iterator[pd.DataFrame]:
        firsts = self._firsts()
        due = max((n for n, (_, ms) in enumerate(firsts, 1) if ms <= watermark), default=0)
        fronts: dict = {}  # keys with a waiting row, and the time of the first
        moved = False
        for first in firsts[:due]:
            rows = self._leaf(first)
            ready = np.empty(len(rows), bool)
            for n, (name, ms) in enumerate(zip(rows[self.by], rows["ms"])):
                if ms > watermark:
                    fronts.setdefault(name, ms)
                ready[n] = name not in fronts
            if not ready.any():
                continue
            self.leaves.removeKey(first)
            if not ready.all():
                self._store(rows[~ready])
            rows, moved = rows[ready], True
            taken.update((name, int(seq)) for name, seq in zip(rows[self.by], rows["seq"]))
            out = self.fold.take(values, rows)
            if len(out):
                yield out
        if moved:
            self._save(values, taken)
        later = [*fronts.values(), *(ms for _, ms in firsts[due:])]
        if later:
            self.handle.registerTimer(int(min(later)))


def opening_values(initial: pd.DataFrame) -> Iterator[tuple[str | None, int | None]]:
    """Keys and their values of an initial state with the columns ``key`` and ``value``."""
    for name, value in zip(initial["key"], initial["value"]):
        yield name, None if pd.isna(value) else int(value)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def bucketed(key: str | Column, buckets: int) -> tuple[Column, Column]:
    """``bucket`` of a key, and the ``key`` as text, which state and rows hold it as."""
    text = F.col(key).cast("string") if isinstance(key, str) else key.cast("string")
    return F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket"), text.alias("key")


def timed(rows: DataFrame, at: str, delay: str, *columns: str | Column) -> DataFrame:
    """``columns`` and the event time as ``ms``, under a watermark.

    The time goes on as a plain number: Spark would drop late rows before the
    processor could mark them.
    """
    return rows.withWatermark(at, delay).select(*columns, F.unix_millis(at).alias("ms"))
