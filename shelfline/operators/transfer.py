"""What a run of stock moves makes of every opening stock at once.

A transfer function takes the stock before a run of requests to the stock after
it. It is piecewise: on a piece the decisions of the run are the same, so the
closing stock rises with the opening (slope 1), or different openings have met
in one stock (slope 0). Functions of neighbouring runs compose to the function
of both, so the openings of all runs of a product follow from its first one by
a prefix computation, however its requests fall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.session import durable

#: Runs that one task composes.
FAN = 64
#: Requests that are played together against many stocks.
TOGETHER = 256
#: Up to so many different stocks each is played by itself.
FEW = 3
MAP = "lows array<bigint>, closings array<bigint>, slopes array<bigint>"


@dataclass
class Transfer:
    """From ``lows[i]`` up to the next low: ``closings[i] + slopes[i] * (opening - lows[i])``."""

    lows: np.ndarray
    closings: np.ndarray
    slopes: np.ndarray

    def __call__(self, openings: np.ndarray) -> np.ndarray:
        at = self.piece(openings)
        return self.closings[at] + self.slopes[at] * (openings - self.lows[at])

    def piece(self, openings: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.lows, openings, "right") - 1, 0)

    def then(self, after: Transfer) -> Transfer:
        """The function of this run and ``after`` together."""
        lows = [self.lows]
        ends = np.append(self.lows[1:], np.iinfo(np.int64).max)
        for low, end, closing in zip(*(column[self.slopes == 1].tolist() for column in (self.lows, ends, self.closings))):
            # Where the next function has a new piece, this one's rising piece is cut.
            first, last = np.searchsorted(after.lows, [closing + 1, closing + min(end - low, 2**62)])
            lows.append(after.lows[first:last] - closing + low)
        every = np.unique(np.concatenate(lows))
        met = self(every)
        slopes = self.slopes[self.piece(every)] * after.slopes[after.piece(met)]
        return _joined(every, after(met), slopes)


def _joined(lows: np.ndarray, closings: np.ndarray, slopes: np.ndarray) -> Transfer:
    """Pieces that continue the one before are part of it."""
    new = np.ones(len(lows), bool)
    goes_on = closings[:-1] + slopes[:-1] * np.diff(lows)
    new[1:] = (slopes[1:] != slopes[:-1]) | (closings[1:] != goes_on)
    return Transfer(lows[new], closings[new], slopes[new])


def tabulated(first: int, closings: np.ndarray, net: int) -> Transfer:
    """From the closing stocks of the openings from ``first`` on; beyond them every request is accepted."""
    lows = np.arange(first, first + len(closings) + 1)
    values = np.append(closings, first + len(closings) + net)
    # Flat where the next opening closes alike, or the one before did and this one ends the piece.
    rise = np.diff(values)
    flat = (rise == 0) | (np.append(1, rise[:-1]) == 0) & (rise != 1)
    slopes = np.append((~flat).astype(np.int64), 1)
    return _joined(lows, values, slopes)


class Openings:
    """The stocks that the openings ``first`` to ``last`` come to as requests are played.

    Openings that meet in one stock stay together. Requests are played in
    batches: stocks that cover a whole batch only move by its net units.
    """

    def __init__(self, first: int, last: int) -> None:
        self.first, self.net, self.played = first, 0, 0
        self.values = np.arange(first, last + 1)
        self.place = np.arange(len(self.values))

    def play(self, moves: np.ndarray) -> None:
        """``moves`` are units: negative for a reserve, positive for a release."""
        self.net += int(moves.sum())
        at = 0
        while at < len(moves):
            if len(self.values) <= FEW:
                rest = moves[at:].tolist()
                self.values = np.array([_played(value, rest) for value in self.values.tolist()], np.int64)
                self._meet()
                return
            self._batch(moves[at : at + TOGETHER])
            at += TOGETHER

    def _batch(self, moves: np.ndarray) -> None:
        sums = np.cumsum(moves)
        low = self.values < -sums.min()
        after = self.values + sums[-1]
        if low.any():
            stocks, back = np.unique(self.values[low], return_inverse=True)
            for units in moves.tolist():
                if units > 0:
                    stocks += units
                else:
                    np.add(stocks, units, out=stocks, where=stocks >= -units)
            after[low] = stocks[back]
        self.values = after
        self.played += 1
        if self.played & (self.played - 1) == 0 or self.played % 64 == 0:
            self._meet()

    def _meet(self) -> None:
        self.values, back = np.unique(self.values, return_inverse=True)
        self.place = back[self.place]

    def transfer(self) -> Transfer:
        return tabulated(self.first, self.values[self.place], self.net)


def _played(left: int, moves: list[int]) -> int:
    for units in moves:
        if left + units >= 0:
            left += units
    return left


def opening_stocks(maps: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(key, at, opening) of every run, from the functions ``maps`` (key, at, and the columns of MAP) and the first ``opening`` of each key.

    Runs are numbered from 0 along each key. FAN neighbours are composed into
    one function until a key has FAN at most; then the openings are handed down
    again. So a task sees FAN functions, and the rounds are log(runs).
    """
    levels = [maps]
    most = (maps.agg(F.max("at")).first()[0] or 0) + 1
    while most > FAN:
        levels.append(durable(_by_run(levels[-1], key).applyInArrow(lambda group: _compose(group, key), f"{_key(maps, key)}, at bigint, {MAP}")))
        most = -(-most // FAN)
    opened = starts.select(key, F.lit(0).cast("bigint").alias("at"), F.col("opening").cast("bigint").alias("opening"))
    for level in reversed(levels):
        above = opened.select(key, F.col("at").alias("run"), "opening")
        joined = level.withColumn("run", F.expr(f"at div {FAN}")).join(above, [key, "run"])
        opened = joined.groupBy(key, "run").applyInArrow(lambda group: _hand_on(group, key), f"{_key(maps, key)}, at bigint, opening bigint")
    return opened


def _key(maps: DataFrame, key: str) -> str:
    return f"`{key}` {maps.schema[key].dataType.simpleString()}"


def _by_run(level: DataFrame, key: str):
    return level.withColumn("run", F.expr(f"at div {FAN}")).groupBy(key, "run")


def _functions(group: pa.Table) -> list[Transfer]:
    columns = [group.column(name).to_pylist() for name in ("lows", "closings", "slopes")]
    return [Transfer(*(np.array(part, np.int64) for part in parts)) for parts in zip(*columns)]


def _compose(group: pa.Table, key: str) -> pa.Table:
    group = group.sort_by("at")
    first, *others = _functions(group)
    for function in others:
        first = first.then(function)
    return as_table(group.column(key).slice(0, 1), group.column("run").slice(0, 1), first, key)


def as_table(key_column, at, function: Transfer, key: str) -> pa.Table:
    lists = [pa.array([column.tolist()], pa.list_(pa.int64())) for column in (function.lows, function.closings, function.slopes)]
    return pa.table([key_column, at, *lists], names=[key, "at", "lows", "closings", "slopes"])


def _hand_on(group: pa.Table, key: str) -> pa.Table:
    group = group.sort_by("at")
    left, out = group.column("opening")[0].as_py(), []
    for function in _functions(group):
        out.append(left)
        left = int(function(np.array([left]))[0])
    return pa.table([group.column(key), group.column("at"), pa.array(out, pa.int64())], names=[key, "at", "opening"])
