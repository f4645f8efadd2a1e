import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shelfline.operators import transfer
from shelfline.operators.transfer import Openings, Transfer, opening_stocks, tabulated


def played(left, moves):
    for units in moves:
        if left + units >= 0:
            left += units
    return left


def function(first, last, moves):
    openings = Openings(first, last)
    openings.play(np.array(moves, np.int64))
    return openings.transfer()


MOVES = st.lists(st.integers(-12, 12).filter(bool), max_size=80)


@settings(max_examples=300, deadline=None)
@given(MOVES, st.integers(0, 200))
def test_function_equals_loop(moves, last):
    got = function(0, last, moves)
    assert got(np.arange(last + 1)).tolist() == [played(v, moves) for v in range(last + 1)]


@settings(max_examples=300, deadline=None)
@given(MOVES, MOVES, MOVES)
def test_composed_functions_equal_one_long_run(a, b, c):
    """Defined up to the units that each asks for, they hold for every opening."""
    parts = [function(0, sum(-m for m in moves if m < 0), moves) for moves in (a, b, c)]
    every = np.arange(600)
    want = [played(v, [*a, *b, *c]) for v in every.tolist()]
    assert parts[0].then(parts[1]).then(parts[2])(every).tolist() == want
    assert parts[0].then(parts[1].then(parts[2]))(every).tolist() == want


def test_many_batches_and_meeting_stocks():
    rng = random.Random(2)
    moves = [rng.randint(1, 50) * (1 if rng.random() < 0.4 else -1) for _ in range(5000)]
    openings = Openings(0, 3000)
    for at in range(0, len(moves), 700):
        openings.play(np.array(moves[at : at + 700], np.int64))
    assert openings.transfer()(np.arange(3001)).tolist() == [played(v, moves) for v in range(3001)]
    assert len(openings.values) < 100


def test_pieces_are_few():
    got = tabulated(0, np.array([0, 1, 2, 0, 0, 0, 7]), 3)
    assert (got.lows.tolist(), got.closings.tolist(), got.slopes.tolist()) == ([0, 3, 6, 7], [0, 0, 7, 10], [1, 0, 1, 1])


@pytest.mark.parametrize("runs", [1, 64, 65, 300])
def test_openings_by_levels(spark, monkeypatch, runs):
    monkeypatch.setattr(transfer, "FAN", 8)
    rng = random.Random(runs)
    rows, want = [], []
    for key, start in (("a", 30), ("b", 0)):
        left = start
        for at in range(runs):
            moves = [rng.randint(1, 9) * rng.choice([-1, -1, 1]) for _ in range(10)]
            f = function(0, sum(-m for m in moves if m < 0), moves)
            rows.append((key, at, f.lows.tolist(), f.closings.tolist(), f.slopes.tolist()))
            want.append((key, at, left))
            left = played(left, moves)
    maps = spark.createDataFrame(rows, f"product_id string, at bigint, {transfer.MAP}")
    starts = spark.createDataFrame([("a", 30), ("b", 0)], "product_id string, opening int")
    assert sorted(tuple(r) for r in opening_stocks(maps, starts, "product_id").collect()) == sorted(want)


def test_function_of_one_opening():
    f = function(10**6, 10**6, [-5, -(10**6), 3])
    assert f(np.array([10**6])).tolist() == [999998] and isinstance(f, Transfer)
