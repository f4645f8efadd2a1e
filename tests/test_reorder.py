"""Requests and status changes that come out of order across micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import products
from shelfline.operators.ordering import check_order_transitions
from shelfline.operators.reservation import reserve_stock
from shelfline.schemas import STOCK_REQUESTS
from shelfline.streaming.reorder import Reordered
from shelfline.streaming.reservation import LATE, reserve_stock_reordered, reserve_stock_stream
from shelfline.streaming.state import stateful
from shelfline.streaming.transitions import check_order_transitions_stream

STOCK = STOCK_REQUESTS.simpleString()[len("struct<"):-1].replace(":", " ")
FAR = 10_000_000


def play(spark, path, batches, schema, job):
    """Feed each batch as one file to a restarted stream; returns the stored output."""
    for n, rows in enumerate(batches):
        timed = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.coalesce("seconds", "seq")))
        timed.coalesce(1).write.mode("append").parquet(f"{path}/in")
        live = spark.readStream.schema(timed.schema).parquet(f"{path}/in")
        out = job(live)
        with stateful(spark):
            running = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/out")
        running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def asked(draw, n, hot):
    rows = []
    for seq in range(1, n + 1):
        product = "hot" if draw.random() < hot else draw.choice(["a", "b", "ghost", None])
        quantity = draw.choice([1, 2, 3, 5, 0, None])
        rows.append((f"r{seq}", seq, product, quantity, draw.choice(["RESERVE", "RESERVE", "RELEASE", "LEND", None]), None))
    return rows


@pytest.mark.parametrize("leaf_rows", [3, 4096])
def test_shuffled_requests_equal_the_batch(spark, tmp_path, leaf_rows):
    draw = random.Random(leaf_rows)
    rows = asked(draw, 240, 0.5)
    stock = products(spark, [("hot", 40, "c"), ("a", 5, "c"), ("b", 0, "c")])
    # Up to 60 places late; a watermark 130 behind never passes them.
    order = sorted(rows, key=lambda r: r[1] + draw.randrange(60))
    batches = [order[:80], order[80:160], order[160:]]
    batches += [[("end", FAR + n, "end", 1, "RELEASE", None)] for n in range(2)]
    found = play(spark, str(tmp_path), batches, f"{STOCK}, seconds bigint", lambda live: reserve_stock_reordered(live, stock, "130 seconds", leaf_rows))
    found = found.where("product_id is null or product_id <> 'end'")
    requests = spark.createDataFrame([r[:5] for r in rows], STOCK_REQUESTS)
    columns = ["request_id", "seq", "product_id", "quantity", "op", "outcome", "remaining"]
    expected = reserve_stock(stock, requests).select(columns).collect()
    # A request that is refused by rule has no stock left to report in either form.
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, expected), key=repr)


def test_late_and_repeated_requests_leave_by_the_side(spark, tmp_path):
    stock = products(spark, [("a", 5, "c")])
    batches = [
        [("r2", 2, "a", 2, "RESERVE", 20), ("r1", 1, "a", 4, "RESERVE", 10), ("r1again", 1, "a", 4, "RESERVE", 10)],
        [("far", FAR, "z", 1, "RELEASE", None)],
        [("r3", 3, "a", 1, "RESERVE", 30)],  # timers let r1 and r2 go
        [("r0", 0, "a", 1, "RESERVE", 5), ("r4", 4, "a", 1, "RESERVE", 40)],
    ]
    found = play(spark, str(tmp_path), batches, f"{STOCK}, seconds bigint", lambda live: reserve_stock_reordered(live, stock, "1 second"))
    outcomes = {r.request_id: (r.outcome, r.remaining) for r in found.where("product_id = 'a'").collect()}
    # r3 and r4 are behind the watermark too, but no later request of the product had been decided.
    assert outcomes == {
        "r1": ("RESERVED", 1), "r1again": (LATE, None), "r2": ("INSUFFICIENT", 1), "r3": ("RESERVED", 0),
        "r0": (LATE, None), "r4": ("INSUFFICIENT", 0),
    }


def test_a_request_waits_for_those_before_it(spark, tmp_path):
    """The clocks of request 1 and 2 disagree with their order; the order counts."""
    stock = products(spark, [("a", 3, "c")])
    batches = [
        [("r1", 1, "a", 3, "RESERVE", 100), ("r2", 2, "a", 3, "RESERVE", 50)],
        [("z1", FAR, "z", 1, "RELEASE", 80)],
        [("z2", FAR + 1, "z", 1, "RELEASE", FAR)],
        [("z3", FAR + 2, "z", 1, "RELEASE", FAR)],
    ]
    found = play(spark, str(tmp_path), batches, f"{STOCK}, seconds bigint", lambda live: reserve_stock_reordered(live, stock, "1 second"))
    assert {r.request_id: r.outcome for r in found.where("product_id = 'a'").collect()} == {"r1": "RESERVED", "r2": "INSUFFICIENT"}


def test_shuffled_status_changes_equal_the_batch(spark, tmp_path):
    draw = random.Random(5)
    states = ["PENDING", "PAYMENT_CONFIRMED", "STOCK_RESERVED", "CONFIRMED", "FAILED", None]
    rows = [("hot" if draw.random() < 0.4 else f"o{draw.randrange(12)}", seq, draw.choice(states), None) for seq in range(1, 201)]
    order = sorted(rows, key=lambda r: r[1] + draw.randrange(50))
    batches = [order[:100], order[100:], *([("end", FAR + n, "PENDING", None)] for n in range(2))]
    schema = "order_id string, seq bigint, status string, seconds bigint"
    found = play(spark, str(tmp_path), batches, schema, lambda live: check_order_transitions_stream(live, "200 seconds", leaf_rows=7))
    found = found.where("order_id <> 'end'")
    assert not found.where("late").count()
    columns = ["order_id", "seq", "status", "previous_status"]
    history = spark.createDataFrame([r[:3] for r in rows], "order_id string, seq bigint, status string")
    expected = check_order_transitions(history).select(columns).collect()
    assert expected and sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, expected), key=repr)


def test_a_task_holds_one_leaf(monkeypatch):
    """Arrivals of a hot key split leaves instead of growing them."""

    class Leaves(dict):
        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    import pandas as pd

    buffer = Reordered(None, leaf_rows=10)
    buffer.leaves = Leaves()
    draw = random.Random(1)
    seqs = draw.sample(range(1000), 500)
    for n in range(0, 500, 50):
        assert not sum(len(again) for again in buffer._keep(pd.DataFrame({"seq": seqs[n : n + 50], "ms": 0})))
    kept = [buffer._leaf(first)["seq"].tolist() for first in buffer._firsts()]
    assert sum(kept, []) == sorted(seqs) and max(map(len, kept)) <= 10


def test_keys_of_a_bucket_keep_their_own_order(spark, tmp_path):
    """All orders in one bucket, with the same seqs and ids that no double holds; a batch of Arrow holds few rows."""
    draw = random.Random(9)
    orders, states = [None, *[(1 << 60) + n for n in range(6)]], ["PENDING", "PAYMENT_CONFIRMED", "CONFIRMED", "FAILED", None]
    rows = [(order, seq, draw.choice(states), None) for order in orders for seq in range(1, 21)]
    order = sorted(rows, key=lambda r: r[1] + draw.randrange(8))
    batches = [order[:70], order[70:], *([(-1, FAR + n, "PENDING", None)] for n in range(2))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = play(
            spark, str(tmp_path), batches, "order_id bigint, seq bigint, status string, seconds bigint",
            lambda live: check_order_transitions_stream(live, "200 seconds", leaf_rows=5, buckets=1),
        )
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = found.where("order_id is null or order_id <> -1")
    columns = ["order_id", "seq", "status", "previous_status"]
    history = spark.createDataFrame([r[:3] for r in rows], "order_id bigint, seq bigint, status string")
    expected = check_order_transitions(history).select(columns).collect()
    assert not found.where("late").count()
    assert expected and sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, expected), key=repr)


@pytest.mark.parametrize("job", [reserve_stock_stream, reserve_stock_reordered])
def test_state_is_visited_by_bucket(spark, tmp_path, job):
    """A visit of the state for each of a product table's rows took most of the time."""
    stock = spark.range(200).select(((1 << 60) + F.col("id")).alias("id"), (F.col("id") % 7).cast("int").alias("stock"))
    requests = stock.selectExpr("id request_id", "id - (1L << 60) seq", "id product_id", "3 quantity", "'RESERVE' op", "timestamp'2024-01-01' at")
    requests.limit(30).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        with stateful(spark):
            writer = job(live, stock, buckets=2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress")
            running = writer.trigger(availableNow=True).start(f"{tmp_path}/out")
        running.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    keyed = spark.read.format("statestore").option("stateVarName", "counters" if job is reserve_stock_stream else "carried").load(f"{tmp_path}/progress")
    assert keyed.count() == 2
    if job is reserve_stock_stream:
        found = {r.product_id: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        asked_for = [r.product_id for r in spark.read.parquet(f"{tmp_path}/in").collect()]
        assert found == {i: "RESERVED" if (i - (1 << 60)) % 7 >= 3 else "INSUFFICIENT" for i in asked_for}
