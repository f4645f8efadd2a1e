import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shelfline.operators.events import dead_letter, event_outcome_counts, order_placed_events, parse_events, route_events
from shelfline.operators.notifications import order_confirmations
from shelfline.operators.reservation import remaining_stock, reserve_stock
from shelfline.schemas import ORDERS, RAW_EVENTS, STOCK_REQUESTS
from shelfline.sources.events import read_product_events, read_stock_requests
from shelfline.streaming.fanout import post_order_fanout
from shelfline.streaming.reservation import reserve_stock_batches, reserve_stock_stream
from shelfline.streaming.routing import dead_letter_stream, latest_counts, outcome_counts_stream, routed_sinks
from shelfline.streaming.state import SETTINGS, stateful

MESSAGES = [
    ("m1", '{"eventType":"PRODUCT_CREATED","entityId":"e1","payload":{"name":"x","n":{"a":1}}}'),
    ("m2", '{"eventType":"PRODUCT_DELETED","entityId":"e1","payload":null}'),
    ("m3", '{"eventType":"PRODUCT_RENAMED","entityId":"e1"}'),
    ("m4", "{not json"),
    ("m5", '{"entityId":"e2"}'),
    ("m6", None),
    ("m7", "[1]"),
    *[("m8", "{")] * 5,
    *[("m9", "{")] * 4,
]


def write_files(df, path, files):
    df.repartitionByRange(files, df.columns[1]).write.parquet(path)


def finish(spark, writer, **options):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    with stateful(spark):
        query = writer.trigger(availableNow=True).start(**options)
    query.awaitTermination()
    assert {key: spark.conf.get(key, None) for key in SETTINGS} == before


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_routed_sinks_equal_batch_routing(spark, tmp_path):
    raw = spark.createDataFrame(MESSAGES, RAW_EVENTS)
    write_files(raw, f"{tmp_path}/in", 3)
    stream = read_product_events(spark, f"{tmp_path}/in", max_files_per_trigger=1)
    finish(spark, routed_sinks(stream, f"{tmp_path}/out", f"{tmp_path}/progress"))
    sinks = spark.read.parquet(f"{tmp_path}/out")
    batch = route_events(parse_events(raw))
    assert rows(sinks.select(batch.columns)) == rows(batch)
    outcome = {r.message_id: r.outcome for r in batch.collect()}
    assert outcome == {
        "m1": "handled", "m2": "handled", "m3": "unknown", "m4": "failed",
        "m5": "failed", "m6": "failed", "m7": "failed", "m8": "failed", "m9": "failed",
    }
    payloads = {r.message_id: r.payload for r in batch.collect()}
    assert payloads["m1"] == '{"name":"x","n":{"a":1}}' and payloads["m2"] is None


def test_outcome_counts_stream(spark, tmp_path):
    raw = spark.createDataFrame(MESSAGES, RAW_EVENTS)
    write_files(raw, f"{tmp_path}/in", 2)
    routed = route_events(parse_events(read_product_events(spark, f"{tmp_path}/in", 1)))
    finish(spark, outcome_counts_stream(routed, f"{tmp_path}/out", f"{tmp_path}/progress"))
    assert rows(latest_counts(spark, f"{tmp_path}/out")) == rows(event_outcome_counts(route_events(parse_events(raw))))


def test_dead_letters_across_micro_batches(spark, tmp_path):
    tried = [(m, text and text + " " * n) for n, (m, text) in enumerate(MESSAGES)]
    raw = spark.createDataFrame(tried, RAW_EVENTS)
    for part in range(3):  # m8 fails five times, spread over files
        raw.where((F.col("message_id") != "m8") & (F.lit(part) == 0)).unionByName(
            raw.where("message_id = 'm8'").orderBy("raw").offset(2 * part).limit(2)
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    failed = route_events(parse_events(read_product_events(spark, f"{tmp_path}/in", 1))).where("outcome = 'failed'")
    letters = dead_letter_stream(failed.withColumn("place", F.length("raw")), "place").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress")
    finish(spark, letters, path=f"{tmp_path}/letters")
    expected = dead_letter(route_events(parse_events(raw)).where("outcome = 'failed'"))
    got = rows(spark.read.schema("message_id string, attempts bigint, raw string").parquet(f"{tmp_path}/letters"))
    assert got == rows(expected) == [("m8", 5, tried[11][1])]


def reservation_case(spark, tmp_path):
    rng = random.Random(3)
    requests = [
        (f"r{seq}", seq, rng.choice(["hot", "hot", "b", "missing"]), rng.randint(0, 6), rng.choice(["RESERVE", "RESERVE", "RELEASE"]))
        for seq in range(300)
    ]
    products = spark.createDataFrame([("hot", 60), ("b", 9)], "id string, stock int")
    batch = spark.createDataFrame(requests, STOCK_REQUESTS)
    for low in range(0, 300, 100):  # file order is request order
        batch.where(F.col("seq").between(low, low + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return products, batch, read_stock_requests(spark, f"{tmp_path}/in", max_files_per_trigger=1)


OUTCOME = ["request_id", "outcome", "remaining"]


def test_reservation_stream_equals_batch(spark, tmp_path):
    products, batch, stream = reservation_case(spark, tmp_path)
    writer = reserve_stock_stream(stream, products).writeStream.format("parquet")
    finish(spark, writer.option("checkpointLocation", f"{tmp_path}/progress"), path=f"{tmp_path}/out")
    got = spark.read.schema("request_id string, outcome string, remaining bigint").parquet(f"{tmp_path}/out")
    assert rows(got.select(OUTCOME)) == rows(reserve_stock(products, batch).select(OUTCOME))


def test_reservation_batches_equal_batch(spark, tmp_path):
    products, batch, stream = reservation_case(spark, tmp_path)
    finish(spark, reserve_stock_batches(stream, products, f"{tmp_path}/out", f"{tmp_path}/progress", chunk_rows=15))
    outcomes = reserve_stock(products, batch)
    assert rows(spark.read.parquet(f"{tmp_path}/out/outcomes").select(OUTCOME)) == rows(outcomes.select(OUTCOME))
    left = spark.read.parquet(f"{tmp_path}/out/stock/batch_id=2")
    assert rows(left) == rows(remaining_stock(products, outcomes))


def test_streams_resume_where_they_stopped(spark, tmp_path):
    """Counters and dead-letter counts outlive a stopped query."""
    products = spark.createDataFrame([("a", 10)], "id string, stock int")

    def reserve(n):
        row = spark.createDataFrame([(f"r{n}", n, "a", 4, "RESERVE")], STOCK_REQUESTS)
        row.coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")
        spark.createDataFrame([("m", "{")] * 3, RAW_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        outcomes = reserve_stock_stream(read_stock_requests(spark, f"{tmp_path}/requests"), products)
        finish(spark, outcomes.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/p1"), path=f"{tmp_path}/outcomes")
        letters = dead_letter_stream(read_product_events(spark, f"{tmp_path}/raw").withColumn("n", F.lit(0)), "n")
        finish(spark, letters.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/p2"), path=f"{tmp_path}/letters")

    for n in range(3):
        reserve(n)
    outcomes = spark.read.schema("request_id string, outcome string, remaining bigint").parquet(f"{tmp_path}/outcomes")
    assert rows(outcomes) == [("r0", "RESERVED", 6), ("r1", "RESERVED", 2), ("r2", "INSUFFICIENT", 2)]
    letters = spark.read.schema("message_id string, attempts bigint, raw string").parquet(f"{tmp_path}/letters")
    assert rows(letters) == [("m", 6, "{")]


def test_sync_overwrites_the_counter(spark, tmp_path):
    requests = [("r1", 1, "a", 5, "RESERVE"), ("r2", 2, "a", 7, "SYNC"), ("r3", 3, "a", 5, "RESERVE"), ("r4", 4, "n", 2, "SYNC"), ("r5", 5, "n", 2, "RESERVE")]
    spark.createDataFrame(requests, STOCK_REQUESTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(STOCK_REQUESTS).parquet(f"{tmp_path}/in")
    products = spark.createDataFrame([("a", 1)], "id string, stock int")
    writer = reserve_stock_stream(stream, products).writeStream.format("parquet")
    finish(spark, writer.option("checkpointLocation", f"{tmp_path}/progress"), path=f"{tmp_path}/out")
    got = {r.request_id: (r.outcome, r.remaining) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        "r1": ("INSUFFICIENT", 1), "r2": ("SYNCED", 7), "r3": ("RESERVED", 2), "r4": ("SYNCED", 2), "r5": ("RESERVED", 0),
    }


def test_fanout_writes_both_follow_ups(spark, tmp_path):
    orders = spark.sql(
        "SELECT string(id) id, 'c1' customer_id, 'p1' product_id, 1 quantity, 99.99BD amount, 'USD' currency,"
        " 'CONFIRMED' status, 'ref' payment_ref, timestamp'2024-01-01' created_at, 0L version FROM range(5)"
    )
    orders.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ORDERS).parquet(f"{tmp_path}/in")
    for query in post_order_fanout(stream, f"{tmp_path}/out", f"{tmp_path}/progress").values():
        query.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/confirmations")) == rows(order_confirmations(orders.select(
        *[F.col(c).cast(ORDERS[c].dataType) for c in ORDERS.names])))
    assert rows(spark.read.parquet(f"{tmp_path}/out/events")) == rows(order_placed_events(orders))


STREAMED = ("reserved_stock_stream", "reserved_stock_batches", "routed_events_stream", "product_event_outcomes_stream", "dead_letter_stream", "post_order_fanout")


@pytest.mark.parametrize("name", STREAMED)
def test_streams_over_tables_stored_as_folders(spark, tmp_path, name):
    """One file or several, the same rows."""
    single = "/root/testdata/sf0.001"
    for table in ("part", "orders", "lineitem", "events"):
        rows_ = spark.read.parquet(f"{single}/{table}.parquet")
        (rows_.repartition(3) if table in ("events", "orders") else rows_).write.parquet(f"{tmp_path}/{table}.parquet")
    run = contract.queries()[name]
    assert rows(run(spark, str(tmp_path))) == rows(run(spark, single))
