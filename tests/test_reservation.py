import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfline.operators.reservation import remaining_stock, reserve_stock
from shelfline.schemas import STOCK_REQUESTS

STOCK = "id string, stock int"


def sequential(stock, requests):
    """The plain loop the operator has to equal."""
    left, out = dict(stock), {}
    for request_id, _, product, quantity, op in sorted(requests, key=lambda r: r[1]):
        if quantity is None or quantity < 1:
            out[request_id] = ("INVALID_QUANTITY", None)
        elif op == "RELEASE":
            if product in left:
                left[product] += quantity
            out[request_id] = ("RELEASED", left.get(product))
        elif product in left and left[product] >= quantity:
            left[product] -= quantity
            out[request_id] = ("RESERVED", left[product])
        else:
            out[request_id] = ("INSUFFICIENT", left.get(product))
    return out, left


def run(spark, stock, requests, **options):
    products = spark.createDataFrame(list(stock.items()), STOCK)
    outcomes = reserve_stock(products, spark.createDataFrame(requests, STOCK_REQUESTS), **options)
    got = {r.request_id: (r.outcome, r.remaining) for r in outcomes.collect()}
    left = {r.id: r.stock for r in remaining_stock(products, outcomes).collect()}
    return got, left


def reserve(*quantities, product="a"):
    return [(f"{product}{i}", i, product, q, "RESERVE") for i, q in enumerate(quantities)]


def test_refused_request_consumes_nothing(spark):
    got, left = run(spark, {"a": 8}, reserve(5, 4, 3, 1))
    assert [got[f"a{i}"] for i in range(4)] == [("RESERVED", 3), ("INSUFFICIENT", 3), ("RESERVED", 0), ("INSUFFICIENT", 0)]
    assert left == {"a": 0}


def test_flash_sale_accepts_exactly_the_stock(spark):
    got, left = run(spark, {"a": 30}, reserve(*[1] * 100))
    assert len(got) == 100
    assert sum(outcome == "RESERVED" for outcome, _ in got.values()) == 30
    assert left == {"a": 0}


def test_outcome_codes(spark):
    requests = [
        ("r1", 1, "a", 0, "RESERVE"),
        ("r2", 2, "zz", 1, "RESERVE"),
        ("r3", 3, "zz", 1, "RELEASE"),
        ("r4", 4, "a", 9999, "RESERVE"),
        ("r5", 5, "a", 5, "RESERVE"),
        ("r6", 6, None, 5, "RESERVE"),
        ("r7", 7, "a", 1, "BORROW"),
        ("r8", 8, "a", None, "RESERVE"),
    ]
    got, left = run(spark, {"a": 30}, requests)
    assert got == {
        "r1": ("INVALID_QUANTITY", None),
        "r2": ("INSUFFICIENT", None),
        "r3": ("RELEASED", None),
        "r4": ("INSUFFICIENT", 30),
        "r5": ("RESERVED", 25),
        "r6": ("INSUFFICIENT", None),
        "r7": ("INVALID_OPERATION", None),
        "r8": ("INVALID_QUANTITY", None),
    }
    assert left == {"a": 25}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk_rows", [1_000_000, 25])
def test_equals_sequential_loop(spark, seed, chunk_rows):
    """One product holds half of all rows; small chunks force it to be cut."""
    rng = random.Random(seed)
    stock = {"hot": rng.choice([40, 400, 5000]), "calm": 100_000, "b": 12, "c": 0}
    requests = []
    for seq in range(1200):
        product = rng.choice(["hot", "hot", "hot", "calm", "b", "c", "missing"])
        op = "RELEASE" if rng.random() < (0.25 if product != "calm" else 0.1) else "RESERVE"
        requests.append((f"r{seq}", seq, product, rng.randint(0, 9), op))
    rng.shuffle(requests)
    want, want_left = sequential(stock, requests)
    got, left = run(spark, stock, requests, chunk_rows=chunk_rows)
    assert got == want
    assert left == want_left


@pytest.mark.parametrize(
    "quantities",
    [
        [7] * 40 + [1] * 40,  # stuck at a level nothing fits, until smaller requests come
        [100 - i for i in range(80)],  # every request just below the one before
        [1] * 80,
        [50, 49, 48, 47] * 20,
    ],
)
def test_cut_product_with_hard_guesses(spark, quantities):
    requests = reserve(*quantities)
    want, want_left = sequential({"a": 101}, requests)
    got, left = run(spark, {"a": 101}, requests, chunk_rows=10)
    assert got == want and left == want_left


def test_guesses_that_never_help_still_end_soon(spark, monkeypatch):
    """Wide quantities: two different stocks practically never meet again."""
    from shelfline.operators import reservation

    follow, rounds = reservation.durable, []
    monkeypatch.setattr(reservation, "TABLE", 1)
    monkeypatch.setattr(reservation, "durable", lambda df: rounds.append("run" in df.columns) or follow(df))
    rng = random.Random(4)
    requests = [
        (f"r{seq}", seq, "a", rng.randint(1, 10**6), "RELEASE" if rng.random() < 0.4 else "RESERVE") for seq in range(1000)
    ]
    want, want_left = sequential({"a": 10**6}, requests)
    got, left = run(spark, {"a": 10**6}, requests, chunk_rows=20)
    assert got == want and left == want_left
    assert sum(rounds) <= 7  # 50 chunks


def test_sparse_and_clustered_sequence_numbers(spark):
    rng = random.Random(9)
    seqs = sorted({rng.randrange(10) * 10**9 + rng.randrange(200) for _ in range(400)})
    requests = [(f"r{s}", s, "a", rng.randint(1, 6), "RELEASE" if rng.random() < 0.3 else "RESERVE") for s in seqs]
    want, want_left = sequential({"a": 20}, requests)
    got, left = run(spark, {"a": 20}, requests, chunk_rows=30)
    assert got == want and left == want_left


def test_integer_product_ids_and_extra_columns_pass_through(spark):
    products = spark.createDataFrame([(1, 3)], "id bigint, stock int")
    requests = spark.createDataFrame(
        [("x", 1, 1, 2, "RESERVE", 2**60 + 1), ("y", 2, 1, 2, "RESERVE", None)],
        "request_id string, seq bigint, product_id bigint, quantity int, op string, note bigint",
    )
    rows = {r.request_id: r for r in reserve_stock(products, requests).collect()}
    assert rows["x"].note == 2**60 + 1 and rows["x"].outcome == "RESERVED"
    assert rows["y"].note is None and rows["y"].outcome == "INSUFFICIENT"


def test_contended_products_keep_several_tasks(spark):
    products = spark.createDataFrame([(f"p{i}", 1) for i in range(50)], STOCK)
    requests = spark.createDataFrame(
        [(f"r{i}", i, f"p{i % 50}", 2, "RESERVE") for i in range(200)], STOCK_REQUESTS
    )
    outcomes = reserve_stock(products, requests).where(F.col("outcome") == "INSUFFICIENT")
    tasks = outcomes.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks > 1


def test_same_requests_can_be_replayed_twice(spark):
    products = spark.createDataFrame([("a", 8)], STOCK)
    requests = spark.createDataFrame(reserve(5, 4, 3, 1), STOCK_REQUESTS)
    first, second = (sorted(reserve_stock(products, requests).collect()) for _ in range(2))
    assert first == second and requests.columns == STOCK_REQUESTS.names


def test_runs_survive_small_arrow_batches(spark):
    """One product holds half of the rows, and its runs span many batches."""
    rng = random.Random(8)
    requests = [
        (f"r{s}", s, rng.choice(["hot", "hot", "b", "c"]), rng.randint(1, 9), "RELEASE" if rng.random() < 0.3 else "RESERVE")
        for s in range(1500)
    ]
    stock = {"hot": 90, "b": 20, "c": 0}
    want, want_left = sequential(stock, requests)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "17")
    try:
        for chunk_rows in (1_000_000, 100):
            got, left = run(spark, stock, requests, chunk_rows=chunk_rows)
            assert got == want and left == want_left
    finally:
        spark.conf.set(name, before)


def arrow(opening, requests, sizes):
    columns = {
        "product_id": ["a"] * len(requests), "chunk": [0] * len(requests), "_opening": [opening] * len(requests),
        "_move": [q if op == "RELEASE" else -q for op, q in requests],
    }
    return iter(pa.Table.from_pydict(columns).to_batches(max_chunksize=sizes))


REQUESTS = st.lists(st.tuples(st.sampled_from(["RESERVE", "RESERVE", "RELEASE"]), st.integers(1, 12)), min_size=1, max_size=30)


@settings(max_examples=300, deadline=None)
@given(REQUESTS, st.integers(0, 40), st.integers(0, 60), st.integers(1, 7))
def test_span_holds_for_every_opening_inside_it(requests, opening, other, sizes):
    from shelfline.operators.reservation import _replay, _replay_spans

    def replay(start):
        batches = list(_replay(arrow(start, requests, sizes)))
        return [c for _, _, codes, _ in batches for c in codes.tolist()], int(batches[-1][3][-1])

    spans = [row for batch in _replay_spans(arrow(opening, requests, sizes)) for row in batch.to_pylist()]
    assert len(spans) == 1
    codes, left = replay(opening)
    assert spans[0]["low"] <= opening <= spans[0]["high"] and left == opening + spans[0]["change"] and left >= 0
    other_codes, other_left = replay(other)
    inside = spans[0]["low"] <= other <= spans[0]["high"]
    assert inside == (codes == other_codes)
    if inside:
        assert other_left == other + spans[0]["change"]


@pytest.mark.parametrize("table", [1, 1 << 20])
@pytest.mark.parametrize("fan", [2, 64])
def test_cut_products_by_functions_and_by_guesses(spark, monkeypatch, table, fan):
    from shelfline.operators import reservation, transfer

    monkeypatch.setattr(reservation, "TABLE", table)
    monkeypatch.setattr(transfer, "FAN", fan)
    rng = random.Random(table + fan)
    stock = {"hot": 60, "warm": 3000, "low": 0}
    requests = []
    for seq in range(1500):
        product = rng.choice(["hot", "hot", "warm", "low"])
        op = "RELEASE" if rng.random() < 0.3 else "RESERVE"
        requests.append((f"r{seq}", seq, product, rng.randint(1, 40 if product != "hot" else 9), op))
    want, want_left = sequential(stock, requests)
    got, left = run(spark, stock, requests, chunk_rows=40)
    assert got == want and left == want_left


def test_functions_leave_no_rounds(spark, monkeypatch):
    """Every chunk of a contended product is replayed once for its function and once for its outcomes."""
    from shelfline.operators import reservation

    monkeypatch.setattr(reservation, "_settle", None)
    requests = [(f"r{s}", s, "a", 1 + s * 7 % 5, "RELEASE" if s % 4 == 0 else "RESERVE") for s in range(900)]
    want, want_left = sequential({"a": 25}, requests)
    got, left = run(spark, {"a": 25}, requests, chunk_rows=15)
    assert got == want and left == want_left
