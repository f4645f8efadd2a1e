import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import products
from shelfline.operators.ordered import with_next
from shelfline.operators.versions import CONFLICT, versioned_updates

REQUESTS = "request_id string, seq bigint, id string, name string, description string, price decimal(19,2), stock int, category string, version bigint"


def request(seq, product, version, stock=1, name="Some name"):
    return (f"r{seq}", seq, product, name, "d", Decimal("5.00"), stock, "cat", version)


def sequential(table, requests):
    """The plain loop: (stock, version) by product, and the kind of every refused request."""
    state, refused = dict(table), {}
    for request_id, seq, product, name, _, _, stock, _, version in sorted(requests, key=lambda r: r[1]):
        if not name or version is None or stock < 0:
            refused[request_id] = "INVALID"
        elif product not in state:
            refused[request_id] = "NOT_FOUND"
        elif state[product][1] != version:
            refused[request_id] = "CONFLICT"
        else:
            state[product] = (stock, version + 1)
    return state, refused


def run(spark, table, requests, **options):
    at = products(spark, [(k, v[0], "cat") for k, v in table.items()]) if table else products(spark, []).limit(0)
    versions = spark.createDataFrame([(k, v[1]) for k, v in table.items()], "id string, v bigint")
    at = at.join(versions, "id").withColumn("version", F.col("v")).drop("v")
    split = versioned_updates(at, spark.createDataFrame(requests, REQUESTS), **options)
    rejects = split.rejects.collect()
    assert len({r.request_id for r in rejects}) == len(rejects)
    return {r.id: (r.stock, r.version) for r in split.accepted.collect()}, {r.request_id: r.kind for r in rejects}, rejects


def test_first_of_equal_versions_wins(spark):
    got, refused, rejects = run(spark, {"a": (1, 4)}, [request(1, "a", 3), request(2, "a", 4, 20), request(3, "a", 4, 30), request(4, "a", 5, 40), request(5, "a", 7)])
    assert got == {"a": (40, 6)} and refused == {"r1": "CONFLICT", "r3": "CONFLICT", "r5": "CONFLICT"}
    assert {tuple(r.reasons) for r in rejects} == {(CONFLICT,)}


def test_refusals_take_no_version(spark):
    rows = [request(1, "a", 0, name=""), request(2, "a", 0, stock=-1), request(3, "zz", 0), request(4, "a", None), request(5, None, 0), request(6, "a", 0, 9)]
    got, refused, _ = run(spark, {"a": (1, 0), "b": (2, 3)}, rows)
    assert got == {"a": (9, 1), "b": (2, 3)}
    assert refused == {"r1": "INVALID", "r2": "INVALID", "r3": "NOT_FOUND", "r4": "INVALID", "r5": "NOT_FOUND"}


@pytest.mark.parametrize("seed, chunk_rows", [(1, 1_000_000), (2, 40), (3, 15)])
def test_equals_sequential_loop(spark, seed, chunk_rows):
    """One product has two thirds of all requests; small chunks force its versions' pairs to be cut."""
    rng = random.Random(seed)
    table = {"hot": (1, 0), "b": (2, 5), "c": (3, 0)}
    requests = []
    for seq in range(900):
        product = rng.choice(["hot", "hot", "hot", "hot", "b", "c", "missing"])
        low = 5 if product == "b" else 0
        version = low + (rng.randint(0, 3) if rng.random() < 0.7 else seq // 12)
        requests.append(request(seq, product, version, rng.randint(0, 99)))
    rng.shuffle(requests)
    want = sequential(table, requests)
    got, refused, _ = run(spark, table, requests, chunk_rows=chunk_rows)
    assert (got, refused) == want


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    from shelfline.operators import versions

    keep, calls = versions.durable, []
    monkeypatch.setattr(versions, "durable", lambda df: calls.append(1) or keep(df))
    got, refused, _ = run(spark, {"a": (0, 0)}, [request(n, "a", n, n) for n in range(300)])
    assert got == {"a": (299, 300)} and not refused
    assert len(calls) <= 4 + 2 * 9


def test_no_requests(spark):
    got, refused, _ = run(spark, {"a": (1, 2)}, [])
    assert got == {"a": (1, 2)} and not refused


@pytest.mark.parametrize("chunk_rows", [7, 10**6])
def test_next_value_across_chunks(spark, chunk_rows):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), n, n if rng.random() < 0.15 else None) for n in range(120)]
    df = spark.createDataFrame(rows, "k string, n bigint, v bigint")
    got = {(r.k, r.n): r.w for r in with_next(df, "k", "n", "v", "w", chunk_rows).collect()}
    assert got == {(k, n): next((v for q, m, v in rows if q == k and m > n and v is not None), None) for k, n, _ in rows}
