from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import products, tuples
from shelfline.functions.money import combine_money, money_error, to_money
from shelfline.functions.text import is_uuid
from shelfline.operators import catalog, ordering
from shelfline.schemas import ORDER_REQUESTS, PRODUCT_REQUESTS

D = Decimal
AT = "2024-01-01 00:00:00"


def request(n, name="Garden Lantern", description="Copper, 40 cm", price="87.35", stock=64, category="OUTDOOR"):
    return (f"r{n}", n, name, description, None if price is None else D(price), stock, category)


def reasons(rejects):
    return {r.request_id: sorted(r.reasons) for r in rejects.collect()}


def test_create_accepts_and_rounds_half_even(spark):
    made = catalog.create_products(
        spark.createDataFrame([request(1), request(2, price="2.345"), request(3, price="2.355")], PRODUCT_REQUESTS), AT
    )
    rows = {r.price: r for r in made.accepted.collect()}
    assert set(rows) == {D("87.35"), D("2.34"), D("2.36")}
    first = rows[D("87.35")]
    assert (first.name, first.stock, first.currency, first.version) == ("Garden Lantern", 64, "USD", 0)
    assert made.accepted.where(~is_uuid(F.col("id"))).isEmpty() and made.rejects.isEmpty()


def test_create_reports_every_broken_rule(spark):
    bad = [
        request(1, name=""),
        request(2, name=None, description=" ", price=None, stock=None, category="\t"),
        request(3, price="-5.00", stock=-1),
        request(4, name="x" * 101, description="y" * 501, category="z" * 51),
        request(5, price="0.009"),
        request(6, name="x" * 100, description="y" * 500, category="z" * 50, price="0.01", stock=0),
        request(7, name="\U0001f600" * 51),
    ]
    assert reasons(catalog.create_products(spark.createDataFrame(bad, PRODUCT_REQUESTS), AT).rejects) == {
        "r1": ["Name is required", "Name must be between 2 and 100 characters"],
        "r2": ["Category is required", "Category must be between 2 and 50 characters", "Description is required", "Name is required", "Price is required", "Stock is required"],
        "r3": ["Price must be greater than 0", "Stock cannot be negative"],
        "r4": ["Category must be between 2 and 50 characters", "Description cannot exceed 500 characters", "Name must be between 2 and 100 characters"],
        "r5": ["Price must be greater than 0"],
        "r7": ["Name must be between 2 and 100 characters"],
    }


def test_a_price_that_does_not_fit_is_refused_alone(spark):
    rows = [request(1), request(2, price="99999999999999999999.99"), request(3, price="99999999999999999.99"), request(4, price="99999999999999999.995")]
    made = catalog.create_products(spark.createDataFrame(rows, PRODUCT_REQUESTS), AT)
    assert {r.price for r in made.accepted.collect()} == {D("87.35"), D("99999999999999999.99")}
    assert reasons(made.rejects) == {"r2": ["Price is out of range"], "r4": ["Price is out of range"]}
    changed = catalog.update_products(products(spark, [("a", 1, "X")]), spark.createDataFrame(rows, PRODUCT_REQUESTS).withColumn("id", F.lit("a")))
    assert changed.rejects.count() == 2 and changed.accepted.first().price == D("99999999999999999.99")


def test_a_product_with_orders_is_not_deleted(spark):
    table = products(spark, [("a", 1, "X"), ("b", 1, "X"), ("c", 1, "X")])
    asked = spark.createDataFrame([("r1", 1, "a"), ("r2", 2, "b"), ("r3", 3, "b"), ("r4", 4, "zz"), ("r5", 5, "a")], "request_id string, seq bigint, id string")
    sold = spark.createDataFrame([("a",), ("zz",)], "product_id string")
    split = catalog.delete_products(table, asked, sold)
    assert sorted(tuples(split.accepted, "id")) == [("a",), ("c",)]
    assert reasons(split.rejects) == {"r1": ["Product has orders"], "r5": ["Product has orders"], "r3": ["Product not found"], "r4": ["Product not found"]}


def test_create_update_delete_life_cycle(spark):
    table = catalog.create_products(spark.createDataFrame([request(1)], PRODUCT_REQUESTS), AT).accepted
    (key,) = [r.id for r in table.collect()]
    updates = spark.createDataFrame([request(1, price="99.99", stock=150), request(2, name="Renamed", price="79.99", stock=80), request(3, name="")], PRODUCT_REQUESTS)
    result = catalog.update_products(table, updates.withColumn("id", F.lit(key)))
    assert tuples(result.accepted, "id", "name", "price", "stock", "currency") == [(key, "Renamed", D("79.99"), 80, "USD")]
    assert list(reasons(result.rejects)) == ["r3"]
    deletions = spark.createDataFrame([("d1", 1, key), ("d2", 2, key), ("d3", 3, "nope")], "request_id string, seq bigint, id string")
    gone = catalog.delete_products(result.accepted, deletions)
    assert gone.accepted.isEmpty()
    assert reasons(gone.rejects) == {"d2": ["Product not found"], "d3": ["Product not found"]}


def test_update_of_unknown_product_changes_nothing(spark):
    table = products(spark, [("a", 3, "X")])
    result = catalog.update_products(table, spark.createDataFrame([request(1)], PRODUCT_REQUESTS).withColumn("id", F.lit("zz")))
    assert tuples(result.accepted) == tuples(table) and reasons(result.rejects) == {"r1": ["Product not found"]}


@pytest.mark.parametrize(
    "amount,currency,other,other_currency,sign,result,error",
    [
        ("10.00", "USD", "2.50", "USD", 1, "12.50", None),
        ("10.00", "USD", "2.50", "USD", -1, "7.50", None),
        ("10.00", "USD", "10.00", "EUR", 1, None, "CURRENCY_MISMATCH"),
        ("1.00", "USD", "1.01", "USD", -1, None, "NEGATIVE_MONEY"),
        ("-1.00", "USD", "5.00", "USD", 1, None, "NEGATIVE_MONEY"),
    ],
)
def test_money(spark, amount, currency, other, other_currency, sign, result, error):
    columns = (F.lit(D(amount)), F.lit(currency), F.lit(D(other)), F.lit(other_currency), sign)
    row = spark.range(1).select(combine_money(*columns).alias("m"), money_error(*columns).alias("e")).first()
    assert (row.m, row.e) == (None if result is None else D(result), error)


def test_money_rounds_half_even(spark):
    row = spark.range(1).select(to_money(F.lit(D("2.345"))).alias("a"), to_money(F.lit(D("2.355"))).alias("b")).first()
    assert (row.a, row.b) == (D("2.34"), D("2.36"))


def order(n, customer="c1", product="p", quantity=5, method="STRIPE"):
    return (f"r{n}", n, customer, product, quantity, method)


def test_pricing_and_bulk_discount(spark):
    requests = spark.createDataFrame([order(1, quantity=10), order(2, quantity=11), order(3, quantity=1)], ORDER_REQUESTS)
    assert dict(tuples(ordering.price_orders(requests), "request_id", "amount")) == {"r1": D("999.90"), "r2": D("989.90"), "r3": D("99.99")}
    listed = ordering.price_orders(requests, products(spark, [("p", 1, "X")]))
    assert dict(tuples(listed, "request_id", "amount")) == {"r1": D("100.00"), "r2": D("99.00"), "r3": D("10.00")}


def test_place_orders(spark):
    table = products(spark, [("p", 12, "X")])
    requests = spark.createDataFrame(
        [
            order(1), order(2, quantity=200), order(3, quantity=0), order(4, customer=" ", method=None),
            order(5, product=None), order(6, product="unknown"), order(7, quantity=7, method="anything"), order(8, quantity=1),
        ],
        ORDER_REQUESTS,
    )
    placed = ordering.place_orders(table, requests, AT)
    rows = {r.quantity: r for r in placed.orders.collect()}
    assert sorted(rows) == [5, 7]
    assert rows[5].status == "CONFIRMED" and rows[5].payment_ref.startswith("stripe_") and rows[5].amount == D("499.95")
    assert rows[7].payment_ref.startswith("stripe_")
    assert tuples(placed.products, "id", "stock") == [("p", 0)]
    codes = {r.request_id: (r.status, r.message) for r in ordering.error_status(placed.rejects).collect()}
    assert codes == {
        "r2": (422, "Product p does not have enough stock for quantity 200"),
        "r3": (400, "quantity must be at least 1"),
        "r4": (400, "customerId is required; paymentMethod is required"),
        "r5": (400, "productId is required"),
        "r6": (422, "Product unknown does not have enough stock for quantity 5"),
        "r8": (422, "Product p does not have enough stock for quantity 1"),
    }
    again = ordering.place_orders(table, requests, AT)
    assert sorted(tuples(again.orders, "id", "payment_ref")) == sorted(tuples(placed.orders, "id", "payment_ref"))


def test_payment_routing(spark):
    requests = spark.createDataFrame([order(1), order(2, method="PAYPAL"), order(3, method="CRYPTO"), order(4, method="CASH"), order(5, method=None)], ORDER_REQUESTS)
    routed = ordering.route_payment(requests)
    assert {r.request_id: r.payment_ref.split("_")[0] for r in routed.accepted.collect()} == {"r1": "stripe", "r2": "paypal", "r3": "crypto"}
    assert reasons(routed.rejects) == {"r4": ["Unknown payment method: CASH"], "r5": ["Unknown payment method: null"]}


STEPS = [
    ("good", ["PENDING", "PAYMENT_CONFIRMED", "STOCK_RESERVED", "CONFIRMED"]),
    ("failed", ["PENDING", "FAILED"]),
    ("late", ["PENDING", "PAYMENT_CONFIRMED", "STOCK_RESERVED", "CONFIRMED", "FAILED"]),
    ("skips", ["PENDING", "STOCK_RESERVED", "CONFIRMED"]),
    ("back", ["PENDING", "PAYMENT_CONFIRMED", "PENDING"]),
    ("starts", ["CONFIRMED"]),
    ("odd", ["PENDING", "SHIPPED", None]),
]


@pytest.mark.parametrize("chunk_rows", [1_000_000, 1, 2])
def test_transitions(spark, chunk_rows):
    history = spark.createDataFrame(
        [(o, seq, s) for o, steps in STEPS for seq, s in enumerate(steps)], "order_id string, seq bigint, status string"
    )
    illegal = ordering.check_order_transitions(history, chunk_rows)
    assert sorted(tuples(illegal, "order_id", "previous_status", "status"), key=repr) == sorted([
        ("skips", "PENDING", "STOCK_RESERVED"),
        ("back", "PAYMENT_CONFIRMED", "PENDING"),
        ("starts", None, "CONFIRMED"),
        ("odd", "PENDING", "SHIPPED"),
        ("odd", "SHIPPED", None),
    ], key=repr)
    assert dict(tuples(ordering.current_status(history)))["back"] == "PENDING"


def test_status_codes(spark):
    rejects = spark.createDataFrame(
        [("a", ["x", "y"], "INVALID"), ("b", ["n"], "NOT_FOUND"), ("c", ["s"], "CONFLICT"), ("d", ["i"], "INSUFFICIENT"), ("e", ["m"], "INVALID_MONEY")],
        "request_id string, reasons array<string>, kind string",
    )
    got = {r.request_id: (r.status, r.message) for r in ordering.error_status(rejects).collect()}
    assert got == {"a": (400, "x; y"), "b": (404, "n"), "c": (409, "s"), "d": (422, "i"), "e": (400, "m")}


def test_created_at_is_kept(spark):
    made = catalog.create_products(spark.createDataFrame([request(1)], PRODUCT_REQUESTS), AT).accepted
    assert made.select(F.date_format("created_at", "yyyy-MM-dd HH:mm")).first()[0] == "2024-01-01 00:00"
