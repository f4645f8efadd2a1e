"""Order pricing, payment, placement, life-cycle checks and error codes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.functions.money import to_money
from shelfline.functions.rules import Split, order_request_rules, split_by_rules
from shelfline.functions.text import stable_uuid
from shelfline.operators.ordered import CHUNK_ROWS, with_previous
from shelfline.operators.reservation import RESERVED, remaining_stock, reserve_stock
from shelfline.session import written

# Price of a unit without catalogue lookup, and the bulk discount.
UNIT_PRICE = "99.99"
BULK_OVER = 10
BULK_FACTOR = "0.90"

# Payment methods and the prefix of their references.
PAYMENT_PREFIXES = {"STRIPE": "stripe_", "PAYPAL": "paypal_", "CRYPTO": "crypto_"}

# Allowed status steps. FAILED can follow any status.
STATUS_STEPS = (("PENDING", "PAYMENT_CONFIRMED"), ("PAYMENT_CONFIRMED", "STOCK_RESERVED"), ("STOCK_RESERVED", "CONFIRMED"))

# Reject reason and status code; any other reason is a field check, 400.
STATUS_CODES = {"NOT_FOUND": 404, "CONFLICT": 409, "INSUFFICIENT": 422, "INVALID_MONEY": 400}


class Placement(NamedTuple):
    orders: DataFrame
    rejects: DataFrame
    products: DataFrame


def _total(unit_price: Column, quantity: Column) -> Column:
    gross = unit_price.cast("decimal(19,2)") * quantity.cast("decimal(10,0)")
    factor = F.when(quantity > BULK_OVER, F.lit(BULK_FACTOR)).otherwise(F.lit("1.00")).cast("decimal(3,2)")
    return to_money(gross * factor)


def price_orders(requests: DataFrame, products: DataFrame | None = None, unit_price: str = UNIT_PRICE) -> DataFrame:
    """Add ``amount``: unit price times quantity, a tenth off above ten units.

    With ``products`` the unit price is the catalogue's, and requests for
    unknown products drop out.
    """
    if products is None:
        return requests.withColumn("amount", _total(F.lit(unit_price), F.col("quantity")))
    prices = products.select(F.col("id").alias("product_id"), F.col("price").alias("_price"))
    priced = requests.join(prices, "product_id").withColumn("amount", _total(F.col("_price"), F.col("quantity")))
    return priced.select(*requests.columns, "amount")


def route_payment(requests: DataFrame) -> Split:
    """Provider reference per request by payment method; unknown methods are refused."""
    prefix = F.lit(None).cast("string")
    for method, start in PAYMENT_PREFIXES.items():
        prefix = F.when(F.col("payment_method") == method, F.lit(start)).otherwise(prefix)
    reference = F.concat(prefix, stable_uuid(F.lit("payment"), F.col("request_id")))
    routed = requests.withColumn("payment_ref", reference)
    unknown = F.concat(F.lit("Unknown payment method: "), F.coalesce(F.col("payment_method"), F.lit("null")))
    return Split(
        routed.where(F.col("payment_ref").isNotNull()),
        routed.where(F.col("payment_ref").isNull()).drop("payment_ref").withColumn("reasons", F.array(unknown)),
    )


def place_orders(products: DataFrame, requests: DataFrame, placed_at: str, chunk_rows: int = CHUNK_ROWS) -> Placement:
    """Confirmed orders for every request stock allows, in request order.

    Refused requests charge nothing, deduct nothing and leave no order. The
    payment method must be present but does not choose the provider.
    """
    valid, malformed = split_by_rules(requests, order_request_rules())
    # Written once, as orders, rejects and the new stock all derive from it.
    outcomes = written(reserve_stock(products, valid.withColumn("op", F.lit("RESERVE")), chunk_rows), "outcomes")
    accepted = outcomes.where(F.col("outcome") == RESERVED)
    order_id = stable_uuid(F.lit("order"), F.col("request_id"))
    charge = F.concat(F.lit(PAYMENT_PREFIXES["STRIPE"]), stable_uuid(F.lit("payment"), F.col("request_id")))
    orders = price_orders(accepted).select(
        order_id.alias("id"),
        "customer_id",
        "product_id",
        "quantity",
        "amount",
        F.lit("USD").alias("currency"),
        F.lit("CONFIRMED").alias("status"),
        charge.alias("payment_ref"),
        F.lit(placed_at).cast("timestamp").alias("created_at"),
        F.lit(0).cast("bigint").alias("version"),
    )
    # Fixed value: the wording of the reason.
    shortage = F.format_string("Product %s does not have enough stock for quantity %d", F.col("product_id"), F.col("quantity"))
    short = (
        outcomes.where(F.col("outcome") != RESERVED)
        .select(*requests.columns)
        .withColumn("reasons", F.array(shortage))
        .withColumn("kind", F.lit("INSUFFICIENT"))
    )
    rejects = malformed.withColumn("kind", F.lit("INVALID")).unionByName(short)
    return Placement(orders, rejects, remaining_stock(products, outcomes))


def check_order_transitions(history: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Status changes that the life cycle forbids, with the status they came from.

    ``history`` has ``order_id``, ``seq`` and ``status``. An order starts as
    PENDING.
    """
    steps = with_previous(history, "order_id", "seq", "status", "previous_status", chunk_rows)
    start, end = F.col("previous_status"), F.col("status")
    allowed = (end == "FAILED") | (start.isNull() & (end == "PENDING"))
    for before, after in STATUS_STEPS:
        allowed = allowed | (F.coalesce(start == before, F.lit(False)) & (end == after))
    return steps.where(~F.coalesce(allowed, F.lit(False)))


def current_status(history: DataFrame) -> DataFrame:
    """Latest status per order."""
    return history.groupBy("order_id").agg(F.max_by("status", "seq").alias("status"))


def error_status(rejects: DataFrame) -> DataFrame:
    """Status code of every reject by its ``kind``, and its ``reasons`` as one ``message``."""
    code = F.lit(400)
    for kind, status in STATUS_CODES.items():
        code = F.when(F.col("kind") == kind, F.lit(status)).otherwise(code)
    return rejects.withColumn("status", code).withColumn("message", F.concat_ws("; ", "reasons"))
