"""Fixed table schemas. Nothing is ever inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(19, 2)
WIDE_MONEY = T.DecimalType(38, 2)


def _fields(nullable: set[str], **columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, n in nullable) for n, t in columns.items()])


PRODUCTS = _fields(
    set(),
    id=T.StringType(),
    name=T.StringType(),
    description=T.StringType(),
    price=MONEY,
    currency=T.StringType(),
    stock=T.IntegerType(),
    category=T.StringType(),
    created_at=T.TimestampType(),
    version=T.LongType(),
)

ORDERS = _fields(
    {"payment_ref"},
    id=T.StringType(),
    customer_id=T.StringType(),
    product_id=T.StringType(),
    quantity=T.IntegerType(),
    amount=MONEY,
    currency=T.StringType(),
    status=T.StringType(),
    payment_ref=T.StringType(),
    created_at=T.TimestampType(),
    version=T.LongType(),
)

PRODUCT_REQUESTS = _fields(
    {"name", "description", "price", "stock", "category"},
    request_id=T.StringType(),
    seq=T.LongType(),
    name=T.StringType(),
    description=T.StringType(),
    price=T.DecimalType(38, 10),
    stock=T.IntegerType(),
    category=T.StringType(),
)

STOCK_REQUESTS = _fields(
    {"product_id", "quantity", "op"},
    request_id=T.StringType(),
    seq=T.LongType(),
    product_id=T.StringType(),
    quantity=T.IntegerType(),
    op=T.StringType(),
)

ORDER_REQUESTS = _fields(
    {"customer_id", "product_id", "quantity", "payment_method"},
    request_id=T.StringType(),
    seq=T.LongType(),
    customer_id=T.StringType(),
    product_id=T.StringType(),
    quantity=T.IntegerType(),
    payment_method=T.StringType(),
)

RAW_EVENTS = _fields({"raw"}, message_id=T.StringType(), raw=T.StringType())

# Order life cycle, in order of progress.
ORDER_STATUSES = ("PENDING", "PAYMENT_CONFIRMED", "STOCK_RESERVED", "CONFIRMED", "FAILED")

# Product event types.
EVENT_TYPES = ("PRODUCT_CREATED", "PRODUCT_UPDATED", "PRODUCT_DELETED")
