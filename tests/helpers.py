"""Small builders for hand-made tables."""

from datetime import datetime, timezone
from decimal import Decimal

from shelfline.schemas import ORDERS, PRODUCTS


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def products(spark, rows):
    """rows: (id, stock, category[, name])"""
    full = [(i, rest[0] if rest else f"name-{i}", "d", Decimal("10.00"), "USD", stock, category, utc("2024-01-01"), 0)
            for i, stock, category, *rest in rows]
    return spark.createDataFrame(full, PRODUCTS)


def orders(spark, rows):
    """rows: (customer, product, quantity, amount, status, day)"""
    full = [(f"o{n}", customer, product, quantity, Decimal(amount), "USD", status, None, utc(day), 0)
            for n, (customer, product, quantity, amount, status, day) in enumerate(rows)]
    return spark.createDataFrame(full, ORDERS)


def tuples(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
