"""Row rules: a message and the condition that breaks it, collected in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.functions.text import is_blank, is_empty, utf16_length
from shelfline.schemas import EVENT_TYPES

# Fixed value: the least amount that 19 digits, two of them decimal places, do not hold.
MONEY_LIMIT = "100000000000000000.00"


class Rule(NamedTuple):
    message: str
    broken: Column


class Split(NamedTuple):
    """Rows that passed and rows that did not, the latter with ``reasons``."""

    accepted: DataFrame
    rejects: DataFrame


def broken_rules(rules: Sequence[Rule]) -> Column:
    """Messages of all broken rules, in rule order; an unknown condition breaks nothing."""
    return F.array_compact(F.array(*[F.when(rule.broken, F.lit(rule.message)) for rule in rules]))


def split_by_rules(df: DataFrame, rules: Sequence[Rule]) -> Split:
    """The accepted side tests plain conditions; only refused rows build their list of reasons."""
    refused = reduce(or_, [F.coalesce(rule.broken, F.lit(False)) for rule in rules])
    return Split(df.where(~refused), df.where(refused).withColumn("reasons", broken_rules(rules)))


def not_null(*columns: str) -> list[Rule]:
    return [Rule(f"{name} is null", F.col(name).isNull()) for name in columns]


def _length_outside(name: str, low: int, high: int) -> Column:
    return ~utf16_length(F.col(name)).between(low, high)


# Limits and messages of the request checks below.


def product_request_rules() -> list[Rule]:
    """Checks on create and update requests."""
    return [
        Rule("Name is required", is_blank(F.col("name"))),
        Rule("Name must be between 2 and 100 characters", _length_outside("name", 2, 100)),
        Rule("Description is required", is_blank(F.col("description"))),
        Rule("Description cannot exceed 500 characters", _length_outside("description", 0, 500)),
        Rule("Price is required", F.col("price").isNull()),
        Rule("Price must be greater than 0", F.col("price") < F.lit("0.01").cast("decimal(3,2)")),
        Rule("Price is out of range", F.abs(F.bround(F.col("price"), 2)) >= F.lit(MONEY_LIMIT).cast("decimal(38,2)")),
        Rule("Stock is required", F.col("stock").isNull()),
        Rule("Stock cannot be negative", F.col("stock") < 0),
        Rule("Category is required", is_blank(F.col("category"))),
        Rule("Category must be between 2 and 50 characters", _length_outside("category", 2, 50)),
    ]


def stock_request_rules() -> list[Rule]:
    quantity = F.coalesce(F.col("quantity"), F.lit(0))
    return [Rule("quantity must be at least 1", quantity < 1)]


def order_request_rules() -> list[Rule]:
    return [
        Rule("customerId is required", is_blank(F.col("customer_id"))),
        Rule("productId is required", F.col("product_id").isNull()),
        *stock_request_rules(),
        Rule("paymentMethod is required", is_blank(F.col("payment_method"))),
    ]


def notify_request_rules() -> list[Rule]:
    return [Rule(f"{name} should not be empty", is_empty(F.col(name))) for name in ("userId", "message", "channel")]


def event_rules() -> list[Rule]:
    known = F.coalesce(F.col("eventType").isin(*EVENT_TYPES), F.lit(False))
    return [
        Rule("eventType must be one of the following values: " + ", ".join(EVENT_TYPES), ~known),
        Rule("entityId should not be empty", is_empty(F.col("entityId"))),
    ]


def product_table_rules() -> list[Rule]:
    return [
        *not_null("id", "name", "description", "price", "currency", "stock", "category", "created_at", "version"),
        Rule("price > 0", F.col("price") <= 0),
        Rule("stock >= 0", F.col("stock") < 0),
    ]


def order_table_rules() -> list[Rule]:
    return [
        *not_null("id", "customer_id", "product_id", "quantity", "amount", "currency", "status", "created_at", "version"),
        Rule("quantity > 0", F.col("quantity") <= 0),
        Rule("amount >= 0", F.col("amount") < 0),
    ]
