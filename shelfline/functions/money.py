"""Decimal money: scale 2, banker's rounding, one currency per sum, never negative."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfline.schemas import MONEY, WIDE_MONEY


def to_money(amount: Column) -> Column:
    """Round half to even at two places; null for what the money type doesn't hold."""
    return F.bround(amount, 2).try_cast(MONEY)


def half_up(value: Column, scale: int = 2) -> Column:
    """Round half away from zero, as the reports do."""
    return F.round(value, scale)


def mean(total: Column, count: Column) -> Column:
    """Exact decimal quotient of a sum and a count; null for an empty group."""
    return total / F.nullif(count, F.lit(0).cast("bigint"))


def percent_change(current: Column, previous: Column) -> Column:
    """Growth over ``previous`` in percent, half away from zero; null when there is nothing to compare with.

    Whole hundredths of a percent are divided out exactly. A plain decimal
    quotient of two wide sums keeps only a few digits, so it would round twice.
    """
    base = F.coalesce(previous, F.lit(0).cast(WIDE_MONEY))
    change = current - base
    size = F.nullif(F.abs(base), F.lit(0).cast(WIDE_MONEY))
    doubled, twice = F.abs(change) * 20_000 + size, size * 2
    hundredths = ((doubled - doubled % twice) / twice).cast("decimal(30,0)")
    percent = (hundredths * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(32,2)")
    return F.when((change < 0) != (base < 0), -percent).otherwise(percent)


def money_error(
    amount: Column, currency: Column, other_amount: Column, other_currency: Column, sign: int = 1
) -> Column:
    """Why the two sums cannot be added (``sign=1``) or subtracted (``sign=-1``); null if they can."""
    return (
        F.when(amount < 0, "NEGATIVE_MONEY")
        .when(other_amount < 0, "NEGATIVE_MONEY")
        .when(currency != other_currency, "CURRENCY_MISMATCH")
        .when(amount + other_amount * sign < 0, "NEGATIVE_MONEY")
    )


def combine_money(
    amount: Column, currency: Column, other_amount: Column, other_currency: Column, sign: int = 1
) -> Column:
    """Sum or difference, null where :func:`money_error` names a reason."""
    refused = money_error(amount, currency, other_amount, other_currency, sign)
    return F.when(refused.isNull(), to_money(to_money(amount) + to_money(other_amount) * sign))
