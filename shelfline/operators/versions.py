"""Updates that name the version they were made from: the first one wins, the others are in conflict.

An update holds if the product still has the version it expects, and makes the
next version. So the updates that hold form a chain: the first by ``seq`` that
expects the product's version, the first after it that expects the next one, and
so on. Whoever holds an update, the one after it is known beforehand: the first
that expects one version more. These pointers are found in one ordered pass, and
the chains are followed by pointer jumping: as the pointers double their length,
the known part of every chain doubles, so ``log2(versions)`` self-joins suffice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfline.functions.money import to_money
from shelfline.functions.rules import Rule, Split, product_request_rules, split_by_rules
from shelfline.operators.catalog import NOT_FOUND
from shelfline.operators.ordered import CHUNK_ROWS, with_next
from shelfline.session import durable

CONFLICT = "Product was changed by another request"
_CHANGED = ("name", "description", "price", "stock", "category")


def versioned_updates(products: DataFrame, requests: DataFrame, chunk_rows: int = CHUNK_ROWS) -> Split:
    """The product table after the updates that hold, and the refused requests with ``reasons`` and ``kind``.

    ``requests`` is the update layout plus the expected ``version``; ``seq`` is
    unique. Refused are requests that break a rule (``INVALID``), name no
    product (``NOT_FOUND``) or expect a version that the product does not have
    at their turn (``CONFLICT``); these change nothing.
    """
    rules = [*product_request_rules(), Rule("Version is required", F.col("version").isNull())]
    valid, broken = split_by_rules(requests, rules)
    current = products.select("id", F.col("version").cast("bigint").alias("_current"))
    known = valid.join(current, "id", "left")
    missing = known.where(F.col("_current").isNull())
    live = known.where(F.col("version") >= F.col("_current")).select("id", "seq", "version", "_current")
    holding = _chains(live, chunk_rows)

    met = known.where(F.col("_current").isNotNull()).join(holding.withColumn("_holds", F.lit(True)), "seq", "left")
    new = F.struct("name", "description", to_money(F.col("price")).alias("price"), "stock", "category")
    # A product's chain is reduced in the map tasks, so a hot product costs a row a task.
    last = met.where("_holds").groupBy("id").agg(F.max_by(new, "seq").alias("_new"), F.count(F.lit(1)).alias("_made"))
    updated = products.join(last, "id", "left").select(
        *[
            F.coalesce(F.col(f"_new.{name}"), products[name]).alias(name)
            if name in _CHANGED
            else (F.col("version") + F.coalesce("_made", F.lit(0))).cast(products.schema["version"].dataType).alias(name)
            if name == "version"
            else products[name]
            for name in products.columns
        ]
    )

    def refused(rows: DataFrame, kind: str, reasons) -> DataFrame:
        return rows.select(*[rows[name] for name in requests.columns], reasons.alias("reasons"), F.lit(kind).alias("kind"))

    rejects = refused(broken, "INVALID", F.col("reasons"))
    rejects = rejects.unionByName(refused(missing, "NOT_FOUND", F.array(F.lit(NOT_FOUND))))
    lost = met.where(F.col("_holds").isNull())
    return Split(updated, rejects.unionByName(refused(lost, "CONFLICT", F.array(F.lit(CONFLICT)))))


def _chains(live: DataFrame, chunk_rows: int) -> DataFrame:
    """``seq`` of the updates that hold, from those that expect the product's version or a later one."""
    live = durable(live)
    # A pair has the updates that expect a version and those that expect the next one.
    sides = F.array(F.struct(F.col("version").alias("pair"), F.lit(None).cast("bigint").alias("above")), F.struct((F.col("version") - 1).alias("pair"), F.col("seq").cast("bigint").alias("above")))
    pairs = live.select("id", "seq", F.explode(sides).alias("s")).select(F.struct("id", "s.pair").alias("_pair"), "seq", "s.above")
    ahead = with_next(pairs, "_pair", "seq", "above", "next", chunk_rows).where("above IS NULL AND next IS NOT NULL").select("seq", "next")

    holding = durable(live.where("version = _current").groupBy("id").agg(F.min("seq").alias("seq")).select("seq"))
    ahead = durable(ahead)
    # Only updates that some other one points to, or that begin a chain, can hold.
    entered = ahead.select(F.col("next").alias("seq")).unionByName(holding).distinct()
    jumps = durable(ahead.join(entered, "seq", "left_semi"))
    while not jumps.isEmpty():
        holding = durable(holding.unionByName(holding.join(jumps, "seq").select(F.col("next").alias("seq"))))
        beyond = jumps.select(F.col("seq").alias("next"), F.col("next").alias("_beyond"))
        jumps = durable(jumps.join(beyond, "next").select("seq", F.col("_beyond").alias("next")))
    return holding
