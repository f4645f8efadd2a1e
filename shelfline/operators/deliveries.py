"""Messages as their deliveries leave them: open, acknowledged, failed or dead.

A delivery is answered by an acknowledgement or a refusal. Without an answer
before its deadline or the next delivery it has failed; a refusal after the
deadline does not count again. An acknowledgement, late or not, clears the count
of failures. The failure that makes ``max_attempts`` in a row makes the message
a dead letter; what comes after changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.operators.events import MAX_ATTEMPTS
from shelfline.operators.ordered import CHUNK_ROWS, with_next, with_previous
from shelfline.session import durable

# Seconds until an unanswered delivery has failed, and the kinds of log entries.
ACK_DEADLINE_SECONDS = 30
DELIVERED, ACKED, FAILED = "DELIVERED", "ACKED", "FAILED"
OPEN, DEAD = "OPEN", "DEAD"


def overdue(since: Column, now: Column) -> Column:
    return F.unix_micros(now) - F.unix_micros(since) >= ACK_DEADLINE_SECONDS * 1_000_000


def delivery_states(log: DataFrame, as_of: str, max_attempts: int = MAX_ATTEMPTS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(message_id, state, failures, dead_at) of every message in ``log`` (message_id, seq, at, kind).

    ``failures`` counts those in a row at the end, or up to the one that was too
    many, whose ``seq`` is ``dead_at``. Entries are ordered by ``seq``, which is
    unique; an answer without a delivery counts as one. A message with very many
    entries is cut along ``seq``: each entry looks up the next one, each failure
    the next acknowledgement, and the rest is counting.
    """
    now = F.lit(as_of).cast("timestamp")
    entry = F.struct(F.col("kind").alias("kind"), F.col("at").alias("at"))
    known = log.where(F.col("message_id").isNotNull() & F.col("kind").isin(DELIVERED, ACKED, FAILED)).select("message_id", "seq", "at", "kind", entry.alias("_entry"))
    # Each pass reads the one before several times, so it is stored.
    followed = durable(with_next(known, "message_id", "seq", "_entry", "_next", chunk_rows))
    between = with_previous(followed, "message_id", "seq", "_entry", "_before", chunk_rows)
    again = F.when(F.col("_next").isNull(), overdue(F.col("at"), now)).otherwise((F.col("_next.kind") == DELIVERED) | overdue(F.col("at"), F.col("_next.at")))
    counted = F.coalesce((F.col("_before.kind") == DELIVERED) & overdue(F.col("_before.at"), F.col("at")), F.lit(False))
    delivered = F.when(again, FAILED).when(F.col("_next").isNull(), OPEN)
    outcome = F.when(F.col("kind") == DELIVERED, delivered).when((F.col("kind") == ACKED) | ~counted, F.col("kind"))
    settled = durable(between.select("message_id", "seq", outcome.alias("outcome")).where("outcome IS NOT NULL"))
    acked = settled.withColumn("_acked", F.when(F.col("outcome") == ACKED, F.col("seq")))
    runs = durable(with_next(acked, "message_id", "seq", "_acked", "_until", chunk_rows).select("message_id", "seq", "outcome", "_until"))
    # Runs of failures between acknowledgements; a run keeps its first max_attempts places, however long it is.
    run = runs.groupBy("message_id", "_until").agg(
        F.count(F.when(F.col("outcome") == FAILED, 1)).alias("n"),
        F.count(F.when(F.col("outcome") == OPEN, 1)).alias("_open"),
    )
    fifth = _nth_failure(runs.where(F.col("outcome") == FAILED), run.where(F.col("n") >= max_attempts).select("message_id", "_until"), max_attempts)
    ends = run.groupBy("message_id").agg(
        F.coalesce(F.max(F.when(F.col("_until").isNull(), F.col("n"))), F.lit(0)).alias("_n"),
        F.coalesce(F.max(F.when(F.col("_until").isNull(), F.col("_open"))), F.lit(0)).alias("_open"),
    )
    joined = ends.join(fifth, "message_id", "left")
    dead = F.col("dead_at").isNotNull()
    state = F.when(dead, DEAD).when(F.col("_open") > 0, OPEN).when(F.col("_n") > 0, FAILED).otherwise(ACKED)
    return joined.select("message_id", state.alias("state"), F.when(dead, F.lit(max_attempts)).otherwise(F.col("_n")).cast("bigint").alias("failures"), "dead_at")


def _nth_failure(failures: DataFrame, runs: DataFrame, nth: int) -> DataFrame:
    """(message_id, dead_at): ``seq`` of the n-th failure of each message's first run that has so many.

    The first one is taken away n - 1 times by aggregation, so no run is sorted in one task.
    """
    until = F.coalesce(F.col("_until"), F.lit(2**63 - 1))
    first = runs.groupBy("message_id").agg(F.min(until).alias("_end"))
    left = failures.join(first, "message_id").where(until == F.col("_end")).select("message_id", "seq")
    at = left.groupBy("message_id").agg(F.min("seq").alias("_at"))
    for _ in range(nth - 1):
        at = left.join(at, "message_id").where(F.col("seq") > F.col("_at")).groupBy("message_id").agg(F.min("seq").alias("_at"))
    return at.withColumnRenamed("_at", "dead_at")
