"""Stock reservation and release in request order, never below zero.

A reserve is accepted iff the stock left covers it, and a refused one consumes
nothing, so a request's fate depends on all earlier ones of its product. Two
facts keep this parallel:

* If all reserves of a product together fit its stock, all are accepted and
  the stock left is a running sum: a window, no Python.
* Otherwise the requests are replayed in order. A product with more than
  ``chunk_rows`` requests is cut into chunks. Each chunk is replayed once for
  all openings it may have, side by side with the others, and yields a transfer
  function from opening to closing stock; composed along the product these give
  every chunk its exact opening (:mod:`shelfline.operators.transfer`), from which
  all chunks are replayed for their outcomes. The openings that a chunk may have
  are bounded by the moves before it.

Where some chunk of a product may have more than ``TABLE`` openings, chunks are
replayed from guessed openings instead. Such a replay reports for which openings
its decisions hold, so a wrong guess often settles the chunk all the same; the
others replay again. The first open chunk always has its exact opening and hands
its stock on to those after it, twice as many in every round.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfline.operators.ordered import CHUNK_ROWS, cut_rows, hot_keys, key_sizes
from shelfline.operators.transfer import MAP, Openings, as_table, opening_stocks
from shelfline.session import durable, small_side, written

RESERVED = "RESERVED"
RELEASED = "RELEASED"
INSUFFICIENT = "INSUFFICIENT"
INVALID_QUANTITY = "INVALID_QUANTITY"
INVALID_OPERATION = "INVALID_OPERATION"

# Openings for which a chunk is replayed at once.
TABLE = 1 << 20

# Over how many groups the refused rows of one product are spread.
REFUSED_CHUNKS = 4096


def _units(op: str) -> Column:
    """Units a row moves if it is an ``op``, else 0."""
    return F.when(F.col("op") == op, F.col("quantity")).otherwise(F.lit(0)).cast("bigint")


def _moves() -> tuple[Column, Column]:
    return F.sum(_units("RESERVE")).alias("_take"), F.sum(_units("RELEASE")).alias("_give")


def _net() -> Column:
    return _units("RELEASE") - _units("RESERVE")


def reserve_stock(products: DataFrame, requests: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every request with its ``outcome`` and the product's stock ``remaining`` after it.

    ``requests`` has ``request_id``, ``seq`` (unique processing order),
    ``product_id``, ``quantity`` and ``op`` (RESERVE or RELEASE). A reserve of
    an unknown product is INSUFFICIENT; a release of one is RELEASED and
    changes nothing. ``remaining`` is null where no product is involved.

    One pass sizes the products' demand before the lazy result is returned.
    """
    refusal = (
        F.when(F.coalesce(F.col("quantity"), F.lit(0)) < 1, INVALID_QUANTITY)
        .when(~F.coalesce(F.col("op").isin("RESERVE", "RELEASE"), F.lit(False)), INVALID_OPERATION)
        .when(F.col("product_id").isNull(), F.when(F.col("op") == "RESERVE", INSUFFICIENT).otherwise(RELEASED))
    )
    valid = requests.where(refusal.isNull())

    stock = products.select(F.col("id").alias("product_id"), F.col("stock").cast("bigint").alias("_stock"))
    demand = durable(key_sizes(valid, "product_id", *_moves()).join(stock, "product_id", "left"))
    is_contended = F.col("_take") > F.col("_stock")
    hot = hot_keys(demand, "product_id", chunk_rows)
    tasks = _tasks(requests, demand.agg(F.sum("_rows")).first()[0] or 0, chunk_rows)
    chunk_zero = F.lit(0).cast("bigint").alias("chunk")
    one_chunk = demand.where(F.col("_rows") <= chunk_rows).select(
        "product_id", chunk_zero, F.col("_stock").alias("_opening"), is_contended.alias("_contended")
    )
    # Refused rows take no part; their chunks only spread them.
    spread = F.when(F.col("_refusal").isNotNull(), -1 - F.pmod(F.xxhash64("request_id"), F.lit(REFUSED_CHUNKS))).otherwise(F.lit(0))
    chunked = requests.withColumn("_refusal", refusal).withColumn("chunk", spread.cast("bigint"))
    openings = one_chunk
    if not hot.isEmpty():
        cut = cut_rows(valid, "product_id", "seq", hot, chunk_rows)
        uncut = chunked.join(small_side(hot.select("product_id", chunk_zero)), ["product_id", "chunk"], "left_anti")
        chunked = uncut.unionByName(cut.withColumn("_refusal", F.lit(None).cast("string")))
        openings = one_chunk.unionByName(_hot_openings(cut, demand, is_contended, tasks))

    unknown = F.col("_opening").isNull()
    known = chunked.join(openings.where(unknown | ~F.col("_contended")).withColumn("_calm", F.lit(True)), ["product_id", "chunk"], "left")
    at_rest = known.where(F.col("_refusal").isNotNull() | F.col("_calm"))
    contended = chunked.where(F.col("_refusal").isNull()).join(openings.where(F.col("_contended")), ["product_id", "chunk"])

    so_far = Window.partitionBy("product_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(F.col("op") == "RELEASE", RELEASED).when(unknown, INSUFFICIENT).otherwise(RESERVED)
    summed = at_rest.select(
        *requests.columns,
        F.coalesce("_refusal", decided).alias("outcome"),
        F.when(F.col("_refusal").isNull(), F.col("_opening") + F.sum(_net()).over(so_far)).alias("remaining"),
    )
    added = [T.StructField("outcome", T.StringType()), T.StructField("remaining", T.LongType())]
    moves = contended.select(*requests.columns, "chunk", "_opening", _net().alias("_move"))
    replayed = _in_request_order(moves, tasks).mapInArrow(_replay_rows, T.StructType([*requests.schema, *added]))
    return summed.unionByName(replayed)


def remaining_stock(products: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The product table after the outcomes of :func:`reserve_stock`; stock that its type no longer holds is null."""
    moved = (
        outcomes.where(F.col("outcome").isin(RESERVED, RELEASED))
        .groupBy(F.col("product_id").alias("id"))
        .agg(F.sum(_net()).alias("_moved"))
    )
    stock = (F.col("stock") + F.coalesce("_moved", F.lit(0).cast("bigint"))).try_cast(products.schema["stock"].dataType)
    return products.join(moved, "id", "left").withColumn("stock", stock).select(products.columns)


def _in_request_order(rows: DataFrame, tasks: int, run: str = "chunk") -> DataFrame:
    """Each run of chunks in one task, by ``seq``. The explicit count keeps AQE from merging all into one task."""
    keys = dict.fromkeys(["product_id", run, "chunk"])
    return rows.repartition(tasks, "product_id", run).sortWithinPartitions(*keys, "seq")


def _tasks(df: DataFrame, rows: int, chunk_rows: int) -> int:
    """Tasks that replay: as many as shuffles have, more if each would have more rows than a chunk."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(chunk_rows, CHUNK_ROWS)))


def _hot_openings(rows: DataFrame, demand: DataFrame, is_contended: Column, tasks: int) -> DataFrame:
    """Opening stock of every chunk of the cut products, given their rows."""
    totals = rows.groupBy("product_id", "chunk").agg(*_moves())
    product = demand.select("product_id", "_stock", is_contended.alias("_contended"))
    chunks = durable(totals.join(product, "product_id"))

    before = Window.partitionBy("product_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("_give") - F.col("_take")).over(before), F.lit(0))
    calm = chunks.where(~F.coalesce(F.col("_contended"), F.lit(False))).select(
        "product_id", "chunk", (F.col("_stock") + moved).alias("_opening"), "_contended"
    )
    contended = chunks.where(F.col("_contended"))
    if contended.isEmpty():
        return calm
    replayable = written(
        rows.join(small_side(contended.select("product_id", "chunk")), ["product_id", "chunk"], "left_semi").select(
            "product_id", "chunk", "seq", _net().alias("_move")
        ),
        "contended",
    )
    reached = durable(_reached(replayable, contended))
    wide = reached.groupBy("product_id").agg(F.max(F.col("_last") - F.col("_first")).alias("_wide")).where(F.col("_wide") >= TABLE)
    settled = _transferred(replayable, reached.join(wide, "product_id", "left_anti"), tasks)
    if not wide.isEmpty():
        guessed = contended.join(wide, "product_id", "left_semi")
        settled = settled.unionByName(_settle(replayable.join(wide, "product_id", "left_semi"), guessed, tasks))
    return calm.unionByName(settled.withColumn("_contended", F.lit(True)))


def _reached(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks numbered along each product, with the openings ``_first`` to ``_last`` that each may have.

    After a chunk the stock is at most what all its moves add to the opening, or
    one less than a request that it refused and all that moved after. A chunk
    whose opening covers its lowest running sum accepts everything.
    """
    within = Window.partitionBy("product_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    refused = F.max(F.when(F.col("_move") < 0, -F.col("_move") - 1 - F.col("_sum")))
    bounds = rows.withColumn("_sum", F.sum("_move").over(within)).groupBy("product_id", "chunk").agg(
        F.sum("_move").alias("_net"), refused.alias("_refused"), F.max(-F.col("_sum")).alias("_need")
    )
    along = Window.partitionBy("product_id").orderBy("chunk")
    numbered = chunks.select("product_id", "chunk", "_stock").join(bounds, ["product_id", "chunk"])
    summed = numbered.withColumn("at", F.row_number().over(along).cast("bigint") - 1).withColumn("_before", F.sum("_net").over(along) - F.col("_net"))
    closing = F.col("_before") + F.col("_net") + F.greatest(F.col("_stock"), F.max(F.col("_refused") - F.col("_before")).over(along))
    opening = F.lag("_closing").over(along)
    return summed.withColumn("_closing", closing).select(
        "product_id",
        "chunk",
        "at",
        "_stock",
        F.when(F.col("at") == 0, F.col("_stock")).otherwise(F.lit(0)).alias("_first"),
        F.when(F.col("at") == 0, F.col("_stock")).otherwise(F.greatest(F.lit(0), F.least(opening, F.col("_need")))).alias("_last"),
    )


def _transferred(rows: DataFrame, reached: DataFrame, tasks: int) -> DataFrame:
    """Exact opening of every chunk by its transfer function and those before it."""
    moves = rows.join(small_side(reached.select("product_id", "chunk", "at", "_first", "_last")), ["product_id", "chunk"])
    maps = durable(_in_request_order(moves, tasks).mapInArrow(_functions, f"product_id {_key_type(reached)}, at bigint, {MAP}"))
    starts = reached.where(F.col("at") == 0).select("product_id", F.col("_stock").alias("opening"))
    opened = opening_stocks(maps, starts, "product_id").withColumnRenamed("opening", "_opening")
    return reached.select("product_id", "chunk", "at").join(opened, ["product_id", "at"]).select("product_id", "chunk", "_opening")


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its transfer function. Memory holds one batch and one chunk's openings."""
    key = openings = held = None
    for batch in batches:
        moves = batch.column("_move").to_numpy()
        for start, stop in _segments(batch.column("product_id"), batch.column("chunk")):
            row = batch.slice(start, 1)
            here = (row.column("product_id")[0].as_py(), row.column("chunk")[0].as_py())
            if here != key:
                if key is not None:
                    yield from as_table(*held, openings.transfer(), "product_id").to_batches()
                key, held = here, (row.column("product_id"), row.column("at"))
                openings = Openings(row.column("_first")[0].as_py(), row.column("_last")[0].as_py())
            openings.play(moves[start:stop])
    if key is not None:
        yield from as_table(*held, openings.transfer(), "product_id").to_batches()


def _settle(rows: DataFrame, chunks: DataFrame, tasks: int) -> DataFrame:
    """Exact opening of every chunk: follow the known spans, replay what they leave open, until nothing is."""
    spans = rows.sparkSession.createDataFrame([], _span_schema(chunks))
    for attempt in itertools.count():
        known = spans.groupBy("product_id", "chunk").agg(F.collect_list(F.struct("low", "high", "change")).alias("spans"))
        walk = chunks.join(known, ["product_id", "chunk"], "left").select(
            "product_id", "chunk", "_stock", (F.col("_give") - F.col("_take")).alias("net"), "spans"
        )
        lead = 2**attempt
        # One row per chunk: a product sends its rows / chunk_rows rows to one task, and AQE picks the few tasks needed.
        walked = durable(
            walk.repartition("product_id")
            .sortWithinPartitions("product_id", "chunk")
            .mapInArrow(lambda batches, lead=lead: _follow(batches, lead), _walked_schema(chunks))
        )
        to_replay = walked.where(F.col("run").isNotNull()).select("product_id", "chunk", "run", "_opening")
        if to_replay.isEmpty():
            return walked.select("product_id", "chunk", "_opening")
        fresh = _in_request_order(rows.join(to_replay, ["product_id", "chunk"]), tasks, "run").mapInArrow(
            _replay_spans, _span_schema(chunks)
        )
        spans = durable(spans.unionByName(fresh))


def _key_type(chunks: DataFrame) -> str:
    return chunks.schema["product_id"].dataType.simpleString()


def _span_schema(chunks: DataFrame) -> str:
    return f"product_id {_key_type(chunks)}, chunk bigint, low bigint, high bigint, change bigint"


def _walked_schema(chunks: DataFrame) -> str:
    return f"product_id {_key_type(chunks)}, chunk bigint, _opening bigint, run bigint"


def _follow(batches: Iterator[pa.RecordBatch], lead: int) -> Iterator[pa.RecordBatch]:
    """Pass the stock from chunk to chunk through the spans that cover it; guess across open chunks.

    Chunks with a ``run`` need a replay. A product's first open chunk and the
    ``lead - 1`` after it form one run, in which only the first has an
    opening and the others take over what is left.
    """
    product, left, led = None, 0, None
    for batch in batches:
        openings, runs = [], []
        for row in batch.to_pylist():
            if row["product_id"] != product:
                product, left, led = row["product_id"], row["_stock"], None
            change = next((s["change"] for s in row["spans"] or () if s["low"] <= left <= s["high"]), None)
            if led is None and change is None:
                led = [row["chunk"], lead]
                openings.append(left)
                runs.append(row["chunk"])
            elif led and led[1] > 1:
                led[1] -= 1
                openings.append(None)
                runs.append(led[0])
            else:
                openings.append(left)
                runs.append(row["chunk"] if change is None else None)
            left = left + change if change is not None else max(0, left + row["net"])
        columns = [batch.column("product_id"), batch.column("chunk"), pa.array(openings, pa.int64()), pa.array(runs, pa.int64())]
        yield pa.record_batch(columns, ["product_id", "chunk", "_opening", "run"])


_CODES = (RESERVED, INSUFFICIENT, RELEASED)
_UNBOUNDED = 2**62


def _replay(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[pa.RecordBatch, dict[int, int], np.ndarray, np.ndarray]]:
    """Each batch with the rows that open a chunk and the stock there, the outcome codes, and the stock after every row.

    The stock carries over from batch to batch, so memory holds one batch
    however long a chunk is, and into a chunk without an opening of its own.
    """
    key, left = None, 0
    for batch in batches:
        product, chunk, opening = (batch.column(name) for name in ("product_id", "chunk", "_opening"))
        move = batch.column("_move").to_numpy()
        moves = move.tolist()
        opened, remaining, previous = {}, [], []
        for start, stop in _segments(product, chunk):
            here = (product[start].as_py(), chunk[start].as_py())
            if here != key:
                key = here
                left = opening[start].as_py() if opening[start].is_valid else left
                opened[start] = left
            previous.append(left)
            for units in moves[start:stop]:
                if left + units >= 0:
                    left += units
                remaining.append(left)
            previous.extend(remaining[start : stop - 1])
        after = np.array(remaining, np.int64)
        refused = after == np.array(previous, np.int64)
        yield batch, opened, np.where(move > 0, 2, np.where(refused, 1, 0)).astype(np.int8), after


def _segments(product: pa.Array, chunk: pa.Array) -> list[tuple[int, int]]:
    """Stretches of rows of one chunk of one product."""
    if not len(chunk):
        return []
    moved = np.diff(product.dictionary_encode().indices.to_numpy()) | np.diff(chunk.to_numpy())
    starts = [0, *(np.flatnonzero(moved) + 1).tolist()]
    return list(zip(starts, [*starts[1:], len(chunk)]))


def _replay_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, codes, remaining in _replay(batches):
        result = batch.drop_columns(["chunk", "_opening", "_move"])
        outcomes = pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(_CODES)).cast(pa.string())
        yield result.append_column("outcome", outcomes).append_column("remaining", pa.array(remaining))


def _replay_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: between which openings its decisions stay the same, and its change of stock."""
    chunk, kind = None, None
    for batch, opened, codes, remaining in _replay(batches):
        if not len(codes):
            continue
        kind = batch.schema.field("product_id").type
        wanted = -batch.column("_move").to_numpy()
        starts = list(dict.fromkeys([0, *opened]))
        # An accepted request allows less stock down to nothing left, a refused one more up to just short of it.
        down = np.minimum.reduceat(np.where(codes == 0, remaining, _UNBOUNDED), starts)
        up = np.minimum.reduceat(np.where(codes == 1, wanted - remaining - 1, _UNBOUNDED), starts)
        ended = []
        for start, stop, less, more in zip(starts, [*starts[1:], len(codes)], down.tolist(), up.tolist()):
            if start in opened:
                if chunk is not None:
                    ended.append(chunk)
                chunk = {name: batch.column(name)[start].as_py() for name in ("product_id", "chunk")}
                chunk.update(opening=opened[start], down=_UNBOUNDED, up=_UNBOUNDED)
            chunk.update(down=min(chunk["down"], less), up=min(chunk["up"], more), left=int(remaining[stop - 1]))
        yield _spans(ended, kind)
    if chunk is not None:
        yield _spans([chunk], kind)


def _spans(chunks: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "product_id": pa.array([c["product_id"] for c in chunks], kind),
            "chunk": pa.array([c["chunk"] for c in chunks], pa.int64()),
            "low": pa.array([c["opening"] - c["down"] for c in chunks], pa.int64()),
            "high": pa.array([c["opening"] + c["up"] for c in chunks], pa.int64()),
            "change": pa.array([c["left"] - c["opening"] for c in chunks], pa.int64()),
        }
    )
