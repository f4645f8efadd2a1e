"""Questions of document blocks about keys that occur all over the corpus.

Documents are dealt into blocks by their id. Each block sends every key it holds
once, with numbers reduced in the block, to the bucket that the key's upper bits
name; a bucket answers each block. So a key that very many documents share comes
up once for each block at most, whatever share of the rows has it. A task works on
one block or bucket at a time; their number follows the bytes of the corpus, so
that each has a few megabytes at every size. Keys travel as sorted arrays, written byte plane by byte plane as
differences, which the shuffle compresses well.

Blocks follow the quantiles of the id. Where one id fills several of them its
rows are spread over these by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfline.session import remove_folder, work_folder

#: A null id counts as greater than any other.
NO_ID = np.int64(2**63 - 1)
#: Entries that a task gathers before it sends them.
HELD = 2_000_000
#: Bytes of text in a block, and of the text whose keys a bucket has.
BLOCK_BYTES, BUCKET_BYTES = 3 << 20, 2 << 20
#: Cuts of the id that the driver holds; beyond them a hash of the text divides further.
CUTS = 4096
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes of a batch that goes to Python; Spark's own bound lets a task hold 64 MB several times.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Jobs in here run under a setting of the session, which comes back after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Jobs in here remove their shuffle files when they end."""
    return setting(spark, CLEANUP, "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table beside the checkpoints, its shuffle files removed."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    with shuffles_removed(spark), setting(spark, BATCH, str(BATCH_BYTES)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing reads any more, so that they don't stay on disk until the session ends."""
    for table in tables:
        for folder in {unquote(file).rpartition("/")[0] for file in table.inputFiles()}:
            remove_folder(table.sparkSession, folder)


def planes(*arrays: np.ndarray, ordered: bool = True) -> bytes:
    """Arrays of equal length as bytes, plane by plane; if ``ordered``, the first is sorted and written as differences."""
    first, *others = arrays
    if not len(first):
        return b""
    out = [np.diff(first, prepend=first.dtype.type(0)) if ordered else first, *others]
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in out)


def from_planes(raw: bytes, *kinds, ordered: bool = True) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        part = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(n))
        at += n * size
    if ordered:
        out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


class Dealer:
    """Blocks and buckets for one corpus."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        self.key = key
        self.bytes = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
        wanted_blocks = max(2, -(-self.bytes // BLOCK_BYTES))
        self.shelves = min(wanted_blocks, CUTS)
        self.each = -(-wanted_blocks // self.shelves)
        self.bits = max(2, int(self.bytes // BUCKET_BYTES).bit_length())
        cuts = F.array(*[F.lit(n / self.shelves) for n in range(1, self.shelves)])
        bounds = docs.agg(F.percentile_approx(F.col(key).cast("long"), cuts, 10 * self.shelves).alias("b")).first().b
        self.bounds = np.array(bounds or [], np.int64)

    def keyed(self, docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
        """The id, the text and ``columns``, as the functions here read them."""
        spread = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
        return docs.select(F.col(self.key).cast("long").alias("id"), F.col(text).alias("text"), spread.alias("spread"), *columns)

    def ids(self, batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column("id")
        return (column.fill_null(int(NO_ID)) if column.null_count else column).to_numpy(zero_copy_only=False)

    def block_of(self, batch: pa.RecordBatch) -> np.ndarray:
        ids = self.ids(batch)
        low, high = np.searchsorted(self.bounds, ids, "left"), np.searchsorted(self.bounds, ids, "right")
        if not len(self.bounds):
            low, high = low * 0, low * 0 + self.shelves - 1
        spread = batch.column("spread").to_numpy(zero_copy_only=False)
        return ((low + spread % (high - low + 1)) * self.each + (spread >> 32) % self.each).astype(np.int32)

    def pieces(self, block: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(bucket, block, payload) for sorted keys."""
        buckets = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        begins = np.flatnonzero(np.diff(buckets, prepend=-1))
        return [(int(buckets[i]), block, planes(keys[i:j], *(v[i:j] for v in values))) for i, j in zip(begins, [*begins[1:], len(keys)])]

    def gather(
        self,
        docs: DataFrame,
        entries: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]],
        reduce: Callable[..., tuple[np.ndarray, ...]],
    ) -> DataFrame:
        """(bucket, block, payload) rows of the questions that ``docs`` (from ``keyed``) ask.

        ``entries`` gives (row of the batch, key, values...) arrays for a batch,
        ``reduce`` takes (keys, values...) of one block and returns them with
        sorted distinct keys.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for batch in batches:
                blocks = self.block_of(batch)
                for rows, *arrays in entries(batch):
                    held.append((blocks[rows], *arrays))
                    size += len(rows)
                    if size >= HELD:
                        yield from self._sent(held, reduce)
                        held, size = [], 0
            if held:
                yield from self._sent(held, reduce)

        return docs.mapInArrow(run, "bucket int, block int, payload binary")

    def _sent(self, held, reduce) -> Iterator[pa.RecordBatch]:
        blocks, *arrays = (np.concatenate(a) for a in zip(*held))
        order = np.argsort(blocks, kind="stable")
        numbers, begins = np.unique(blocks[order], return_index=True)
        for number, rows in zip(numbers, np.split(order, begins[1:])):
            yield piece_batch(self.pieces(int(number), *reduce(*(a[rows] for a in arrays))))

    def replied(self, questions: DataFrame, kinds: tuple, answer: Callable, folder: str) -> DataFrame:
        """(block, payload) rows, stored: ``answer`` gets the blocks' arrays of one bucket and returns (block, payload) pairs."""

        def run(table: pa.Table) -> pa.Table:
            blocks = table.column("block").to_numpy()
            raw = table.column("payload").to_pylist()
            parts = list(answer(blocks, [from_planes(r, *kinds) for r in raw]))
            return pa.table({"block": pa.array([p[0] for p in parts], pa.int32()), "payload": pa.array([p[1] for p in parts], pa.binary())})

        return stored(questions.groupBy("bucket").applyInArrow(run, "block int, payload binary"), folder)

    def on_blocks(self, docs: DataFrame, answers: list[DataFrame], run, schema: str, whole: bool = False) -> DataFrame:
        """``run(run.prepare(payloads by answer table), batches)`` on every block.

        The answers of a block come before its documents, which follow batch by
        batch, or all at once if ``whole``.
        """
        fields, count = docs.schema.fields, len(answers)

        def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(self.block_of(batch)), *batch.columns], names=["block", *batch.schema.names])

        dealt = docs.mapInArrow(blocked, T.StructType([T.StructField("block", T.IntegerType()), *fields]))
        rows = dealt.select("block", F.lit(count).alias("kind"), F.lit(None).cast("binary").alias("payload"), *docs.columns)
        for n, table in enumerate(answers):
            told = table.select("block", F.lit(n).alias("kind"), "payload", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
            rows = rows.unionByName(told)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, payloads, state, held = None, None, None, []
            for batch in batches:
                blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
                edges = np.concatenate([[0], np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1, [len(blocks)]])
                for i, j in zip(edges[:-1], edges[1:]):
                    if j == i:
                        continue
                    if blocks[i] != at:
                        if held:
                            yield run(state[0], held)
                        at, payloads, state, held = blocks[i], [[] for _ in range(count)], None, []
                    if kinds[i] < count:
                        payloads[kinds[i]] += batch.column("payload").slice(i, j - i).to_pylist()
                        continue
                    if state is None:
                        state, payloads = (run.prepare(payloads),), None
                    held.append(batch.slice(i, j - i))
                    if not whole:
                        yield run(state[0], held)
                        held = []
            if held:
                yield run(state[0], held)

        return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(each, schema)


def piece_batch(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.binary())],
        names=["bucket", "block", "payload"],
    )
