"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_store(key: tuple, make: Callable):
    """One object of each kind (``key[0]``) per Python worker process, built on first use and shared by its tasks.

    Another key of the kind replaces it, so a worker that lives on holds no more.
    """
    home = sys.modules.setdefault("shelfline_worker_store", types.ModuleType("shelfline_worker_store"))
    held = home.__dict__.setdefault("held", {})
    if held.get(key[0], (None,))[0] != key:
        held.pop(key[0], None)
        held[key[0]] = (key, make())
    return held[key[0]][1]


class Recent(dict):
    """``make(key)`` by key, remembering the keys used lately: between ``bound`` and twice as many.

    Text keys over 64 characters are made anew each time, so the memory is bounded too.
    """

    def __init__(self, make: Callable, bound: int = 300_000) -> None:
        super().__init__()
        self.make, self.bound, self.older = make, bound, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = value


def file_bytes(spark: SparkSession, path: str):
    """A vocabulary file (a few MB, whatever the corpus) read on the driver for all tasks."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def released(run: Callable) -> Callable:
    """``run`` over batches, after which the worker process gives its free memory back, for it lives on into other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def adding(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of the DDL ``added``, which ``run`` appends to each batch after dropping ``without``.

    Columns of ``df`` with the same names are replaced.
    """
    new = T.StructType.fromDDL(added)
    old = df.drop(*new.names)
    return old.mapInArrow(released(run), T.StructType([f for f in old.schema.fields if f.name not in without] + new.fields))


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def small(batch: pa.RecordBatch, column: str, bytes_each: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some megabytes of ``column``, one row at least."""
    each = max(1, int(batch.num_rows * bytes_each / max(batch.column(column).nbytes, 1)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def text_crc(column: str = "doc_id"):
    """crc32 of the id written as text, which deals documents into folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
