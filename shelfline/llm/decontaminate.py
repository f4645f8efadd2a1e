"""Benchmark decontamination by q-gram counts and banded alignment.

Texts are compared by their letters and digits: bytes of UTF-8 without ASCII
signs and white space, A-Z as a-z. A region of REGION bytes begins at every place of
an item (STEP is 1). A region of L bytes that stands in a text with k edits at most keeps
L - Q + 1 - k * Q of its q-grams, on diagonals that lie within k of each other; so
all shared q-grams are counted in diagonal bands that overlap by half, and where a
band has as many as the bound asks for, an alignment within the band decides. A
text is contaminated by an item if one of its regions, or a whole shorter item,
stands in it so. The shortest verbatim passage of a longer item that is always found
has REGION bytes less a region's edits: 66, some 13 words of five letters.

Items of fewer than SHORT bytes must stand there unchanged; those shorter than a
q-gram can't be told from chance and are left out. Items are taken in blocks of
bounded size, each compared with all texts.

Defined cases: null texts and null items match nothing; repeated items and rows are
found each time; empty tables give empty lists; the output column replaces one of
the same name, other columns stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.llm.support import adding, appended, worker_store
from shelfline.llm.wordhash import SLICE_BYTES, _buffers

Q = 8
REGION, STEP, SHORT = 72, 1, 30
EDIT_SHARE = 12
BLOCK_BYTES = 8 << 20
#: Regions aligned at a time.
TOGETHER = 2048
_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_KEPT = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def folded(data: np.ndarray) -> np.ndarray:
    return _FOLDED[data[_KEPT[data]]]


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each place, as its eight bytes."""
    n = max(len(data) - Q + 1, 0)
    return np.ndarray(n, np.uint64, np.ascontiguousarray(data).data, strides=(1,)) if n else np.zeros(0, np.uint64)


def budget(length: int) -> tuple[int, int]:
    """Edits allowed in a region, and the q-grams that it then keeps at least."""
    k = min(length // EDIT_SHARE, (length - Q) // Q) if length >= SHORT else 0
    return k, length - Q + 1 - k * Q


def aligned(regions: np.ndarray, text: np.ndarray, lows: np.ndarray, width: int, k: int) -> bool:
    """Whether a row of ``regions`` stands in ``text`` with k edits at most, on ``width`` diagonals (place in text less place in region) from its low on."""
    places = lows[:, None] + np.arange(width)
    steps = np.arange(width)
    target = np.append(text, 0).astype(np.int16)
    target[-1] = -1  # equal to no byte
    cost = np.where((places >= 0) & (places <= len(text)), 0, k + 1)
    for n in range(regions.shape[1]):
        at = places + n  # byte of the text that the diagonal meets
        inside = (at >= 0) & (at < len(text))
        same = target[np.where(inside, at, len(text))] == regions[:, n, None]
        kept = np.where(inside, cost + ~same, k + 1)
        dropped = np.full_like(cost, k + 2)
        dropped[:, :-1] = cost[:, 1:] + 1
        cost = np.minimum(kept, dropped)
        cost[(at + 1 < 0) | (at + 1 > len(text))] = k + 1
        cost = np.minimum.accumulate(cost - steps, axis=1) + steps
        open_ = cost.min(axis=1) <= k
        if not open_.all():
            regions, places, cost = regions[open_], places[open_], cost[open_]
            if not len(cost):
                return False
    return True


class Index:
    """The regions of a block of items, by q-gram."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [folded(np.frombuffer(t.encode(), np.uint8)) for _, t in items]
        self.longest = max(map(len, self.texts), default=0)
        keys = [grams(t) for t in self.texts]
        item = np.repeat(np.arange(len(items)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, begins = np.unique(every[order], return_index=True)
        self.begins = np.append(begins, len(every))
        self.there = np.zeros(1 << _BITS, bool)
        self.there[(self.keys * _MULTIPLIER) >> np.uint64(64 - _BITS)] = True
        lengths = [min(len(t), REGION) for t in self.texts]
        self.bounds = [budget(n) if n >= Q else (0, 1) for n in lengths]
        self.edits = np.array([b[0] for b in self.bounds], np.int64)
        self.least = np.array([b[1] for b in self.bounds], np.int64)

    def begins_of(self, item: int) -> np.ndarray:
        """Where the regions of an item begin."""
        last = max(len(self.texts[item]) - REGION, 0)
        return np.append(np.arange(0, last, STEP), last)

    def found(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of the texts at ``offsets`` of the folded bytes."""
        every = grams(data)
        at = np.flatnonzero(self.there[(every * _MULTIPLIER) >> np.uint64(64 - _BITS)]) if len(self.keys) else np.zeros(0, np.int64)
        slot = np.searchsorted(self.keys, every[at])
        slot[slot == len(self.keys)] = 0
        hit = self.keys[slot] == every[at] if len(at) else np.zeros(0, bool)
        at, slot = at[hit], slot[hit]
        counts = self.begins[slot + 1] - self.begins[slot]
        total = int(counts.sum())
        if not total:
            return set()
        posting = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.begins[slot], counts)
        at, item, place = np.repeat(at, counts), self.item[posting], self.place[posting]
        diagonal, half = at - place + self.longest, self.edits[item] + 1
        band = diagonal // half
        keys = np.concatenate([item << 40 | band, item << 40 | np.maximum(band - 1, 0)])
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.diff(keys[order], prepend=-1))
        sizes = np.diff(np.append(begins, len(order)))
        enough = sizes >= self.least[keys[order[begins]] >> 40]
        out: set[tuple[int, int]] = set()
        for begin, size in zip(begins[enough].tolist(), sizes[enough].tolist()):
            chosen = order[begin : begin + size] % total
            self._verify(out, int(item[chosen[0]]), int(keys[order[begin]] & (1 << 40) - 1), place[chosen], at[chosen], data, offsets)
        return out

    def _verify(self, out: set, item: int, band: int, places: np.ndarray, at: np.ndarray, whole: np.ndarray, offsets: np.ndarray) -> None:
        k, least = self.bounds[item]
        rows = np.searchsorted(offsets, at, "right") - 1
        low = band * (k + 1) - self.longest
        for row in np.unique(rows).tolist():
            if (row, item) in out:
                continue
            begins, end = self.begins_of(item), min(len(self.texts[item]), REGION)
            own = np.sort(places[rows == row])
            shared = np.searchsorted(own, begins + end - Q, "right") - np.searchsorted(own, begins, "left")
            begins = begins[shared >= least]
            if not len(begins):
                continue
            first = max(int(offsets[row]), int(begins[0]) + low - k)
            last = min(int(offsets[row + 1]), int(begins[-1]) + end + low + 2 * (k + 1) + k)
            if last < first:
                continue
            # The region with most q-grams alone settles nearly every copy.
            likely = int(np.argmax(shared[shared >= least]))
            text, regions = whole[first:last], np.lib.stride_tricks.sliding_window_view(self.texts[item], end)
            lows = begins + low - k - first  # diagonals count from the beginning of the cut-out text
            parts = [slice(likely, likely + 1), *(slice(n, n + TOGETHER) for n in range(0, len(begins), TOGETHER))]
            if regions[begins[likely]].tobytes() in text.tobytes() or any(aligned(regions[begins[p]], text, lows[p], 2 * (k + 1) + 2 * k + 1, k) for p in parts):
                out.add((row, item))


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, folded bytes, their offsets), some megabytes at a time."""
    offsets, body = _buffers(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        data = body[offsets[row] : offsets[stop]]
        kept = np.concatenate([[0], np.cumsum(_KEPT[data])])
        yield row, folded(data), kept[offsets[row : stop + 1] - offsets[row]]
        row = stop


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", items: str = "items") -> DataFrame:
    """``docs`` with the ids of the items that stand in each text, in ascending order."""
    spark = docs.sparkSession
    known = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("t"))
    size = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    found = docs.drop(items)
    for n in range(blocks):
        own = known.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == n)
        part = spark.sparkContext.broadcast([(r.id, r.t) for r in own.orderBy("id", "t").collect()])  # some BLOCK_BYTES
        found = adding(found, _scan(part, uuid.uuid4().hex, text, f"_items{n}"), f"`_items{n}` array<bigint>")
    names = [f"_items{n}" for n in range(blocks)]
    return found.withColumn(items, F.sort_array(F.concat(*names))).drop(*names)


def _scan(part, mark: str, text: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_store(("benchmark", mark), lambda: Index(part.value))
        for batch in batches:
            lists: list[list] = [[] for _ in range(batch.num_rows)]
            for first, data, offsets in _slices(batch.column(text)):
                for row, item in index.found(data, offsets):
                    lists[first + row].append(index.ids[item])
            yield appended(batch, **{name: pa.array(lists, pa.list_(pa.int64()))})

    return run
