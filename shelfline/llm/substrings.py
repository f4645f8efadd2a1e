"""Removal of passages that earlier documents have.

A window is a number of consecutive words. First pass: every block of documents
counts its windows in the cells of a count-min sketch; the sketches are merged
cell by cell, each range of cells in a task of its own, and each block learns
which of its cells count two or more. An estimate is never too low, so a window
that stands in two places is among those. Second pass: only windows whose cells
all count two or more are grouped, exactly, by their 128-bit hash, with the
smallest id that has them. The sketch's width follows the size of the corpus.

Defined cases: a null text has no words; a null id counts as greater than any
other, and documents with the same id don't remove each other's words; repeated
rows give repeated results; texts shorter than a window keep all; an empty table
gives none. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.llm.exchange import Dealer, from_planes, piece_batch, planes
from shelfline.llm.wordhash import Words, windows, words_of

WINDOW = 13
ROWS = 2
CELL = (np.uint64, np.uint8)
ENTRY = (np.uint64, np.uint64, np.int64, np.int64)
KNOWN = (np.uint64, np.uint64, np.int64)


def hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, at = windows(words, size)
    return first, windows(words, size, salt=1)[0], at


def cells(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each sketch row, as a key whose upper bits deal it out."""
    drop, up = np.uint64(64 - bits), np.uint64(63 - bits)
    return [(h >> drop) << up | np.uint64(row) << np.uint64(63) for row, h in enumerate((first, second))]


def held(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts, which end at 2."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[begins], np.minimum(np.add.reduceat(counts[order].astype(np.int64), begins), 2).astype(np.uint8)


def spanned(first: np.ndarray, second: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Distinct windows with the smallest and the greatest id, and the group of each entry."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    begins = np.flatnonzero(new)
    group = np.empty(len(first), np.int64)
    group[order] = np.cumsum(new) - 1
    return first[begins], second[begins], np.minimum.reduceat(low[order], begins), np.maximum.reduceat(high[order], begins), group


class Repeated:
    """Second pass: sends the windows whose cells all count two or more."""

    def __init__(self, dealer: Dealer, size: int, bits: int) -> None:
        self.dealer, self.size, self.bits = dealer, size, bits

    def prepare(self, payloads: list[list[bytes]]) -> np.ndarray:
        parts = [from_planes(p, np.uint64)[0] for p in payloads[0]]
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def __call__(self, keys: np.ndarray, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        (batch,) = batches
        ids, found = self.dealer.ids(batch), []
        for words in words_of(batch.column("text")):
            first, second, at = hashes(words, self.size)
            some = np.ones(len(first), bool)
            for wanted in cells(first, second, self.bits):
                some[some] = held(keys, wanted[some])
            owner = ids[words.first + words.row_of()[at[some]]]
            found.append((first[some], second[some], owner))
        first, second, owner = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [])
        if not len(first):
            return piece_batch([])
        first, second, low, high, _ = spanned(first, second, owner, owner)
        return piece_batch(self.dealer.pieces(batch.column("block")[0].as_py(), first, second, low, high - low))


class Removal:
    """Last pass: takes out the words that a window with a smaller id covers."""

    def __init__(self, dealer: Dealer, size: int) -> None:
        self.dealer, self.size = dealer, size

    def prepare(self, payloads: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        parts = [from_planes(p, *KNOWN) for p in payloads[0]]
        if not parts:
            return tuple(np.zeros(0, k) for k in KNOWN)
        first, second, low = (np.concatenate(x) for x in zip(*parts))
        first, second, low, _, _ = spanned(first, second, low, low)
        return first, second, low

    def covering(self, known: tuple[np.ndarray, ...], words: Words, ids: np.ndarray) -> np.ndarray:
        """The words at which a window starts that a smaller id has."""
        keys, others, low = known
        if not len(keys):
            return np.zeros(0, np.int64)
        first, second, at = hashes(words, self.size)
        place = np.searchsorted(keys, first)
        place[place == len(keys)] = 0
        same = np.flatnonzero(keys[place] == first)
        place, first, second, at = place[same], first[same], second[same], at[same]
        while len(step := np.flatnonzero(others[place] != second)):  # windows that share half of their hash
            place[step] = np.minimum(place[step] + 1, len(keys) - 1)
            gone = step[(keys[place[step]] != first[step]) | ((place[step] == len(keys) - 1) & (others[place[step]] != second[step]))]
            keep = np.ones(len(place), bool)
            keep[gone] = False
            place, first, second, at = place[keep], first[keep], second[keep], at[keep]
        return at[low[place] < ids[words.first + words.row_of()[at]]]

    def __call__(self, known: tuple[np.ndarray, ...], batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        (batch,) = batches
        ids, kept, total, removed = self.dealer.ids(batch), [], [], []
        for words in words_of(batch.column("text")):
            at = self.covering(known, words, ids)
            n = len(words.hashes)
            change = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + self.size, minlength=n + 1)[: n + 1]
            stays = np.cumsum(change)[:n] == 0
            total.append(np.diff(words.begins))
            removed.append(total[-1] - np.diff(np.concatenate([[0], np.cumsum(stays)])[words.begins]))
            kept += texts_of(words, stays)
        out = [batch.column("id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.concatenate(total)), pa.array(np.concatenate(removed))]
        return pa.RecordBatch.from_arrays(out, names=["id", "kept", "n_words", "n_removed"])


def texts_of(words: Words, stays: np.ndarray) -> list[bytes]:
    """The words of each row that stay, with one blank between two."""
    row, data = words.row_of(), words.data.copy()
    live = np.flatnonzero(stays)
    marks = np.zeros(len(data) + 1, np.int8)
    marks[words.starts[live]] += 1
    marks[words.ends[live]] -= 1
    taken = np.cumsum(marks[:-1]).astype(bool)
    followed = live[:-1][row[live[1:]] == row[live[:-1]]]
    taken[words.ends[followed]] = True
    data[words.ends[followed]] = 32
    lengths = np.bincount(row[live], weights=(words.ends - words.starts)[live], minlength=words.rows).astype(np.int64)
    lengths += np.bincount(row[followed], minlength=words.rows)
    out, ends = data[taken].tobytes(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [out[i:j] for i, j in zip(ends[:-1], ends[1:])]


def remove_repeats(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, n_words, n_removed) of every row."""
    dealer = Dealer(docs, key, text)
    rows = dealer.keyed(docs, text=text)
    # Some four cells or more for each word of usual length.
    bits = min(max(int(dealer.bytes).bit_length(), 16), 62)

    def ask(batch: pa.RecordBatch):
        for words in words_of(batch.column("text")):
            first, second, at = hashes(words, size)
            row = words.first + words.row_of()[at]
            for keys in cells(first, second, bits):
                yield row, keys, np.ones(len(keys), np.uint8)

    def repeated(blocks, parts):
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        distinct, sums = counted(keys, counts)
        busy = distinct[sums >= 2]
        for block, (own, _) in zip(blocks, parts):
            yield int(block), planes(own[held(busy, own)])

    def first_holders(blocks, parts):
        first, second, low, more = (np.concatenate(x) for x in zip(*parts))
        _, _, lowest, highest, group = spanned(first, second, low, low + more)
        known, many = lowest[group], (lowest < highest)[group]
        wanted = many & (known < low + more)
        edges = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        for block, i, j in zip(blocks, edges[:-1], edges[1:]):
            w = wanted[i:j]
            if w.any():
                yield int(block), planes(first[i:j][w], second[i:j][w], known[i:j][w])

    busy = dealer.replied(dealer.gather(rows, ask, counted), CELL, repeated, "cells")
    questions = dealer.on_blocks(rows, [busy], Repeated(dealer, size, bits), "bucket int, block int, payload binary")
    holders = dealer.replied(questions, ENTRY, first_holders, "windows")
    removed = dealer.on_blocks(rows, [holders], Removal(dealer, size), "id bigint, kept string, n_words bigint, n_removed bigint")
    return removed.withColumnRenamed("id", key)
