"""Words of many texts at once, as 64-bit hashes.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


@dataclass
class Words:
    """The words of consecutive rows: ``begins[i]`` to ``begins[i + 1]`` are those of row ``first + i``."""

    first: int
    begins: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.begins) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.begins))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of a followed by b."""
    x = (a + np.uint64(salt)) * _K1
    x = (x ^ (x >> np.uint64(32))) * _K3 + b
    return mix(x)


def windows(words: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words within a row, and the number of the word where each starts."""
    h, n = words.hashes, len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, done, power, width = None, 0, h, 1
    while True:
        if size & width:
            part = power[done : done + n]
            out = pair(part, np.uint64(size), salt) if out is None else pair(out, part, salt)
            done += width
        width *= 2
        if width > size:
            break
        power = pair(power[: len(power) - width // 2], power[width // 2 :], salt)
    row = words.row_of()
    inside = np.flatnonzero(row[:n] == row[size - 1 :])
    return out[inside], inside


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of the texts; null texts are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return offsets, data


def words_of(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of all rows, some megabytes of text at a time (one row at least)."""
    offsets, body = _buffers(texts)
    row, rows = 0, len(texts)
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield _slice(row, offsets[row : stop + 1] - offsets[row], body[offsets[row] : offsets[stop]], lower)
        row = stop


def _slice(first: int, offsets: np.ndarray, data: np.ndarray, lower: bool) -> Words:
    size = len(data)
    data = np.concatenate([_LOWER[data] if lower else data, np.full(8, 32, np.uint8)])
    inside = ~_SPACE[data]
    opens, closes = inside[:size].copy(), inside[:size].copy()
    opens[1:] &= ~inside[: max(size - 1, 0)]
    closes &= ~inside[1 : size + 1]
    cut = np.unique(offsets[(offsets > 0) & (offsets < size)])
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    eights = np.ndarray(max(size, 1), np.uint64, data.data, strides=(1,))
    lengths = ends - starts
    hashes = lengths.astype(np.uint64) * _K1
    at, open_, left = starts, np.arange(len(starts)), lengths
    while len(open_):
        hashes[open_] = pair(hashes[open_], eights[at] & _MASKS[np.minimum(left, 8)])
        longer = left > 8
        at, open_, left = at[longer] + 8, open_[longer], left[longer] - 8
    return Words(first, np.searchsorted(starts, offsets), hashes, starts, ends, data)
