"""Byte-level BPE encoding and decoding.

A pre-token is a linked list of parts. Each adjacent pair that has a merge rank
lies in that rank's bucket; three levels of 64-bit words say which buckets are
not empty, so that find-first-set gives the lowest rank in three steps however
long the pre-token is. Entries whose pair has changed since are skipped when
they come up.

Defined cases: a null text encodes as the empty text, no ids; a null id list
decodes to no bytes; rows are independent, so ties, repeated rows and empty
tables need nothing special; the output column replaces one of the same name.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from shelfline.llm.support import Recent, adding, appended, file_bytes, small, worker_store


def read_ranks(content: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one pre-token, lowest rank first and leftmost first within a rank."""
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    pair = [rank_of(piece[at : at + 2], -1) for at in range(n - 1)]
    pair.append(-1)
    # Positions by rank, and which ranks have some: 64 ranks to a word, 64 words to a group.
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    groups: dict[int, int] = {}
    top = 0
    new = [(rank, at) for at, rank in enumerate(pair) if rank >= 0]
    while True:
        for rank, at in new:
            bucket = buckets.get(rank)
            if bucket:
                heappush(bucket, at)
                continue
            buckets[rank] = [at]
            word, group = rank >> 6, rank >> 12
            words[word] = words.get(word, 0) | 1 << (rank & 63)
            groups[group] = groups.get(group, 0) | 1 << (word & 63)
            top |= 1 << group
        if not top:
            break
        group = (top & -top).bit_length() - 1
        bits = groups[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = words[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        at = heappop(bucket) if len(bucket) > 1 else bucket.pop()
        if not bucket:
            words[word] = bits = bits & bits - 1
            if not bits:
                groups[group] = bits = groups[group] & groups[group] - 1
                if not bits:
                    top &= top - 1
        new = []
        if pair[at] != rank:
            continue
        gone = end[at]
        stop = end[at] = end[gone]
        pair[gone] = pair[at] = -1
        if stop < n:
            before[stop] = at
            if end[stop] - at <= longest and (found := rank_of(piece[at : end[stop]], -1)) >= 0:
                pair[at] = found
                new.append((found, at))
        left = before[at]
        if left >= 0:
            found = rank_of(piece[left:stop], -1) if stop - left <= longest else -1
            pair[left] = found
            if found >= 0:
                new.append((found, left))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Merger:
    """The same queue over the positions of many short pre-tokens at once.

    Pre-tokens don't touch each other, so the lowest rank of all may go first; of
    one rank each pre-token merges its leftmost pair only, then looks again. Large
    buckets are merged as arrays, small ones entry by entry.
    """

    LARGE = 16

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        joined = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    joined[left << 32 | right] = rank
        self.joined = joined
        self.keys = np.array(sorted(joined), np.int64)
        self.values = np.array([joined[k] for k in self.keys.tolist()] + [-1], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.values[at], -1).astype(np.int32)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        sizes = np.array([len(p) for p in pieces])
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[bounds[1:] - 1] = -1
        before[bounds[:-1]] = -1
        pair = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.rank_of(token[inner], token[inner + 1])
        token_, after_, before_, pair_, piece_ = map(memoryview, (token, after, before, pair, piece))
        joined = self.joined.get

        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        groups: dict[int, int] = {}
        top = 0

        def push(ranks: np.ndarray, places: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            numbers, begins = np.unique(ranks, return_index=True)
            listed = places.tolist()
            for rank, i, j in zip(numbers.tolist(), begins.tolist(), [*begins[1:].tolist(), len(listed)]):
                bucket = buckets.get(rank)
                if bucket:
                    bucket += listed[i:j]
                    continue
                buckets[rank] = listed[i:j]
                word, group = rank >> 6, rank >> 12
                words[word] = words.get(word, 0) | 1 << (rank & 63)
                groups[group] = groups.get(group, 0) | 1 << (word & 63)
                top |= 1 << group

        some = np.flatnonzero(pair >= 0)
        push(pair[some], some)
        while top:
            group = (top & -top).bit_length() - 1
            bits = groups[group]
            word = group << 6 | (bits & -bits).bit_length() - 1
            bits = words[word]
            rank = word << 6 | (bits & -bits).bit_length() - 1
            bucket = buckets.pop(rank)
            words[word] = bits = bits & bits - 1
            if not bits:
                groups[group] = bits = groups[group] & groups[group] - 1
                if not bits:
                    top &= top - 1
            again = []
            if len(bucket) >= self.LARGE:
                at = np.sort(np.array(bucket, np.int32))
                at = at[pair[at] == rank]
                at = at[np.diff(at, prepend=-1) > 0]
                owner = piece[at]
                first = np.ones(len(at), bool)
                first[1:] = owner[1:] != owner[:-1]
                again, at = at[~first].tolist(), at[first]
                gone = after[at]
                stop = after[gone]
                after[at], token[at], pair[gone] = stop, rank, -1
                right = stop >= 0
                before[stop[right]] = at[right]
                pair[at] = -1
                pair[at[right]] = self.rank_of(token[at[right]], token[stop[right]])
                left = before[at]
                has = left >= 0
                left = left[has]
                pair[left] = self.rank_of(token[left], token[at[has]])
                changed = np.concatenate([at, left])
                changed = changed[pair[changed] >= 0]
                if len(changed):
                    push(pair[changed], changed)
                new = ()
            else:
                new, last = [], -1
                bucket.sort()
                for at in bucket:
                    if pair_[at] != rank:
                        continue
                    if piece_[at] == last:
                        again.append(at)
                        continue
                    last = piece_[at]
                    gone = after_[at]
                    stop = after_[at] = after_[gone]
                    token_[at], pair_[gone], pair_[at] = rank, -1, -1
                    if stop >= 0:
                        before_[stop] = at
                        found = joined(rank << 32 | token_[stop], -1)
                        pair_[at] = found
                        if found >= 0:
                            new.append((found, at))
                    left = before_[at]
                    if left >= 0:
                        found = pair_[left] = joined(token_[left] << 32 | rank, -1)
                        if found >= 0:
                            new.append((found, left))
            for at in again:
                new = [*new, (rank, at)]
            for found, at in new:
                bucket = buckets.get(found)
                if bucket:
                    bucket.append(at)
                    continue
                buckets[found] = [at]
                word, group = found >> 6, found >> 12
                words[word] = words.get(word, 0) | 1 << (found & 63)
                groups[group] = groups.get(group, 0) | 1 << (word & 63)
                top |= 1 << group
        heads = np.zeros(n, bool)
        heads[self._chain(after, bounds)] = True
        kept = token[heads].tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(heads)])[bounds]).tolist()
        return [kept[i:j] for i, j in zip(ends[:-1], ends[1:])]

    @staticmethod
    def _chain(after: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of all parts, following the links of every piece side by side."""
        found, at = [], bounds[:-1][np.diff(bounds) > 0]
        while len(at):
            found.append(at)
            at = after[at]
            at = at[at >= 0]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Encoder:
    """Encodes texts; remembers the words, each with the blank before it, that came up lately."""

    # A pre-token starts at every blank that a visible character follows.
    RUNS = re.compile(r"(?= \S)")
    HELD = 200_000
    SHORT = 64
    TOGETHER = 50_000

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.longest, self.ranks, self.find = max(map(len, ranks)), ranks, regex.compile(pattern).findall
        self.merger = Merger(ranks)
        self.pieces = Recent(self.piece, 20_000)
        self.words: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        return array("i", merge(piece.encode(), self.ranks, self.longest)).tobytes()

    def run(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(run)))

    def prepare(self, texts: list[str]) -> None:
        """Learn the words of ``texts`` that aren't known."""
        here: set[str] = set()
        for text in texts:
            here.update(islice(text.split(" "), 1, None))
        if len(self.words) > self.HELD:
            self.words = {w: self.words[w] for w in here & self.words.keys()}
        new = [w for w in here - self.words.keys() if w and len(w) < self.SHORT and not w[0].isspace()]
        # Letters are one pre-token with the blank before them; so are they when a point or comma follows.
        letters = {w for w in new if w.isalpha()}
        ended = [w for w in new if w[-1] in ".," and w[:-1].isalpha()]
        letters.update(w[:-1] for w in ended)
        parted = {}
        for word in new:
            if word not in letters and not (word[-1] in ".," and word[:-1].isalpha()):
                parts = parted[word] = self.find(" " + word)
                letters.update(p[1:] for p in parts if p[0] == " " and p[1:].isalpha())
        unknown = []
        for word in letters - self.words.keys():
            whole = self.ranks.get(b" " + word.encode())
            if whole is None:
                unknown.append(word)
            else:
                self.words[word] = array("i", [whole]).tobytes()
        for at in range(0, len(unknown), self.TOGETHER):
            part = unknown[at : at + self.TOGETHER]
            self.words.update(zip(part, self.merger([b" " + w.encode() for w in part])))
        for word in ended:
            self.words[word] = self.words[word[:-1]] + self.pieces[word[-1]]
        for word, parts in parted.items():
            self.words[word] = b"".join([self.words[p[1:]] if p[0] == " " and p[1:] in letters else self.pieces[p] for p in parts])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        first, *words = text.split(" ")
        try:
            return self.run(first) + b"".join(map(self.words.__getitem__, words))
        except KeyError:  # more than one white space in a row, or a long word
            return b"".join(map(self.run, self.RUNS.split(text)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text`` by the merge ranks of a file, each match of ``pattern`` by itself.

    Without ``keep_text`` the texts don't travel back.
    """
    content = file_bytes(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_store(("byte bpe", ranks_path, pattern), lambda: Encoder(read_ranks(content.value), pattern))
        for batch in batches:
            for part in small(batch, text, 1 << 20):
                texts = [t or "" for t in part.column(text).to_pylist()]
                encoder.prepare(texts)
                raw = [encoder.encode(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
                kept = part if keep_text else part.drop_columns([text])
                yield appended(kept, **{ids: pa.ListArray.from_arrays(pa.array(offsets), values)})

    return adding(docs, run, f"`{ids}` array<int>", without=() if keep_text else (text,))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that ``ids`` stand for."""
    content = file_bytes(encoded.sparkSession, ranks_path)

    def table() -> list[bytes]:
        ranks = read_ranks(content.value)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        return tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_store(("byte bpe tokens", ranks_path), table).__getitem__
        for batch in batches:
            for part in small(batch, ids, 1 << 20):
                column = part.column(ids)
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())]).tolist()
                every = column.flatten().to_numpy().tolist()
                out = [b"".join(map(tokens, every[i:j])) for i, j in zip(offsets[:-1], offsets[1:])]
                yield appended(part, **{decoded: pa.array(out, pa.binary())})

    return adding(encoded, run, f"`{decoded}` binary")
