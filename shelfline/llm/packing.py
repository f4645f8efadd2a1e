"""Documents packed into sequences of a fixed number of tokens, by linear grouping.

Texts become token ids, each document's followed by an end id. A document longer
than a sequence is cut into whole sequences, of which the first piece may be
shorter. Only the number of pieces of each length goes to the driver: at most as
many rows as a sequence has places, whatever the corpus. There

* pieces over ``LARGE`` of a sequence are sorted by length and dealt into
  ``GROUPS`` groups of equal cardinality, each rounded up to its longest piece;
* configurations of the few group sizes are optimised by column generation: a
  linear programme over configurations, priced by a knapsack;
* actual lengths take the places of the rounded ones, longest first; what the
  integral part of the optimum leaves over, and the pieces of sequences in which
  the shorter actual lengths leave too much room, join the small pieces;
* these go best-fit, longest first, into the fullest sequences that have room.

The plan is a list of runs: so many pieces of one length, from such a rank on, go
to so many sequences, at such a place. A piece's rank among those of its length
is its number in the task that made it, past the tasks before. So every piece
finds its run by itself, and a length that very many documents share is spread.

Defined cases: a null or empty text is one piece with the end id alone; rows that
repeat an id are packed one by one; a null id is kept; an empty table gives no
rows; columns other than key and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from shelfline.llm.exchange import stored
from shelfline.llm.support import file_bytes, small, worker_store
from shelfline.llm.token_files import _BYTES

CAPACITY = 2048
#: Share of a sequence from which a piece is large.
LARGE = 1 / 8
GROUPS = 48
#: Room, as a share of a sequence, beyond which a filled configuration is opened again (below 0: all); the best of these is taken.
OPENED = (-1, 0, 1 / 512, 1 / 128, 1 / 32, 1 / 8, 1)
#: Rounds of column generation; each adds one configuration, and any stop leaves a valid plan.
ROUNDS = 600
PROBES = ("", "It's  I'LL they've\n\n 1999 3.5% \t x", "größe ÉTÉ 日本語 ß.", "<|endoftext|> a<|endoftext|>", "\n \n end  ")


class ByteEncoder:
    """The ids that the tokenizers library gives for a byte-level BPE file without normaliser.

    The faster library merges by rank alone, so it stands in only if the ids of
    the file's merges ascend and its own ids equal those of the probes.
    """

    def __init__(self, content: bytes, pattern: str) -> None:
        library = Tokenizer.from_buffer(content)
        file = json.loads(content)
        letters = {chr(_BYTES.get(byte, byte)): byte for byte in range(256)}
        special = {token["content"]: token["id"] for token in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): number for token, number in file["model"]["vocab"].items() if token not in special}
        merged = [file["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def slow(text: str) -> np.ndarray:
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

        def quick(text: str) -> np.ndarray:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)

        same = merged == sorted(merged) and all(np.array_equal(slow(p), quick(p)) for p in PROBES)
        self.ids = quick if same else slow


def pieces(docs: DataFrame, vocabulary_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, stored: key, piece, start, length, ids_crc32, payload, part and nth.

    ``payload`` has the ids as little-endian 32-bit integers; ``nth`` counts the
    pieces of one length in the task ``part``.
    """
    content = file_bytes(docs.sparkSession, vocabulary_path)
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_store(("packed ids", vocabulary_path, pattern), lambda: ByteEncoder(content.value, pattern))
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for rows in small(batch, "text", 1 << 20):
                yield _cut(rows, [np.concatenate([encoder.ids(t), end]) if t else end for t in rows.column("text").to_pylist()], capacity, part, seen)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length int, ids_crc32 bigint, payload binary, part int, nth bigint"
    return stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema), "pieces")


def _cut(rows: pa.RecordBatch, ids: list[np.ndarray], capacity: int, part: int, seen: Counter) -> pa.RecordBatch:
    row, piece, start, length, crc, payload, nth = [], [], [], [], [], [], []
    for at, every in enumerate(ids):
        stop = (len(every) - 1) % capacity + 1
        begin = number = 0
        while begin < len(every):
            raw = every[begin:stop].astype("<u4").tobytes()
            for out, value in zip((row, piece, start, length, crc, payload, nth), (at, number, begin, stop - begin, zlib.crc32(raw), raw, seen[stop - begin])):
                out.append(value)
            seen[stop - begin] += 1
            begin, stop, number = stop, stop + capacity, number + 1
    columns = [
        rows.column("key").take(pa.array(row, pa.int64())),
        pa.array(piece, pa.int32()),
        pa.array(start, pa.int64()),
        pa.array(length, pa.int32()),
        pa.array(crc, pa.int64()),
        pa.array(payload, pa.binary()),
        pa.array([part] * len(row), pa.int32()),
        pa.array(nth, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "ids_crc32", "payload", "part", "nth"])


@dataclass
class Alike:
    """``number`` sequences with the same filling: (length, copies) in order, and the ``room`` left in each."""

    number: int
    filling: tuple[tuple[int, int], ...]
    room: int


def grouped(counts: dict[int, int], groups: int = GROUPS) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in groups of equal cardinality as (length, number) runs."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    free = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not free:
                out.append([])
                free = each
            taken = min(left, free)
            out[-1].append((length, taken))
            left, free = left - taken, free - taken
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill a sequence with the greatest worth: a knapsack over all fillings."""
    most = capacity // int(sizes.min())
    value = np.zeros(capacity + 1)
    chosen = np.full((most, capacity + 1), -1, np.int64)
    places = np.arange(capacity + 1)[None, :] - sizes[:, None]
    for step in range(most):
        offered = np.where(places >= 0, value[places], -np.inf) + worth[:, None]
        best = offered.argmax(axis=0)
        top = offered[best, np.arange(capacity + 1)]
        better = top > value + 1e-12
        chosen[step] = np.where(better, best, -1)
        value = np.where(better, top, value)
    filling, room = np.zeros(len(sizes), np.int64), capacity
    for step in reversed(range(most)):
        pick = chosen[step, room]
        if pick >= 0:
            filling[pick] += 1
            room -= int(sizes[pick])
    return filling


def configurations(sizes: list[int], wanted: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations of the sizes and how often the relaxed optimum takes each, rounded down."""
    lengths, demand = np.array(sizes), np.array(wanted, float)
    basis = np.diag(capacity // lengths).astype(float)
    used = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        entering = best_configuration(lengths, worth, capacity)
        if worth @ entering <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, entering.astype(float))
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratios.argmin())
        used = np.maximum(used - ratios[leaving] * step, 0)
        used[leaving] = ratios[leaving]
        basis[:, leaving] = entering
    left, out = list(wanted), []
    for column in np.argsort(-used):
        filling = basis[:, column].astype(int).tolist()
        number = min([int(used[column] + 1e-6)] + [have // n for have, n in zip(left, filling) if n])
        if number:
            left = [have - number * n for have, n in zip(left, filling)]
            out.append((tuple(filling), number))
    return out


def substituted(groups: list[list[tuple[int, int]]], chosen: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[list[Alike], Counter]:
    """Sequences of actual lengths in the places of the rounded ones, and the lengths left over."""
    runs = [list(reversed(group)) for group in groups]  # the longest at the end
    out: list[Alike] = []
    for filling, number in chosen:
        slots = [group for group, copies in enumerate(filling) for _ in range(copies)]
        # Each place of the configuration takes `number` pieces from its group, the longest first.
        taken = [_take(runs[group], number) for group in slots]
        open_ = number
        while open_:
            together = min(run[-1][1] for run in taken)
            lengths = Counter(run[-1][0] for run in taken)
            for run in taken:
                length, count = run.pop()
                if count > together:
                    run.append((length, count - together))
            out.append(Alike(together, tuple(lengths.items()), capacity - sum(n * c for n, c in lengths.items())))
            open_ -= together
    left: Counter = Counter()
    for run in runs:
        for length, count in run:
            left[length] += count
    return out, left


def _take(run: list[tuple[int, int]], number: int) -> list[tuple[int, int]]:
    out = []
    while number:
        length, count = run.pop()
        used = min(count, number)
        if count > used:
            run.append((length, count - used))
        out.append((length, used))
        number -= used
    return out[::-1]


def best_fit(sequences: list[Alike], counts: dict[int, int], capacity: int) -> list[Alike]:
    """The sequences after every piece of ``counts``, longest first, went where the least room is left that holds it."""
    by_room: dict[int, list[Alike]] = {}
    rooms = 0  # bit r: some sequences have r places left

    def put(alike: Alike) -> None:
        nonlocal rooms
        by_room.setdefault(alike.room, []).append(alike)
        rooms |= 1 << alike.room

    for alike in sequences:
        put(alike)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                alike = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                alike = Alike(-(-left // (capacity // length)), (), capacity)
            copies = alike.room // length
            full = min(alike.number, left // copies)
            rest = left - full * copies if full < alike.number else 0
            for number, many in ((full, copies), (1 if rest else 0, rest), (alike.number - full - (1 if rest else 0), 0)):
                if number:
                    filling = (*alike.filling, (length, many)) if many else alike.filling
                    put(Alike(number, filling, alike.room - many * length))
            left -= full * copies + rest
    return [alike for alikes in by_room.values() for alike in alikes]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Alike]:
    """Sequences for ``counts`` pieces of each length; the work depends on the number of lengths alone."""
    large = {length: n for length, n in counts.items() if n and LARGE * capacity < length <= capacity}
    rest = Counter({length: n for length, n in counts.items() if n and length <= LARGE * capacity})
    if not large:
        return best_fit([], rest, capacity)
    joined: dict[int, list[tuple[int, int]]] = {}
    for group in grouped(large, groups):  # neighbouring groups with one rounded size are one
        joined.setdefault(group[0][0], []).extend(group)
    wanted = [sum(n for _, n in group) for group in joined.values()]
    made, left = substituted(list(joined.values()), configurations(list(joined), wanted, capacity), capacity)
    rest += left
    tried = []
    for share in OPENED:
        # Sequences that the substitution left with much room are opened again.
        opened = [alike for alike in made if alike.room > share * capacity]
        pieces_left = rest.copy()
        for alike in opened:
            for length, copies in alike.filling:
                pieces_left[length] += copies * alike.number
        tried.append(best_fit([alike for alike in made if alike.room <= share * capacity], pieces_left, capacity))
    return min(tried, key=lambda sequences: sum(alike.number for alike in sequences))


RUN = ("length", "rank", "number", "sequence", "sequences", "offset")


def runs_of(sequences: list[Alike]) -> np.ndarray:
    """The plan by pieces: rows of RUN, by length and rank."""
    ranks: Counter = Counter()
    rows, first = [], 0
    for alike in sequences:
        offset = 0
        for length, copies in alike.filling:
            rows.append((length, ranks[length], copies * alike.number, first, alike.number, offset))
            ranks[length] += copies * alike.number
            offset += copies * length
        first += alike.number
    return np.array(sorted(rows), np.int64).reshape(-1, len(RUN))


def placed(ranked: DataFrame, sequences: list[Alike]) -> DataFrame:
    """``ranked`` pieces (length, rank) with sequence_id and offset."""
    spark = ranked.sparkSession
    # As many rows as the plan has runs: a few for each length.
    table = spark.sparkContext.broadcast(runs_of(sequences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, width, offset = table.value.T
        key = length << 42 | rank
        for batch in batches:
            have, nth = (batch.column(name).to_numpy().astype(np.int64) for name in ("length", "rank"))
            at = np.searchsorted(key, have << 42 | nth, "right") - 1
            copy, place = np.divmod(nth - rank[at], width[at])
            columns = [pa.array(sequence[at] + place), pa.array(offset[at] + copy * have)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["rank"]).columns, *columns], names=[*[n for n in batch.schema.names if n != "rank"], "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(run, f"{kept}, sequence_id bigint, offset bigint")


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, payload: bool = False) -> DataFrame:
    """The stored ``pieces`` with the sequence and the place of each, and its ids if ``payload``."""
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("_n"))
    made = stored(counts, "lengths")
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one row a length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = made.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = cut.join(shifts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("_shift"))
    kept = ["key", "piece", "start", "length", "ids_crc32", *(["payload"] if payload else []), "rank"]
    return placed(ranked.select(kept), plan(histogram, capacity, groups))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, payload, keys) of every sequence, from ``pack`` with ids: a sequence is one row of bounded size."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "key", "payload")))
    joined = packed.groupBy("sequence_id").agg(inside.alias("_in"), F.sum("length").alias("n_tokens"))
    whole = F.unhex(F.array_join(F.transform("_in", lambda p: F.hex(p["payload"])), ""))
    return joined.select("sequence_id", "n_tokens", whole.alias("payload"), F.transform("_in", lambda p: p["key"]).alias("keys"))
