"""Token ids in raw shard files, with keyed access through a minimal perfect hash.

A shard is two files: ``.ids`` holds the little-endian ids of its documents one
after the other, ``.idx`` the offsets and the hash that takes a key to its
records. The hash is a cascade of bit arrays: a key sits in the first one in
which no other key shares its bit, and the number of bits set before it is its
slot. A stored fingerprint tells keys that were never put in. Every attempt of a
task writes files of its own, and the manifest names those that count, so a lost
or repeated task leaves no trace but unused files.

Defined cases: a null text has only the end id; a null key sorts first and can be
looked up; records of a repeated key are kept, ordered by text, and found
together; an empty table has a manifest without shards; other columns of the
input are ignored. Keys are integers.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from shelfline.llm.support import Recent, file_bytes, released, small, worker_store

_KINDS = {int: (T.IntegerType(), pa.int32()), str: (T.StringType(), pa.string()), bool: (T.BooleanType(), pa.bool_()), "long": (T.LongType(), pa.int64())}
_FIELDS = {"part": int, "name": str, "documents": "long", "tokens": "long", "width": int, "low": "long", "high": "long", "nulls": bool, "start": "long"}
MANIFEST = T.StructType([T.StructField(name, _KINDS[kind][0]) for name, kind in _FIELDS.items()])
_ARROW = pa.schema([(name, _KINDS[kind][1]) for name, kind in _FIELDS.items()])
FINGERPRINT_SEED = 7
#: Ids that a task reads before it sends them on, or those of one record.
PAYLOAD_IDS = 1 << 20


# Bytes that byte-level vocabularies show as the characters of the same number; the others follow from 256.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
PROBES = ("a", "probe", "größe", "été", "ñandú", "straßenbahnhaltestelle")


def shown(text: str) -> str:
    """The bytes of a text as byte-level vocabularies show them."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES)


class WordEncoder:
    """The library's ids of a text, word by word: no token of a vocabulary that drops white space spans two words."""

    def __init__(self, content: bytes, end_id: int) -> None:
        tokenizer = Tokenizer.from_buffer(content)
        self.kind = np.uint16 if max(tokenizer.get_vocab_size(), end_id) < 1 << 16 else np.uint32
        self.end = self.kind(end_id).tobytes()
        self.whole = lambda part: np.array(tokenizer.encode(part, add_special_tokens=False).ids, self.kind).tobytes()
        model = tokenizer.model
        merged = lambda part: np.array([t.id for t in model.tokenize(shown(part))], self.kind).tobytes()
        # One run of lower-case letters needs the library's merges only, where they start from bytes.
        self.letters = Recent(merged if all(self.whole(p) == merged(p) for p in PROBES) else self.whole)
        self.parts = Recent(self.whole, 20_000)
        self.words = Recent(self.word)

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        letters = text.rstrip(".,")
        # Letters of Latin-1 have one form and one lower case, so their variants share an entry.
        if letters.isalpha() and max(letters) < "Ā":
            return self.letters[letters.lower()] + (self.parts[text[len(letters) :]] if len(letters) < len(text) else b"")
        return self.parts[text]

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split())) + self.end if text else self.end


def mixed(first: np.ndarray, second: np.ndarray, level: int) -> np.ndarray:
    """Hash of the 128-bit keys, one for each level."""
    x = first + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) ^ second
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Takes each of n distinct 128-bit keys to its own number below n."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        ones = [np.bitwise_count(words).astype(np.int64) for words in levels]
        bases = np.cumsum([0, *(int(x.sum()) for x in ones)])
        self.before = [base + np.cumsum(x) - x for base, x in zip(bases, ones)]

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(first):
            bits = 64 * (len(first) // 32 + 1)
            at = (mixed(first, second, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits)[at] == 1
            flags = np.zeros(bits, bool)
            flags[at[alone]] = True
            levels.append(np.packbits(flags, bitorder="little").view(np.uint64))
            first, second = first[~alone], second[~alone]
        return cls(levels)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slots; -1 or any slot for a key that was never put in."""
        slots = np.full(len(first), -1, np.int64)
        open_ = np.arange(len(first))
        for level, words in enumerate(self.levels):
            at = (mixed(first[open_], second[open_], level) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_[found]] = (self.before[level][at >> 6] + below)[found]
            open_ = open_[~found]
        return slots


class ShardIndex:
    """Record ranges by key, and the offset of every record."""

    def __init__(self, arrays) -> None:
        self.arrays = arrays
        self.offsets = arrays["offsets"]
        self.hash = PerfectHash([arrays[f"level{n}"] for n in range(int(arrays["levels"]))])

    @staticmethod
    def pack(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> bytes:
        """The bytes of an index over records whose equal keys are neighbours."""
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begins = np.flatnonzero(new)
        counts = np.diff(np.append(begins, len(first)))
        built = PerfectHash.build(first[begins], second[begins])
        order = np.argsort(built(first[begins], second[begins]))
        levels = {f"level{n}": words for n, words in enumerate(built.levels)}
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        prints = (second[begins] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = io.BytesIO()
        np.savez(out, offsets=offsets, begins=begins[order], counts=counts[order], prints=prints[order], levels=len(levels), **levels)
        return out.getvalue()

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key, none for keys that are not there."""
        if not len(self.arrays["begins"]):
            return np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        slots = self.hash(first, second)
        known = (slots >= 0) & (self.arrays["prints"][slots] == (second & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return self.arrays["begins"][slots], np.where(known, self.arrays["counts"][slots], 0)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{key} has type {kind.simpleString()}, not an integer")
    value = F.col(key).cast("long")
    return df.select(value.alias("key"), F.xxhash64(value).alias("first"), F.xxhash64(F.lit(FINGERPRINT_SEED), value).alias("second"), *[c for c in ("text",) if c in df.columns])


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending key order; returns the manifest.

    ``folder`` must be shared by all executors and reachable by ``pyarrow.fs``.
    There are as many shards as shuffle partitions.
    """
    spark = docs.sparkSession
    content = file_bytes(spark, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_store(("word encoder", vocabulary_path, end_id), lambda: WordEncoder(content.value, end_id))
        files, root = FileSystem.from_uri(folder)
        name, width = uuid.uuid4().hex, encoder.kind(0).itemsize
        out, firsts, seconds, lengths, low, high, nulls = None, [], [], [], None, None, False
        for batch in (part for whole in batches for part in small(whole, "text")):
            out = out or files.open_output_stream(f"{root}/{name}.ids")
            parts = [encoder.encode(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            out.write(b"".join(parts))
            firsts.append(_unsigned(batch.column("first")))
            seconds.append(_unsigned(batch.column("second")))
            lengths.append(np.array([len(p) // width for p in parts], np.int64))
            keys = batch.column("key")
            nulls = nulls or keys.null_count > 0
            keys = keys.drop_null()
            if len(keys):
                low, high = keys[0].as_py() if low is None else low, keys[-1].as_py()
        if out is None:
            return
        out.close()
        sizes = np.concatenate(lengths)
        with files.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(ShardIndex.pack(np.concatenate(firsts), np.concatenate(seconds), sizes))
        row = (TaskContext.get().partitionId(), name, len(sizes), int(sizes.sum()), width, low, high, nulls, 0)
        yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, row))], schema=_ARROW)

    files, root = FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Where one key is on very many rows, its texts' hashes spread it over neighbouring shards.
    dealt = _keyed(rows, key).withColumn("spread", F.xxhash64("text")).repartitionByRange(shards, F.col("key").asc_nulls_first(), "spread")
    ordered = dealt.sortWithinPartitions(F.col("key").asc_nulls_first(), "spread", "text").drop("spread")
    written, start = [], 0
    for row in sorted(ordered.mapInArrow(released(run), MANIFEST).collect(), key=lambda r: r.part):  # one row for each shard
        written.append((*row[:-1], start))
        start += row.tokens
    manifest = spark.createDataFrame(written, MANIFEST)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read_index(files, root: str, name: str) -> ShardIndex:
    with files.open_input_stream(f"{root}/{name}.idx") as file:
        arrays = np.load(io.BytesIO(file.read()))
        return ShardIndex({n: arrays[n] for n in arrays.files})


def look_up(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, payload) of every record of each distinct key; keys without a record give no row.

    ``start`` counts the ids of all records before, ``payload`` has the ids as
    little-endian 32-bit integers. Each shard that some key falls into is opened
    by the task that serves it; a key costs one hash and one read.
    """
    spark: SparkSession = keys.sparkSession
    shards = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: r.part)
    lows = np.array([s.low if s.low is not None else -(2**63) for s in shards], np.int64)
    highs = np.array([s.high if s.high is not None else -(2**63) for s in shards], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("key")
            values = wanted.fill_null(0).to_numpy(zero_copy_only=False)
            begin, end = np.searchsorted(highs, values, "left"), np.searchsorted(lows, values, "right")
            missing = ~wanted.is_valid().to_numpy(zero_copy_only=False)
            begin, end = np.where(missing, 0, begin), np.where(missing, sum(s.nulls for s in shards), np.maximum(begin, end))
            row = np.repeat(np.arange(len(values)), end - begin)
            shard = np.concatenate([np.arange(b, e) for b, e in zip(begin, end)]).astype(np.int32) if len(row) else np.zeros(0, np.int32)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(shard), *taken.columns], names=["shard", *taken.schema.names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)
        at, index, file = -1, None, None
        for batch in batches:
            wanted = batch.column("shard").to_numpy(zero_copy_only=False)
            for number in np.unique(wanted):
                if number != at:
                    if file:
                        file.close()
                    at, index, file = number, _read_index(files, root, shards[number].name), files.open_input_file(f"{root}/{shards[number].name}.ids")
                part = batch.filter(pa.array(wanted == number))
                begins, counts = index.find(_unsigned(part.column("first")), _unsigned(part.column("second")))
                found = np.repeat(np.arange(len(begins)), counts)
                records = np.concatenate([np.arange(b, b + c) for b, c in zip(begins, counts)]).astype(np.int64) if len(found) else np.zeros(0, np.int64)
                width, offsets = shards[number].width, index.offsets
                # Payloads of some megabytes at a time: a shard's records may be of any length.
                filled = np.cumsum(offsets[records + 1] - offsets[records]) // PAYLOAD_IDS
                for some in np.split(np.arange(len(records)), np.flatnonzero(np.diff(filled)) + 1):
                    payloads = []
                    for record in records[some]:
                        raw = file.read_at(int(offsets[record + 1] - offsets[record]) * width, int(offsets[record]) * width)
                        payloads.append(np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(found[some])), pa.array(shards[number].start + offsets[records[some]]), pa.array(payloads, pa.binary())],
                        names=[key, "start", "payload"],
                    )

    schema = T.StructType.fromDDL(f"`{key}` bigint, start bigint, payload binary")
    if not shards:
        return spark.createDataFrame([], schema)
    asked = _keyed(keys.select(key), key).distinct()
    placed = asked.mapInArrow(released(place), "shard int, key bigint, first bigint, second bigint")
    return placed.repartition(len(shards), "shard").sortWithinPartitions("shard", "key").mapInArrow(released(read), schema)
