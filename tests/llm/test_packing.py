import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fixtures import documents, odd_documents, texts
from shelfline.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def plain_pieces(rows, library, capacity):
    """(doc_id, piece, start, length, crc) of every piece."""
    out = []
    for doc_id, text in rows:
        ids = ids_of(library, text)
        bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for piece, (start, stop) in enumerate(zip(bounds, bounds[1:])):
            out.append((doc_id, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    return out


def holds(rows, capacity):
    """Number of sequences, after testing that each is filled without gap or overlap up to the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def first_fit(lengths, capacity):
    """Number of sequences of the plain loop: best fit, longest first, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [n for n, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=lambda n: rooms[n])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_query_equals_library_and_packs_tightly(spark, sf_dir, library):
    got = queries.op13_packing(spark, sf_dir).collect()
    want = plain_pieces(texts(spark, sf_dir), library, 2048)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert holds(got, 2048) <= first_fit([w[3] for w in want], 2048)


def test_odd_documents_and_whole_sequences(spark, library):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(20, "<|endoftext|> a <|endoftext|>"), (21, " \n\n  x")] * 2
    cut = packing.pieces(documents(spark, rows).repartition(3), PATH, public_tokenizers.PATTERN, capacity=64)
    packed = packing.pack(cut, 64, payload=True)
    got = packed.collect()
    want = plain_pieces(rows, library, 64)
    assert Counter((r.key, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    number = holds(got, 64)
    whole = packing.sequences(packed).collect()
    assert len(whole) == number and sum(r.n_tokens for r in whole) == sum(w[3] for w in want)
    inside = {(r.sequence_id, r.offset): bytes(r.payload) for r in got}
    for r in whole:
        assert bytes(r.payload) == b"".join(inside[k] for k in sorted(k for k in inside if k[0] == r.sequence_id))


def test_one_length_on_most_rows(spark, library):
    rows = [(n, "same words here" if n % 10 else f"other {n} " * (n % 37)) for n in range(3000)]
    got = packing.pack(packing.pieces(documents(spark, rows).repartition(9), PATH, public_tokenizers.PATTERN, 100), 100).collect()
    want = plain_pieces(rows, library, 100)
    assert Counter((r.key, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    assert holds(got, 100) <= first_fit([w[3] for w in want], 100)


def test_clashing_columns_and_empty_table(spark, tmp_path):
    odd = odd_documents(spark).selectExpr("*", "1 AS key", "2 AS part", "3 AS length", "4 AS sequence_id")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and holds(got.collect(), 2048) > 0
    none = packing.pieces(documents(spark, []), PATH, public_tokenizers.PATTERN)
    assert packing.pack(none).count() == 0


def filled(counts, capacity, sequences):
    got = Counter()
    for alike in sequences:
        assert alike.number > 0 and alike.room == capacity - sum(n * c for n, c in alike.filling) >= 0
        for length, copies in alike.filling:
            got[length] += copies * alike.number
    assert got == {k: v for k, v in counts.items() if v}
    return sum(alike.number for alike in sequences)


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 16, 50, 300])
    counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(0, 20))}
    made = packing.plan(counts, capacity, rng.choice([1, 3, 48]))
    every = [length for length, n in counts.items() for _ in range(n)]
    assert filled(counts, capacity, made) <= first_fit(every, capacity)
    places = set()
    for length, rank, number, sequence, sequences, offset in packing.runs_of(made).tolist():
        for k in range(number):
            places.add((sequence + k % sequences, offset + k // sequences * length))
    assert len(places) == len(every)


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(5)
    counts = Counter((rng.lognormal(6.4, 0.9, 20_000).astype(int) % 2048 + 1).tolist())
    few, many = packing.plan(counts), packing.plan({k: v * 10**6 for k, v in counts.items()})
    lower = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert filled(counts, 2048, few) <= 1.01 * lower
    assert filled({k: v * 10**6 for k, v in counts.items()}, 2048, many) <= 1.01 * 10**6 * lower
    assert len(packing.runs_of(many)) < 3 * len(packing.runs_of(few))


def test_configurations_beat_best_fit_where_three_must_meet():
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(500, 800, 50_000).tolist())
    plain = sum(a.number for a in packing.best_fit([], counts, 2048))
    assert filled(counts, 2048, packing.plan(counts)) < 0.97 * plain


def test_encoder_equals_library(library):
    with open(PATH, "rb") as file:
        encoder = packing.ByteEncoder(file.read(), public_tokenizers.PATTERN)
    assert encoder.ids.__name__ == "quick"
    rng = random.Random(11)
    letters = "aeinrst'slldvem AZÉß日  \n\t\r.,-1 9<|endoftext|>"
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert encoder.ids(text).tolist() == ids_of(library, text)[:-1]
