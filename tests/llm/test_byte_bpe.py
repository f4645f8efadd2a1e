import random

import public_tokenizers
import pytest
import tiktoken

from fixtures import ODD, odd_documents, sha, texts
from shelfline.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return byte_bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_library(spark, sf_dir, library):
    want = set()
    for i, t in texts(spark, sf_dir):
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode())))
    assert {tuple(r) for r in queries.op1_byte_bpe(spark, sf_dir).collect()} == want


def test_odd_documents(spark, library):
    encoded = byte_bpe.encode(odd_documents(spark), PATH, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, PATH).select("doc_id", "text", "ids", "decoded", "score").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.score == 7


def test_empty_table(spark):
    assert byte_bpe.encode(odd_documents(spark).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_random_white_space_and_signs(ranks, library):
    rng = random.Random(3)
    letters = "aab bc  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'std.,!12é日本​ "
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * n + " " + "ab" * n for n in range(60)]
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    encoder.prepare(drawn)
    for text in drawn:
        assert memoryview(encoder.encode(text)).cast("i").tolist() == library.encode_ordinary(text)


def test_both_queues_agree(ranks):
    rng = random.Random(5)
    longest = max(map(len, ranks))
    pieces = [bytes(rng.choice(b"aeinrst -=") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    merged = byte_bpe.Merger(ranks)(pieces)
    for piece, ids in zip(pieces, merged):
        if piece not in ranks:
            assert memoryview(ids).cast("i").tolist() == byte_bpe.merge(piece, ranks, longest)
