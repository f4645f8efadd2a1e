import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fixtures import documents, odd_documents, texts
from shelfline.llm import queries, token_files
from shelfline.session import work_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_query_equals_library(spark, sf_dir, library):
    want, start = set(), 0
    for i, t in sorted(texts(spark, sf_dir)):
        ids = ids_of(library, t)
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in queries.op5_token_files(spark, sf_dir).collect()} == want


def test_odd_documents_and_unknown_keys(spark, library):
    folder, docs = work_folder(spark, "tokens"), odd_documents(spark)
    manifest = token_files.write_token_files(docs, folder, PATH, 1)
    assert manifest.agg({"documents": "sum"}).first()[0] == docs.count()
    asked = docs.select("doc_id").union(spark.range(1000, 1100).toDF("doc_id"))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), tuple(np.frombuffer(r.payload, "<u4").tolist())) for r in token_files.look_up(asked, folder).collect())
    want = sorted(((r.doc_id is not None, r.doc_id or 0), tuple(ids_of(library, r.text))) for r in docs.collect())
    assert got == want
    starts = sorted((r.start, len(r.payload) // 4) for r in token_files.look_up(docs.select("doc_id"), folder).collect())
    assert [s for s, _ in starts] == np.concatenate([[0], np.cumsum([n for _, n in starts])[:-1]]).tolist()


def test_empty_table(spark):
    folder, none = work_folder(spark, "tokens"), documents(spark, [])
    assert token_files.write_token_files(none, folder, PATH, 1).count() == 0
    assert token_files.look_up(spark.range(3).toDF("doc_id"), folder).count() == 0


def test_keys_must_be_integers(spark):
    with pytest.raises(TypeError):
        token_files.look_up(spark.createDataFrame([("a",)], "doc_id string").select("doc_id"), _written(spark))


def _written(spark):
    folder = work_folder(spark, "tokens")
    token_files.write_token_files(documents(spark, [(1, "a")]), folder, PATH, 1)
    return folder


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_hash_is_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    first, second = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
    built = token_files.PerfectHash.build(first, second)
    assert sorted(built(first, second).tolist()) == list(range(n))


def test_words_alone_encode_like_the_whole(library):
    with open(PATH, "rb") as file:
        encoder = token_files.WordEncoder(file.read(), 1)
    for text in ["It's I'LL they've 'S 1999 3.5% A.B.C., ..., İstanbul Å Å W̊ ßẞ ΣΣ.", "x y z \x1c \x85 <|endoftext|>. <|ENDOFTEXT|> a<|startoftext|>b", "日本語,テスト! ªº µ."]:
        assert np.frombuffer(encoder.encode(text.encode()), np.uint16).tolist() == ids_of(library, text)
    rng = random.Random(7)
    letters = "aeinrstAEIZéèüßñÉÀÿµªº'.,-1 "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text.encode()), np.uint16).tolist() == ids_of(library, text)


def test_payloads_are_read_some_ids_at_a_time(spark, monkeypatch):
    """A batch of payloads was as large as the records of all keys that came in one batch."""
    docs = spark.createDataFrame([(n // 2, "word " * (n % 7 * 40)) for n in range(60)], "doc_id bigint, text string")
    folder = work_folder(spark, "tokens")
    token_files.write_token_files(docs, folder, PATH, end_id=1)
    found = [sorted(map(tuple, token_files.look_up(docs.select("doc_id"), folder).collect()))]
    monkeypatch.setattr(token_files, "PAYLOAD_IDS", 50)
    found.append(sorted(map(tuple, token_files.look_up(docs.select("doc_id"), folder).collect())))
    assert len(found[0]) == 60 and found[0] == found[1]
