import random

from fixtures import documents, odd_documents, sha, texts, words
from shelfline.llm import queries, substrings

SIZE = 13


def plain(rows, size=SIZE):
    """(doc_id, kept, n_words, n_removed) for every row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for at in range(len(w) - size + 1):
            window, own = tuple(w[at : at + size]), float("inf") if i is None else i
            first[window] = min(first.get(window, own), own)
    out = []
    for i, t in rows:
        w, own = words(t), float("inf") if i is None else i
        gone = set()
        for at in range(len(w) - size + 1):
            if first[tuple(w[at : at + size])] < own:
                gone.update(range(at, at + size))
        out.append((i, " ".join(x for n, x in enumerate(w) if n not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


def test_query_equals_plain_loop(spark, sf_dir):
    want = {(i, n, gone, sha(kept)) for i, kept, n, gone in plain(texts(spark, sf_dir))}
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substrings(spark, sf_dir).collect()}
    assert got == want and any(r[2] for r in got)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_shared_passages_small_windows(spark):
    rng = random.Random(1)
    rows = [(n // 2 if n % 10 == 0 else n, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for n in range(300)]
    got = sorted((tuple(r) for r in substrings.remove_repeats(documents(spark, rows).repartition(7), 3).collect()), key=repr)
    assert got == plain(rows, 3)


def test_empty_table(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0
