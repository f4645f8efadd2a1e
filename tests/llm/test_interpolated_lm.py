import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from fixtures import ODD, crc, documents, odd_documents, texts, words
from shelfline.llm import interpolated_lm, queries


def tokens(text):
    return words(text, lower=True) + [None]


def base(rows):
    counts = Counter()
    for i, t in rows:
        if crc(i) % 10:
            counts.update(tokens(t))
    total, types = sum(counts.values()), len(counts)
    return sorted(
        (
            (i, crc(i) % 10 == 0, len(w := tokens(t)), sum(counts[x] > 0 for x in w), total,
             round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w), 6))
            for i, t in rows
        ),
        key=repr,
    )


def bigram(rows, weights):
    """Scores by the given weights of each bucket."""
    single, after, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if crc(i) % 10:
            w = tokens(t)
            single.update(w)
            after.update(zip(["", *w], w))
            context.update(["", *w[:-1]])
    total, types = sum(single.values()), len(single)
    out = []
    for i, t in rows:
        score, w = 0.0, tokens(t)
        for u, v in zip(["", *w], w):
            a, b, c = weights(context[u])
            score += math.log10(a * after[u, v] / max(context[u], 1) + b * single[v] / max(total, 1) + c / (types + 1))
        out.append((i, round(score, 6)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return texts(spark, sf_dir)


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    return queries.op6_interpolated_lm(spark, sf_dir).collect()


def test_base_columns(rows, result):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in result), key=repr)
    for a, b in zip(got, base(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-5)


def test_scores_follow_from_counts_and_weights(spark, rows, monkeypatch):
    """With fixed weights the scores are those of plain counts."""
    monkeypatch.setattr(interpolated_lm, "weights", None)
    seen = {}

    class Fixed(interpolated_lm.Scores):
        def __init__(self, tokens_, types, learnt):
            super().__init__(tokens_, types, {n: (0.1 + n / 100, 0.5, 0.4 - n / 100) for n in range(40)})
            seen["table"] = self.table

    monkeypatch.setattr(interpolated_lm, "Scores", Fixed)
    monkeypatch.setattr(interpolated_lm, "weights", lambda shares, types: (0.2, 0.3, 0.5))
    got = sorted(((r.doc_id, round(r.score, 6)) for r in interpolated_lm.score(documents(spark, rows)).collect()), key=repr)
    want = bigram(rows, lambda count: seen["table"][count.bit_length()])
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9, abs=1e-5)


def test_held_out_documents_score_better_than_the_base(result):
    held = [r for r in result if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_expectation_maximisation_finds_the_likelier_part():
    shares = pd.DataFrame([(3, -8, interpolated_lm.NONE, 900), (3, interpolated_lm.NONE, -80, 100)], columns=["bucket", "after", "alone", "n"])
    after, alone, any_ = interpolated_lm.weights(shares, 1000)
    assert after > 0.85 and alone + any_ < 0.15 and after + alone + any_ == pytest.approx(1)


def test_totals_beyond_32_bits():
    """Two blocks whose counts fit 32 bits while their totals don't."""
    most = np.uint32(2**32 - 1)
    parts = [
        [np.array([3, 4, 9], np.uint64), np.array([most, 5, 1], np.uint32), np.array([0, most, 1], np.uint32)],
        [np.array([3, 4], np.uint64), np.array([most, 7], np.uint32), np.array([2, most], np.uint32)],
        [np.array([9], np.uint64), np.array([1], np.uint32), np.array([1], np.uint32)],
    ]
    told = dict(interpolated_lm.totals(np.array([0, 1, 2]), parts))
    most = int(most)
    assert [x.tolist() for x in interpolated_lm._answered([told[0]])] == [[2 * most, 12, 2], [2, 2 * most, 2]]
    assert [x.tolist() for x in interpolated_lm._answered([told[1]])] == [[2 * most, 12], [2, 2 * most]]
    assert [x.tolist() for x in interpolated_lm._answered([told[2], told[1]])] == [[2 * most, 12, 2], [2, 2 * most, 2]]
    assert np.frombuffer(told[-1], np.int64).tolist() == [2 * most + 2, 2, 2 * most + 6, 2]


def test_odd_documents(spark):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in interpolated_lm.score(odd_documents(spark)).collect()), key=repr)
    assert got == base(ODD)


def test_empty_table_and_no_training(spark):
    assert interpolated_lm.score(documents(spark, [])).count() == 0
    alone = next(i for i in range(100) if crc(i) % 10 == 0)
    row = interpolated_lm.score(documents(spark, [(alone, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and row.score < 0
