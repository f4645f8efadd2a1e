"""Word bigrams with deleted interpolation.

The probability of a word after another is a mixture of its share after that
word, its share at all, and one share for each word type and the unknown. Weights
depend on how often the word before was seen, by powers of two, and are learnt by
expectation-maximisation on a part of the training documents that the counts for
it leave out; scores then use the counts of all training documents.

Counting and scoring are exchanges between document blocks and key buckets: a
block sends each distinct word and bigram once with its counts, a bucket returns
the totals in the same order. All documents take part in all of it.

Defined cases: a null text is the end token alone; a null id is dealt into folds
as empty text; repeated rows count and score again; without training documents
every word is unknown; an empty table gives no rows. Other columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.llm.exchange import Dealer, from_planes, piece_batch, planes, stored
from shelfline.llm.support import text_crc
from shelfline.llm.wordhash import pair, words_of

FOLDS, TEST, HELD_OUT = 10, 0, 1
ADDED = 0.1
BIGRAM = 2
END, START = np.uint64(0x5E17), np.uint64(0x57A7)
ONE = np.uint64(1)
# Counts of fitting documents and of held-out ones in one block, and their totals where one of them needs more.
COUNTS, TOTALS = (np.uint32, np.uint32), (np.int64, np.int64)
# Steps to an octave in which shares are rounded while the weights are learnt.
STEPS, NONE = 8, -(1 << 12)
PRIOR = (0.4, 0.4, 0.2)


class Block:
    """The tokens of a block. Keys of single tokens are odd, keys of bigrams even."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        token, context, rows, first = [], [], [], 0
        for batch in batches:
            for words in words_of(batch.column("text"), lower=True):
                row = words.row_of()
                tokens = np.full(len(words.hashes) + words.rows, END)
                tokens[np.arange(len(row)) + row] = words.hashes
                before = np.roll(tokens, 1)
                before[words.begins[:-1] + np.arange(words.rows)] = START
                token.append(tokens)
                context.append(before)
                rows.append(first + words.first + np.repeat(np.arange(words.rows), np.diff(words.begins) + 1))
            first += batch.num_rows
        token, context = np.concatenate(token), np.concatenate(context)
        self.rows, self.row = first, np.concatenate(rows)
        both = pair(context, token, BIGRAM) & ~ONE
        self.keys, at = np.unique(np.concatenate([[START | ONE], token | ONE, both]), return_inverse=True)
        n = len(token)
        self.token, self.both = at[1 : n + 1], at[n + 1 :]
        self.context = np.roll(self.token, 1)
        opens = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.context[opens] = at[0]
        self.opens, self.start = opens, at[0]

    def counts(self, taken: np.ndarray) -> np.ndarray:
        """Number of each key in the rows that ``taken`` marks."""
        some = taken[self.row]
        counts = np.bincount(self.token[some], minlength=len(self.keys)) + np.bincount(self.both[some], minlength=len(self.keys))
        counts[self.start] += np.count_nonzero(taken)
        return counts.astype(np.uint32)


def _folds(batches: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([b.column("fold").to_numpy(zero_copy_only=False) for b in batches])


class Questions:
    def __init__(self, dealer: Dealer) -> None:
        self.dealer = dealer

    def prepare(self, payloads) -> None:
        return None

    def __call__(self, state: None, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, fold = Block(batches), _folds(batches)
        fit = block.counts((fold != TEST) & (fold != HELD_OUT))
        return piece_batch(self.dealer.pieces(batches[0].column("block")[0].as_py(), block.keys, fit, block.counts(fold == HELD_OUT)))


def totals(blocks: np.ndarray, parts: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """Each block's first key, its totals and their width, and for block -1 the sizes of this bucket."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    begins = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
    fit, held = (np.add.reduceat(np.concatenate([p[n] for p in parts])[order].astype(np.int64), begins) for n in (1, 2))
    distinct = keys[order][begins]
    words = (distinct & ONE).astype(bool) & (distinct != START | ONE)
    every = (fit + held)[words]
    sizes = [fit[words].sum(), np.count_nonzero(fit[words]), every.sum(), np.count_nonzero(every)]
    yield -1, np.array(sizes, np.int64).tobytes()
    edges = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    for block, part, i, j in zip(blocks, parts, edges[:-1], edges[1:]):
        own = fit[group[i:j]], held[group[i:j]]
        kinds = COUNTS if max(n.max() for n in own) <= np.iinfo(np.uint32).max else TOTALS
        width = np.dtype(kinds[0]).itemsize
        yield int(block), part[0][:1].tobytes() + bytes([width]) + planes(*(n.astype(kind) for n, kind in zip(own, kinds)), ordered=False)


def _answered(payloads: list[bytes]) -> list[np.ndarray]:
    """Totals in the order of a block's keys; every payload starts with its first key and the width of its totals."""
    ordered = sorted(payloads, key=lambda p: np.frombuffer(p, np.uint64, 1)[0])
    kinds = {np.dtype(k[0]).itemsize: k for k in (COUNTS, TOTALS)}
    return [np.concatenate(x).astype(np.int64) for x in zip(*(from_planes(p[9:], *kinds[p[8]], ordered=False) for p in ordered))]


def octave(count: np.ndarray) -> np.ndarray:
    """Number of binary digits: the bucket of a context's frequency."""
    return np.frexp(count.astype(float))[1]


class Shares:
    """What expectation-maximisation needs of the held-out tokens: numbers of them by bucket and rounded shares."""

    def __init__(self, tokens: int) -> None:
        self.tokens = tokens

    def prepare(self, payloads: list[list[bytes]]) -> list[np.ndarray]:
        return _answered(payloads[0])

    def __call__(self, state: list[np.ndarray], batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, fit = Block(batches), state[0]
        some = (_folds(batches) == HELD_OUT)[block.row]
        context, word, both = fit[block.context[some]], fit[block.token[some]], fit[block.both[some]]

        def rounded(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
            share = np.log2(np.maximum(part, 1) / np.maximum(whole, 1))
            return np.where(part > 0, np.rint(STEPS * share), NONE).astype(np.int64)

        columns = np.stack([octave(context), rounded(both, context), rounded(word, np.int64(self.tokens))])
        columns, n = np.unique(columns, axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(n)], names=["bucket", "after", "alone", "n"])


def weights(shares: pd.DataFrame, types: int) -> tuple[float, float, float]:
    """Mixture weights of one bucket by expectation-maximisation, drawn a little to PRIOR."""
    value = lambda c: np.where(shares[c] > NONE, np.exp2(shares[c] / STEPS), 0.0)
    parts = np.stack([value("after"), value("alone"), np.full(len(shares), 1 / (types + 1))])
    n, mix = shares["n"].to_numpy(float), np.array(PRIOR)
    for _ in range(50):
        held = mix[:, None] * parts
        new = (held / held.sum(axis=0) * n).sum(axis=1) + np.array(PRIOR)
        new /= new.sum()
        if np.abs(new - mix).max() < 1e-7:
            break
        mix = new
    return tuple(mix)


class Scores:
    def __init__(self, tokens: int, types: int, learnt: dict[int, tuple[float, float, float]]) -> None:
        self.tokens, self.types = tokens, types
        table = np.tile(PRIOR, (64, 1))
        for bucket, mix in learnt.items():
            table[bucket] = mix
        table[0, 0] = 0  # after a word that was never seen there is no share
        self.table = table / table.sum(axis=1, keepdims=True)

    def prepare(self, payloads: list[list[bytes]]) -> np.ndarray:
        fit, held = _answered(payloads[0])
        return fit + held

    def __call__(self, counts: np.ndarray, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = Block(batches)
        context, word, both = counts[block.context], counts[block.token], counts[block.both]
        mix = self.table[octave(context)]
        share = mix[:, 0] * (both / np.maximum(context, 1)) + mix[:, 1] * (word / max(self.tokens, 1)) + mix[:, 2] / (self.types + 1)
        base = np.log10((word + ADDED) / (self.tokens + ADDED * (self.types + 1)))

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(block.row, weights=values, minlength=block.rows)

        ids = pa.concat_arrays([b.column("id") for b in batches])
        whole = [np.bincount(block.row, minlength=block.rows), summed(word > 0).astype(np.int64), np.full(block.rows, self.tokens)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(_folds(batches) == TEST), *(pa.array(c) for c in (*whole, summed(base), summed(np.log10(share))))],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    dealer = Dealer(docs, key, text)
    rows = dealer.keyed(docs, F.pmod(text_crc(key), F.lit(FOLDS)).cast("int").alias("fold"), text=text)
    questions = dealer.on_blocks(rows, [], Questions(dealer), "bucket int, block int, payload binary", whole=True)
    answers = dealer.replied(questions, (np.uint64, *COUNTS), totals, "ngrams")
    # One row of four numbers for each bucket.
    sizes = [np.frombuffer(r.payload, np.int64) for r in answers.where("block = -1").select("payload").collect()]
    fit_tokens, fit_types, tokens, types = (int(x) for x in np.sum(sizes, axis=0)) if sizes else (0, 0, 0, 0)
    told = answers.where("block >= 0")
    shares = dealer.on_blocks(rows, [told], Shares(fit_tokens), "bucket int, after int, alone int, n bigint", whole=True)
    shares = stored(shares.groupBy("bucket", "after", "alone").agg(F.sum("n").alias("n")), "shares")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(part["bucket"].iloc[0]), *weights(part, fit_types))], columns=["bucket", "after", "alone", "any"])

    # A bucket has no more rows than pairs of rounded shares.
    learnt = shares.groupBy("bucket").applyInPandas(learn, "bucket int, after double, alone double, any double").collect()
    scores = Scores(tokens, types, {r.bucket: (r.after, r.alone, r["any"]) for r in learnt})
    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealer.on_blocks(rows, [told], scores, schema, whole=True).withColumnRenamed("id", key)
