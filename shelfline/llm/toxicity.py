"""Toxicity scores from a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts, digits
and signs that stand for letters. The lexicon holds words and beginnings of
words, each with the log ratio of its share in toxic and in other labelled
documents. One Aho-Corasick pass finds all entries; hits inside an exception
phrase do not count, and of the entries at one word only the heaviest does. The
sum of weights, by itself and by length, goes through a logistic curve fitted on
labelled documents that the lexicon was not learnt from.

The fit uses a bounded sample, ``fit_rows`` labelled documents with the smallest
hash of their id; scoring covers every text.

Defined cases: null and empty texts have no hits and score what a text without
hits scores; repeated labels of a document count once, toxic if any says so;
without labels of both kinds the seed words alone score; rows are independent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.support import adding, appended, small, text_crc

# Look-alikes, letter by letter.
_CYRILLIC = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w"}
_GREEK = {"α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_WIDE = {chr(0xFF41 + n): chr(97 + n) for n in range(26)}
_HIDDEN = dict.fromkeys("­​‌‍⁠﻿", "")
FOLD = str.maketrans({**_CYRILLIC, **_GREEK, **_DIGITS, **_WIDE, **_HIDDEN})
SIGNS = str.maketrans({"$": "s", "@": "a", "!": "i", "|": "l"})

# Weights before any label is seen.
SEEDS = ("idiot", "moron", "stupid", "scum", "pathetic", "worthless", "loser", "trash", "disgusting", "clown")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bag", "class clown fish", "clown fish", "stupid simple", "sore loser rule")

_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"(?<![$@!|])[$@!|](?=[^\W_])")


def fold(text: str) -> str:
    """Words of the folded text between single blanks, with one blank at either end."""
    text = text.lower().translate(FOLD)
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda sign: sign[0].translate(SIGNS), text)
    return f" {' '.join(_WORD.findall(text))} "


def entries(folded: str) -> set[str]:
    """The lexicon entries that a text could support: its words, and beginnings of them."""
    found = set()
    for word in set(folded.split()):
        if len(word) <= 32:
            found.add(f" {word} ")
        found.update(f" {word[:size]}" for size in (4, 5, 6) if len(word) > size)
    return found


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.5, 0.5)

    def matcher(self):
        automaton = ahocorasick.Automaton()
        for entry, weight in self.lexicon:
            automaton.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = fold(phrase)
            automaton.add_word(entry, (len(entry), None))
        automaton.make_automaton()
        return automaton

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(1000 * total / np.maximum(words, 1)))))


def weigh(matcher, folded: str) -> float:
    """Sum of the weights of the entries in a folded text."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in matcher.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        best = {at: w for at, w in best.items() if not any(start <= at < end for start, end in spared)}
    return sum(best.values())


def _weighed(docs: DataFrame, model: Model, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in (part for whole in batches for part in small(whole, text)):
            folded = [fold(t or "") for t in batch.column(text).to_pylist()]
            totals = [weigh(matcher, f) for f in folded] if model.lexicon else [0.0] * len(folded)
            yield appended(batch, weight=pa.array(totals, pa.float64()), words=pa.array([max(f.count(" ") - 1, 0) for f in folded], pa.int64()))

    return adding(docs, run, "weight double, words bigint")


def _entry_counts(labelled: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole, "text")):
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update(entries(fold(text or "")))
            for at in range(0, len(names := list(counts[0] | counts[1])), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[n] for n in part], pa.int64()) for c in counts)], names=["entry", "other", "toxic"])

    found = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "entry string, other bigint, toxic bigint")
    return found.groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


def _part(x: Column, of: Column) -> Column:
    return F.when(x > 0, x * F.log(x / of)).otherwise(0.0)


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, fit_rows: int = 20_000, lexicon_size: int = 5_000, evidence: float = 30.0) -> Model:
    """Lexicon and curve from the labelled documents of ``train`` (a condition on doc_id; all if not given).

    An entry needs a likelihood ratio of ``evidence`` in favour of toxic texts.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    known = (known.where(train) if train is not None else known).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("fit"))
    sample = known.orderBy(order, "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most fit_rows ids
    for_curve = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0
    for_lexicon = texts.where(~for_curve)
    sizes = dict(sample.where(~for_curve).groupBy("toxic").count().collect())
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    seeds = {f" {word} ": SEED_WEIGHT for word in SEEDS}
    if not toxic or not other:
        return Model(tuple(seeds.items()))
    t, o, n = F.col("toxic").cast("double"), F.col("other").cast("double"), F.col("toxic") + F.col("other")
    ratio = 2 * (_part(t, n * toxic / (toxic + other)) + _part(o, n * other / (toxic + other)))
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((o + 0.5) / (other + 1))
    strong = _entry_counts(for_lexicon).select("entry", weight.alias("weight"), ratio.alias("ratio")).where((F.col("ratio") >= evidence) & (F.col("weight") > 1))
    top = strong.orderBy(F.desc("ratio"), "entry").limit(lexicon_size).collect()
    lexicon = Model(tuple({**seeds, **{r.entry: round(r.weight, 6) for r in top}}.items()))
    rows = _weighed(texts.where(for_curve), lexicon, "text").drop("text").dropDuplicates(["doc_id"]).collect()  # at most fit_rows
    return Model(lexicon.lexicon, curve=_curve(rows) or lexicon.curve)


def _curve(rows: list) -> tuple[float, float, float] | None:
    """Logistic regression with a light ridge."""
    label = np.array([r.toxic for r in rows], float)
    if not rows or label.min() == label.max():
        return None
    total, words = np.array([r.weight for r in rows]), np.array([r.words for r in rows], float)
    x = np.column_stack([np.ones(len(rows)), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1))])
    ridge, beta = np.diag([1e-3, 1e-1, 1e-1]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (label - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(round(b, 9)) for b in beta) if np.isfinite(beta).all() else None


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in (part for whole in batches for part in small(whole, text)):
            folded = [fold(t or "") for t in batch.column(text).to_pylist()]
            total = np.array([weigh(matcher, f) for f in folded], float)
            words = np.array([max(f.count(" ") - 1, 0) for f in folded], float)
            yield appended(batch, toxicity=pa.array(model.score(total, words)))

    return adding(docs, run, "toxicity double")


def training_fold() -> Column:
    return F.pmod(text_crc(), F.lit(4)) != 2


def held_out() -> Column:
    return F.pmod(text_crc(), F.lit(4)) == 2
