"""Quality rules learnt as a decision list.

Sequential covering: a rule starts empty and takes, one at a time, the threshold
condition with the best information gain on the growing part of the labelled
rows; trailing conditions are then cut as long as that helps on the pruning part;
rows that the rule rejects leave, and the next rule is sought among the rest. The
counts of every step come from one Spark aggregation over all labelled rows, by
feature and bin, so what reaches the driver is bounded by features times bins. The
list becomes one ``when`` expression.

Only Spark's own functions take part.

Defined cases: a null text has no words; ratios of a text without words are 0;
a null label is left out and a repeated one counts as low if any says so; without
labels of both kinds the list is empty and rejects nothing; rows are independent
and other columns stay, those named like a measure are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.exchange import stored

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_calls", "n_digits", "n_distinct", "n_lines")
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "capital_ratio": ("n_capitals", "word_chars"),
    "call_ratio": ("n_calls", "n_words"),
    "digit_ratio": ("n_digits", "word_chars"),
    "distinct_ratio": ("n_distinct", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_words": ("n_words", "n_lines"),
}
FEATURES = ("n_words", *RATIOS)


def _pairs(hashes: str, step: int) -> Column:
    """Hashes of runs of 2 * step words from those of runs of step words."""
    return F.expr(f"slice(zip_with({hashes}, slice({hashes}, {step + 1}, size({hashes})), (a, b) -> xxhash64(a, b)), 1, greatest(size({hashes}) - {step}, 0))")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of MEASURES.

    A repeated window of eight words is one whose hash comes up twice in its text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.drop(*MEASURES, *RATIOS, "_text", "_words", "_one", "_two", "_four", "_runs", "_sorted", "_at").withColumn("_text", whole)
    split = base.withColumn("_words", F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.trim(F.translate(line, SPACE, " ")) != "")
    hashed = split.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_lines", lines)
    runs = hashed.withColumn("_two", _pairs("_one", 1)).withColumn("_four", _pairs("_two", 2)).withColumn("_runs", _pairs("_four", 4))
    # Most texts repeat no window; only the others sort theirs, to find where the repeated ones stand.
    repeats = F.size(F.array_distinct("_runs")) < F.size("_runs")
    ordered = runs.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_runs", lambda h, at: F.struct(h.alias("h"), at.alias("at"))))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.expr("slice(_sorted.h, 1, size(_sorted) - 1)"))
    beside = F.arrays_zip(F.col("_sorted").alias("own"), before.alias("before"), F.expr("slice(_sorted.h, 2, size(_sorted))").alias("after"))
    twice = F.filter(beside, lambda x: x["own"]["h"].eqNullSafe(x["before"]) | x["own"]["h"].eqNullSafe(x["after"]))
    places = F.sort_array(F.transform(twice, lambda x: x["own"]["at"]))
    placed = ordered.withColumn("_at", F.when(F.col("_sorted").isNotNull(), places))
    covered = F.expr(f"aggregate(zip_with(_at, slice(_at, 2, size(_at)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (sum, n) -> sum + n)")

    def without(signs: str) -> Column:
        return F.char_length("_text") - F.char_length(F.translate("_text", signs, ""))

    def longs(**columns: Column) -> dict[str, Column]:
        return {name: column.cast("long") for name, column in columns.items()}

    counted = placed.withColumns(
        longs(
            n_words=F.size("_words"),
            word_chars=F.char_length(F.translate("_text", SPACE, "")),
            n_symbols=without(SYMBOLS),
            n_dup_lines=F.size("_lines") - F.size(F.array_distinct("_lines")),
            n_repeat_words=F.coalesce(covered, F.lit(0)),
            n_capitals=F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"\p{Lu}+", "")),
            n_calls=without("!"),
            n_digits=without("0123456789"),
            n_distinct=F.size(F.array_distinct("_one")),
            n_lines=F.size("_lines"),
        )
    )
    return counted.drop("_text", "_words", "_one", "_two", "_four", "_runs", "_sorted", "_at", "_lines")


def with_ratios(measured: DataFrame) -> DataFrame:
    return measured.withColumns({name: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) for name, (a, b) in RATIOS.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def all_of(rule: Rule) -> Column:
    column = F.lit(True)
    for condition in rule:
        column = column & condition.column()
    return column


def verdict(rules: list[Rule]) -> Column:
    """Whether a row with the features is kept: the first rule that holds rejects it."""
    column = None
    for rule in rules:
        column = F.when(all_of(rule), False) if column is None else column.when(all_of(rule), False)
    return F.lit(True) if column is None else column.otherwise(True)


def _gain(low: int, high: int, low0: int, high0: int) -> float:
    """Gain of a condition that leaves (low, high) of (low0, high0) rows."""
    return low * (math.log2((low + 0.5) / (low + high + 1)) - math.log2((low0 + 0.5) / (low0 + high0 + 1))) if low else 0.0


def learn(features: DataFrame, labels: DataFrame, label: str = "quality", bins: int = 32, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.9, least_rows: int = 10) -> list[Rule]:
    """Rules that reject rows like those labelled 0.

    ``features`` has doc_id and FEATURES. Its labelled rows are stored, as every
    step reads them. A rule is kept if ``precision`` of at least
    ``least_rows`` pruning rows that it rejects are labelled 0.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.min(label).alias("_label"))
    rows = features.select("doc_id", *FEATURES).join(known, "doc_id").withColumn("_low", (F.col("_label") <= 0).cast("long"))
    rows = rows.withColumn("_grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) != 0)
    cuts_at = F.array(*[F.lit(n / bins) for n in range(1, bins)])
    # Cuts come from both kinds of rows, so that a rare kind has its own.
    quantiles = {}
    for found in rows.groupBy("_low").agg(*[F.percentile_approx(f, cuts_at, 10_000).alias(f) for f in FEATURES]).collect():
        for feature in FEATURES:
            quantiles.setdefault(feature, set()).update(found[feature])
    cuts = {feature: sorted(values) for feature, values in quantiles.items()}
    if not cuts:
        return []
    binned = [
        F.struct(F.lit(n).alias("feature"), F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in map(float, cuts[f]))}), c -> c < {f}))").alias("bin"))
        for n, f in enumerate(FEATURES)
    ]
    rows = stored(rows.withColumn("_bins", F.array(*binned)), "labelled")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.where(verdict(rules))
        rule: Rule = ()
        while len(rule) < most_conditions:
            best = _best(left.where("_grow").where(all_of(rule)), cuts)
            if best is None:
                break
            rule = (*rule, best[0])
            if best[1]:
                break
        if not rule:
            break
        rule = _pruned(left.where("not _grow"), rule, precision, least_rows)
        if rule is None:
            break
        rules.append(rule)
    return rules


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, bool] | None:
    """The condition with the best gain, and whether it leaves only rows labelled 0."""
    exploded = rows.select("_low", F.explode("_bins").alias("at")).groupBy("at.feature", "at.bin")
    table: dict[int, dict[int, tuple[int, int]]] = {}
    for r in exploded.agg(F.sum("_low").alias("low"), F.sum(1 - F.col("_low")).alias("high")).collect():  # features times bins
        table.setdefault(r.feature, {})[r.bin] = (r.low, r.high)
    best, chosen = 1e-9, None
    for n, feature in enumerate(FEATURES):
        counts = table.get(n, {})
        low0, high0 = (sum(c[i] for c in counts.values()) for i in (0, 1))
        low = high = 0
        for at, cut in enumerate(cuts[feature]):
            low, high = low + counts.get(at, (0, 0))[0], high + counts.get(at, (0, 0))[1]
            for above, (l, h) in ((False, (low, high)), (True, (low0 - low, high0 - high))):
                gain = _gain(l, h, low0, high0)
                if gain > best:
                    best, chosen = gain, (Condition(feature, above, float(cut)), h == 0)
    return chosen


def _pruned(rows: DataFrame, rule: Rule, precision: float, least_rows: int) -> Rule | None:
    """The beginning of ``rule`` with the best (low - high) / (low + high), if it is precise enough."""
    sums = []
    for size in range(1, len(rule) + 1):
        held = all_of(rule[:size]).cast("long")
        sums += [F.sum(held * F.col("_low")), F.sum(held * (1 - F.col("_low")))]
    counts = [int(c or 0) for c in rows.agg(*sums).first()]
    scored = []
    for size in range(1, len(rule) + 1):
        low, high = counts[2 * size - 2], counts[2 * size - 1]
        scored.append(((low - high) / max(low + high, 1), -size, low, high))
    _, shorter, low, high = max(scored)
    return rule[:-shorter] if low + high >= least_rows and low >= precision * (low + high) else None
