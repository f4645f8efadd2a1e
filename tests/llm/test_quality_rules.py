from collections import Counter

from pyspark.sql import functions as F

from fixtures import ODD, documents, odd_documents, texts, words
from shelfline.llm import quality_rules, queries


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    seen = Counter(tuple(w[n : n + 8]) for n in range(len(w) - 7))
    covered = {n + k for n in range(len(w) - 7) if seen[tuple(w[n : n + 8])] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_query_equals_plain_loop(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf_dir).collect()}
    for i, t in texts(spark, sf_dir):
        want, r = plain(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert any(r.n_repeat_words for r in got.values())


def test_odd_documents(spark):
    repeats = [(70, "a b c d e f g h " * 2 + "x " + "a b c d e f g h"), (71, "a a a a a a a a a"), (72, "a b c d e f g h a b c d e f g"), (73, "\n\nx\n x\nx\n\x0b\n")]
    rows = quality_rules.measure(documents(spark, ODD + repeats).withColumn("N_WORDS", F.lit("x"))).collect()
    assert sorted((repr(r.doc_id), r.text or "", r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted((repr(i), t or "", *plain(t)) for i, t in ODD + repeats)
    assert quality_rules.measure(odd_documents(spark).limit(0)).count() == 0


def features(spark, rows):
    names = ", ".join(f"{f} double" for f in quality_rules.FEATURES)
    return spark.createDataFrame([(n, *(float(r.get(f, 0)) for f in quality_rules.FEATURES)) for n, r in enumerate(rows)], f"doc_id bigint, {names}")


def test_conjunctions_are_learnt(spark):
    """Low rows have many symbols and few words; neither alone makes a row low."""
    rows = [{"symbol_ratio": (n % 10) / 10, "n_words": 20 + n % 90, "call_ratio": (n * 7 % 11) / 11} for n in range(3000)]
    low = [r["symbol_ratio"] >= 0.5 and r["n_words"] < 60 for r in rows]
    labels = spark.createDataFrame([(n, int(not l)) for n, l in enumerate(low)] + [(None, 0), (5, None)], "doc_id bigint, quality int")
    table = features(spark, rows).cache()
    rules = quality_rules.learn(table, labels)
    assert all(len(rule) <= 3 for rule in rules)
    kept = {r.doc_id: r.kept for r in table.withColumn("kept", quality_rules.verdict(rules)).collect()}
    right = sum(kept[n] != l for n, l in enumerate(low))
    assert right >= 0.97 * len(rows)


def test_without_labels_nothing_is_rejected(spark):
    table = features(spark, [{}] * 5)
    assert quality_rules.learn(table, spark.createDataFrame([], "doc_id bigint, quality int")) == []
    assert quality_rules.learn(table, spark.createDataFrame([(n, 1) for n in range(5)], "doc_id bigint, quality int")) == []
    assert table.where(quality_rules.verdict([])).count() == 5


def test_held_out_rows_of_the_corpus(spark):
    folder = "/root/testdata/sf0.1"
    measured = quality_rules.with_ratios(quality_rules.measure(spark.read.parquet(f"{folder}/documents.parquet"))).select("doc_id", *quality_rules.FEATURES).cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rules = quality_rules.learn(measured, labels.where("doc_id % 5 != 0"))
    held = measured.withColumn("kept", quality_rules.verdict(rules)).join(labels.where("doc_id % 5 = 0"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in held}
    assert n.get((1, False), 0) <= 0.02 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.7 * (n[0, False] + n.get((0, True), 0))
