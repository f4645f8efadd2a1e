import random

import pytest
from pyspark.sql import functions as F

from fixtures import crc, odd_documents, sha
from shelfline.llm import merkle_manifest, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return sha("".join(map(framed, row)))


def levels(nodes):
    """The levels of a list of digests up to its root."""
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return out


def steps(tree, at):
    """(left, right) siblings of a leaf, level by level."""
    out = []
    for level in tree[:-1]:
        begin = at - at % 16
        out.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + 16])))
        at //= 16
    return out


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) in, the result's rows out."""
    if not rows:
        return []
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = levels([leaf(r) for r in groups[source]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for place, source in enumerate(order):
        for at, row in enumerate(groups[source]):
            path = steps(trees[source], at) + steps(top, place)
            text = row[4]
            if crc(row[0]) % 5 == 0 and text is not None:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            folded = leaf((*row[:4], text))
            for left, right in path:
                folded = sha(left + folded + right)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[source][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def ask(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in queries.op12_merkle_manifest(spark, str(folder)).collect()]


def by_text(rows):
    return sorted(rows, key=repr)


def test_query_equals_plain_loop(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, sf_dir).collect()]
    assert by_text(got) == by_text(plain(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [17], [257], [300, 1, 5, 16, 17], [1] * 40])
def test_sizes_of_groups(spark, tmp_path, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(10**6), None if g == 1 else f"s{g}" if g != 2 else "", "en", 3, f"Text {g} {n}") for g, size in enumerate(sizes) for n in range(size)]
    rng.shuffle(rows)
    assert by_text(ask(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path)) == by_text(plain(rows))


def test_one_group_with_nearly_all_rows(spark, tmp_path):
    rows = [(n, "hot" if n % 50 else f"s{n}", None, n, f"A{n}") for n in range(5000)]
    assert by_text(ask(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), tmp_path)) == by_text(plain(rows))


def test_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    docs = docs.unionByName(docs.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")))
    docs = docs.withColumn("root", F.lit(1)).withColumn("_group", F.lit("x")).withColumn("path", F.lit(2)).withColumn("total", F.lit(2))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert by_text(ask(spark, docs, tmp_path)) == by_text(plain(rows))


def test_empty_table(spark, tmp_path):
    assert ask(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_node_intervals_nest(spark):
    rows = [(n, f"s{n % 3}" if n < 60 else "big", "en", n, "t") for n in range(900)]
    lower, upper = merkle_manifest.build(spark.createDataFrame(rows, SCHEMA))
    found = [tuple(r) for r in merkle_manifest.nodes(lower).select("group", "level", "lo", "hi").collect()]
    for group, level, lo, hi in found:
        over = [n for n in found if n[0] == group and n[1] == level + 1 and n[2] <= lo and hi <= n[3]]
        whole = (lo, hi) == (0, 839 if group == "big" else 19)
        assert len(over) == (0 if whole else 1)
    assert merkle_manifest.nodes(upper).count() == 1
