import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents, odd_documents, texts
from shelfline.llm import decontaminate, queries
from shelfline.llm.decontaminate import REGION, budget, folded


def fold(text):
    return folded(np.frombuffer((text or "").encode(), np.uint8)).tobytes()


def nearest(region, text):
    """Least edits between the region and any part of the text."""
    cost = np.zeros(len(text) + 1, int)
    target = np.frombuffer(text, np.uint8)
    steps = np.arange(len(text) + 1)
    for n, byte in enumerate(region):
        new = np.empty_like(cost)
        new[0] = n + 1
        new[1:] = np.minimum(cost[:-1] + (target != byte), cost[1:] + 1)
        cost = np.minimum.accumulate(new - steps) + steps
    return int(cost.min())


def plain(text, items):
    own, found = fold(text), []
    for i, t in items:
        item = fold(t)
        if len(item) < decontaminate.Q:
            continue
        n = len(item)
        begins = {*range(0, max(n - REGION, 0) + 1, decontaminate.STEP), max(n - REGION, 0)}
        if any(nearest(item[b : b + REGION], own) <= budget(len(item[b : b + REGION]))[0] for b in begins):
            found.append(i)
    return sorted(found)


@pytest.fixture(scope="module")
def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def test_query_equals_plain_loop(spark, sf_dir, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    got = sorted((r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, sf_dir).collect())
    want = []
    for i, t in texts(spark, sf_dir)[:60]:
        want += [(i, item) for item in plain((t or "")[:3000], items)]
    whole = {i for i, t in texts(spark, sf_dir) for _, item in items if fold(item) in fold(t)}
    assert set(want) <= set(got) and whole <= {i for i, _ in got}
    assert {i for i, _ in got} - whole <= {i for i, _ in want} | whole


def test_edited_passages(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz "
    items = [(n, "".join(rng.choice(letters) for _ in range(rng.choice([25, 40, 90, 200, 400])))) for n in range(20)] + [(90, "tiny"), (91, None)]
    rows = []
    for n in range(150):
        source = list(rng.choice(items[:20])[1])
        begin = rng.randrange(max(len(source) - 120, 1))
        part = source[begin : begin + rng.choice([60, 110, 400])]
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(part))
            part[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz", "Q,", " "])
        around = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2)]
        rows.append((n, around[0] + "".join(part) + around[1]))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    known = [i for i in items if i[1] is not None]
    got = {r.doc_id: r["items"] for r in decontaminate.contaminated(documents(spark, rows), table).collect()}
    for n, t in rows:
        assert got[n] == plain(t, known), n
    assert any(got.values()) and not all(got.values())


def test_verbatim_passages_at_every_place(spark):
    """66 folded bytes of a longer item are found wherever they begin; 60 are not."""
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(230))
    passages = [item[begin : begin + 66] for begin in range(len(item) - 65)]
    rows = [(n, "".join(rng.choice("0123456789") for _ in range(40)) + p + "".join(rng.choice("0123456789") for _ in range(40))) for n, p in enumerate(passages)]
    rows += [(1000 + n, t.replace(p, p[3:-3])) for (n, t), p in zip(rows, passages)]
    table = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.contaminated(documents(spark, rows), table).collect()}
    assert all(got[n] == [7] for n in range(len(passages)))
    assert not any(got[1000 + n] for n in range(len(passages)))


def test_odd_documents_and_blocks(spark, benchmark, monkeypatch):
    docs = odd_documents(spark).withColumn("ITEMS", F.lit("x")).union(benchmark.limit(2).selectExpr("item_id + 100", "text", "'en'", "'s'", "0L", "'x'", "7", "array(1)", "'x'"))
    once = [(r.doc_id, r["items"]) for r in decontaminate.contaminated(docs, benchmark).collect()]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert [(r.doc_id, r["items"]) for r in decontaminate.contaminated(docs, benchmark).collect()] == once
    assert [i for i, found in once if found] == [100, 101]
    none = benchmark.limit(0)
    assert all(r["items"] == [] for r in decontaminate.contaminated(docs, none).collect())
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
