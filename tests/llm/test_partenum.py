import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents, odd_documents, texts, words
from shelfline.llm import partenum, queries
from shelfline.session import is_folder, list_folders, work_folder


def shingles(text, size):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[at : at + size]) for at in range(len(w) - size + 1)) or frozenset([tuple(w)])


def plain(rows, size=4, num=85, den=100):
    sets = [(i, shingles(t, size)) for i, t in rows]
    above = {i: i for i, _ in rows if i is not None}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    holders = {}
    for n, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                holders.setdefault(x, []).append(n)
    pairs = {(a, b) for held in holders.values() for k, a in enumerate(held) for b in held[k + 1 :]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if den * len(s & t) >= num * len(s | t):
            low, high = sorted((top(i), top(j)))
            above[high] = low
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=repr)


def test_query_equals_plain_loop(spark, sf_dir):
    want = plain(texts(spark, sf_dir))
    assert sorted((tuple(r) for r in queries.op7_partenum(spark, sf_dir).collect()), key=repr) == want
    assert any(i != c for i, _, c in want)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = sorted((tuple(r) for r in partenum.components(docs).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("size", "num", "edits"), [(4, 85, 3), (5, 80, 4), (1, 70, 6), (2, 50, 8)])
def test_chains_of_copies(spark, size, num, edits):
    """Copies of copies, so that many links miss the leader of their signature."""
    rng = random.Random(size)
    rows = []
    for family in range(6):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 12, 40, 150, 400]))]
        for _ in range(25):
            text = list(text)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
    got = sorted((tuple(r) for r in partenum.components(documents(spark, rows).repartition(5), size, num).collect()), key=repr)
    assert got == plain(rows, size, num)


@pytest.mark.parametrize("size", [1, 3, 7, 20, 90, 260, 300, 700, 3000])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    scheme = partenum.Scheme(85, 100)
    for trial in range(20):
        base = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
        change = int(rng.integers(0, size + 1)) if trial % 2 else int(0.08 * size)
        other = np.concatenate([base[change:], rng.integers(0, 2**63, int(rng.integers(0, max(change, 1) + 1)), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common) or not len(b):
            continue
        both = partenum.Sets(0, np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
        for partition in range(partenum.PARTITIONS + 1):
            found = [set(), set()]
            for row, signature in scheme.signatures(both.moved(partition), np.arange(2)):
                for r, s in zip(row, signature.tolist()):
                    found[r].add(s)
            assert found[0] & found[1]


@pytest.mark.parametrize("num", [50, 80, 85])
def test_sets_as_unlike_as_allowed_share_a_signature(num):
    """Small sets have many parts without elements; those that differ as far as they may still share a signature."""
    rng = np.random.default_rng(num)
    scheme, tried = partenum.Scheme(num, 100), 0
    for size in [*range(1, 60), 150, 400] * 12:
        lost = int(rng.integers(0, size * (100 - num) // 100 + 1))
        most = 100 * (size - lost) // num - size  # elements of the union beyond the first set
        if size == lost or most < 0:
            continue
        base = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        other = np.unique(np.concatenate([base[lost:], rng.integers(0, 2**64, most, dtype=np.uint64)]))
        both = partenum.Sets(0, np.array([0, len(base), len(base) + len(other)]), np.concatenate([base, other]))
        found = [set(), set()]
        for row, signature in scheme.signatures(both, np.arange(2)):
            for r, s in zip(row, signature.tolist()):
                found[r].add(s)
        assert found[0] & found[1]
        tried += 1
    assert tried > 300


def test_unlike_sets_share_next_to_no_signature():
    """What stands for no elements would be common to all sets, so that comparisons grew with the square of the corpus."""
    rng = np.random.default_rng(8)
    sizes = rng.integers(30, 400, 600)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    elements = rng.integers(0, 2**64, begins[-1], dtype=np.uint64)
    sets = partenum.Sets(0, begins, np.concatenate([np.sort(elements[i:j]) for i, j in zip(begins[:-1], begins[1:])]))
    signatures = np.concatenate([signature for _, signature in partenum.Scheme(80, 100).signatures(sets, np.arange(600))])
    counts = np.unique(signatures, return_counts=True)[1]
    assert counts[counts > 1].sum() < 60


def test_only_tables_that_the_result_reads_stay(spark):
    """Sets and signatures leave the disk when the last step that reads them ends."""
    rng = random.Random(5)
    rows = []
    for n in range(60):
        if n % 3 == 0:
            text = [f"w{rng.randrange(300)}" for _ in range(60)]
        rows.append((n, " ".join([*text[:-1], f"end{n}"])))
    docs = documents(spark, rows)
    before = _tables(spark)
    result = partenum.components(docs)
    assert {name.split("-")[1] for name in _tables(spark) - before} == {"facts", "components"}
    assert sorted((tuple(r) for r in result.collect()), key=repr) == plain(rows)


def _tables(spark):
    folder = work_folder(spark, "none").rpartition("/")[0]
    return set(list_folders(spark, folder)) if is_folder(spark, folder) else set()


def _only_by_second_round(spark, rows, monkeypatch):
    """Components where every signature goes through one leader, id 1, that is similar to none."""

    class One(partenum.Scheme):
        def signatures(self, sets, chosen):
            chosen = chosen[sets.sizes[chosen] > 0]
            yield chosen, np.full(len(chosen), 7 << 60, np.uint64)

    monkeypatch.setattr(partenum, "Scheme", One)
    return sorted((tuple(r) for r in partenum.components(documents(spark, rows).coalesce(1)).collect()), key=repr)


def test_copies_out_of_order_within_a_batch(spark, monkeypatch):
    """The smallest id of a group of copies comes after another of them, so that it is not the one signed."""
    a = [f"a{n}" for n in range(60)]
    b = [*a[:-1], "b"]
    rows = [(1, " ".join(f"l{n}" for n in range(60))), (30, " ".join(a)), (20, " ".join(a)), (40, " ".join(b))]
    assert _only_by_second_round(spark, rows, monkeypatch) == plain(rows)


def test_copy_that_shares_its_id_with_another_text(spark, monkeypatch):
    """Id 30 is a copy of 20 by one row; its other row is similar to 40."""
    a, c = ([f"{x}{n}" for n in range(60)] for x in "ac")
    rows = [(1, " ".join(f"l{n}" for n in range(60))), (20, " ".join(a)), (30, " ".join(a)), (30, " ".join(c)), (40, " ".join([*c[:-1], "d"]))]
    assert _only_by_second_round(spark, rows, monkeypatch) == plain(rows)


def test_shuffled_families_with_copies(spark):
    """Ids in no order, families of similar texts with exact copies among them."""
    rng = random.Random(11)
    rows, ids = [], rng.sample(range(1000), 240)
    for family in range(8):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.choice([12, 40, 150]))]
        for n in range(15):
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(300)}"
            rows += [(ids.pop(), " ".join(text)) for _ in range(rng.randint(1, 2))]
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in partenum.components(documents(spark, rows).repartition(3)).collect()), key=repr)
    assert got == plain(rows)


@pytest.mark.parametrize(("straight", "partitions"), [(1, 1), (1, 2), (4, 2)])
def test_common_signatures_are_told_apart(spark, monkeypatch, straight, partitions):
    """Many similar texts of several components share signatures; other partitions lose no link between them."""
    monkeypatch.setattr(partenum, "STRAIGHT", straight)
    monkeypatch.setattr(partenum, "PARTITIONS", partitions)
    rng = random.Random(21)
    passage = [f"p{n}" for n in range(70)]
    rows = []
    for n in range(120):
        own = list(passage) + [f"q{rng.randrange(60)}" for _ in range(30)]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
        rows.append((n * 37 % 1000, " ".join(own)))
        if n % 3 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((n * 37 % 1000 + 1000, " ".join(own)))
    got = sorted((tuple(r) for r in partenum.components(documents(spark, rows).repartition(3)).collect()), key=repr)
    want = plain(rows)
    assert got == want and len({c for _, _, c in want}) > 20


def test_second_round_grows_with_the_rows(spark):
    """Sets that share one signature of many, and nothing else, make few pairs."""
    rng = np.random.default_rng(4)
    scheme, count, found = partenum.Scheme(85, 100), 400, []
    drawn = [np.sort(rng.integers(0, 2**64, 100, dtype=np.uint64)) for _ in range(count)]
    sets = partenum.Sets(0, np.arange(0, 100 * count + 1, 100), np.concatenate(drawn))
    for partition in (0, 1):
        holders = {}
        for row, signature in scheme.signatures(sets.moved(partition), np.arange(count)):
            for r, s in zip(row.tolist(), signature.tolist()):
                holders.setdefault(s, set()).add(r)
        found.append({(a, b) for held in holders.values() for a in held for b in held if a < b})
    assert len(found[0] & found[1]) <= max(len(f) for f in found) / 10


@pytest.mark.parametrize("partitions", [1, 2])
def test_family_around_a_text_is_told_apart(spark, monkeypatch, partitions):
    """Edited copies of one text, mostly not similar to each other, make fewer signatures than before and few comparisons."""
    monkeypatch.setattr(partenum, "STRAIGHT", 16)
    monkeypatch.setattr(partenum, "PARTITIONS", partitions)
    shared, seen = partenum._shared, []

    def counted(signed):
        found = shared(signed)
        per = found.groupBy("signature").count()
        seen.append((signed.count(), per.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0))
        return found

    monkeypatch.setattr(partenum, "_shared", counted)
    rng = random.Random(31)
    base, ids = [f"b{n}" for n in range(120)], rng.sample(range(1000), 220)
    rows = [(ids.pop(), " ".join(base))]
    while len(ids) > 1:
        own = list(base)
        for _ in range(rng.randint(3, 4)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((ids.pop(), " ".join(own)))
        if len(rows) % 5 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((ids.pop(), " ".join(own)))
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in partenum.components(documents(spark, rows).repartition(3)).collect()), key=repr)
    assert got == plain(rows)
    assert len(seen) > 1 and max(n for n, _ in seen[1:]) <= 2 * seen[0][0] and seen[-1][1] * 20 < seen[0][1]


def test_empty_table(spark):
    assert partenum.components(documents(spark, [])).count() == 0
