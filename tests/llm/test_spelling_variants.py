import random
import re
import zlib
from collections import Counter, defaultdict

from fixtures import documents, odd_documents, texts
from shelfline.llm import queries, spelling_variants


def plain_words(rows):
    """(word, n) by the plain loop over every run of every text."""
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if code % 199 == 0:
                word = word[: code % len(word)] + word[code % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_near(words):
    """Every pair of words held against each other, those of one length or neighbouring lengths."""
    by = defaultdict(list)
    for word in words:
        by[len(word)].append(word)
    return {w: [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by[size] if one_edit(w, x)] for w in words}


def quick_near(words):
    """The same by the word without each letter, for vocabularies too large for all pairs."""
    at = defaultdict(set)
    for word in words:
        for i in range(len(word)):
            at[word[:i] + word[i + 1 :]].add(word)
    return {w: {x for x in set().union(*(at[w[:i] + w[i + 1 :]] for i in range(len(w))), at[w], {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys()) if one_edit(w, x)} for w in words}


def plain(words, near):
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda x: (-words[x], x), default=None)
        form[word] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.add((word, form[word], root, n, len(near[word]), words[form[word]] if form[word] else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_query_equals_plain_loop(spark, sf_dir):
    words = plain_words(texts(spark, sf_dir))
    near = quick_near(words)
    sample = sorted(words)[:150]
    assert {w: set(near[w]) for w in sample} == {w: {x for x in words if one_edit(w, x)} for w in sample}
    assert got(queries.op11_spelling_variants(spark, sf_dir)) == plain(words, near)


def test_random_words(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randint(1, 6))): rng.randint(5, 4000) for _ in range(400)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(spelling_variants.variants(table)) == plain(words, plain_near(words))


def test_long_words_and_common_beginnings(spark):
    rng = random.Random(8)
    words = {}
    for size in (46, 47, 48, 49, 50, 300):
        base = "".join(rng.choice("ab") for _ in range(size))
        for _ in range(25):
            at, kind = rng.randrange(size), rng.randrange(3)
            words[base[:at] + ["", "c", base[at] + "d"][kind] + base[at + 1 :]] = rng.randint(5, 900)
        words[base] = 5000
    words.update({"x" * n: n for n in (*range(40, 60), 20000, 20001)})
    words.update({"preamble" + "".join(rng.choice("abc") for _ in range(5)): rng.randint(5, 50) for _ in range(200)})
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(spelling_variants.variants(table)) == plain(words, plain_near(words))


def test_odd_documents(spark):
    docs = odd_documents(spark).selectExpr("*", "1 AS word", "2 AS n", "3 AS key")
    docs = docs.unionByName(docs).unionByName(docs)
    docs = docs.unionByName(docs)  # six times, so that odd words count
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = plain_words(rows)
    assert words and got(spelling_variants.group_spellings(docs, planted=199)) == plain(words, plain_near(words))


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "a b c")]):
        assert spelling_variants.group_spellings(documents(spark, rows)).count() == 0
