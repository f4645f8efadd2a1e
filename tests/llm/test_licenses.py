import random
import re
import textwrap

from pyspark.sql import functions as F

from fixtures import ODD, documents, odd_documents, texts
from shelfline.llm import licenses, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text):
    """n_words, n_base, first, last, base labels, labels, score."""
    w = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [n for n in range(len(w)) if w[n : n + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    best, more = 0.0, set()
    for label, notice in licenses.TEMPLATES.items():
        listed = WORD.findall(lower(notice))
        template, m = set(listed), len(listed)
        for begin in range(0, len(w), m):
            own = set(w[begin : begin + 2 * m])
            share = len(own & template) / len(template)
            if share >= licenses.CONTAINMENT - 1e-9:
                more.add(label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if places else best)


TRICKY = [
    (60, "CC BY cc-by CC by, Apache License MIT license. GNU General Public License gnu general public\nlicense"),
    (61, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (62, "Permission is hereby granted, free of charge, to any person obtaining copy of this software and associated\nfiles"),
    (63, "Redistributions in source and binary forms with or without modification are permitted provided that the following conditions are"),
    (64, "all rights are reserved\nAll, rights; reserved!"),
    (65, "Éapache license apacheé license cc\x00by"),
    (66, "reserved all\nrights"),
]


def rows_of(df):
    return sorted(((r.doc_id, *(r[c] for c in licenses.OUTPUT)) for r in df.collect()), key=repr)


def test_query_equals_plain_loop(spark, sf_dir):
    assert rows_of(queries.op3_licenses(spark, sf_dir)) == sorted(((i, *plain(t)) for i, t in texts(spark, sf_dir)), key=repr)


def test_tricky_and_odd_documents(spark):
    assert rows_of(licenses.scan(documents(spark, TRICKY))) == sorted(((i, *plain(t)) for i, t in TRICKY), key=repr)
    odd = licenses.scan(odd_documents(spark).withColumn("LABELS", F.lit(1)))
    assert rows_of(odd) == sorted(((i, *plain(t)) for i, t in ODD), key=repr)
    assert licenses.scan(documents(spark, [])).count() == 0


def wrapped(notice, width, sign):
    return "\n".join(f"{sign}{line}" for line in textwrap.wrap(notice, width))


def test_wrapped_notices(spark):
    """Notices wrapped at usual widths, with comment signs, at any place of a text."""
    rng = random.Random(3)
    rows, want = [], {}
    for label in licenses.TEMPLATES:
        for width in (40, 60, 80):
            for sign in ("", "# ", " * ", "// "):
                before, after = (" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(80))) for _ in range(2))
                want[len(rows)] = label
                rows.append((len(rows), f"{before}\n{wrapped(licenses.TEMPLATES[label], width, sign)}\n{after}"))
    got = rows_of(licenses.scan(documents(spark, rows)))
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert all(want[row[0]] in row[6].split(",") for row in got)


def test_blocks_are_all_windows(spark):
    texts = ["", " , ", "one", "  one two", "a b\nc,d;e f\tg h  ", "é" * 3 + " b " * 9 + "." * 2000]
    df = documents(spark, list(enumerate(texts)))
    for m in (1, 3):
        for r in df.select("text", licenses.word_blocks(F.col("text"), m).alias("blocks")).collect():
            w = WORD.findall(r.text)
            assert [WORD.findall(b) for b in r.blocks] == [w[n : n + 2 * m] for n in range(0, len(w), m)]


def test_clashing_names(spark):
    names = ["_share", "_found", "doc_id_of", "_words", "_rare", "_base", "_low", "__low", "score"]
    docs = documents(spark, TRICKY).withColumns({c: F.lit(c) for c in names})
    out = licenses.scan(docs)
    assert set(names) <= set(out.columns)
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in names[:-1])
    assert rows_of(out) == sorted(((i, *plain(t)) for i, t in TRICKY), key=repr)
