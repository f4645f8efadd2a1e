"""Tables of awkward documents, and the plain loops that results are held against."""

import hashlib
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (None, "a text without an id that has some words to it"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one two three"),
    (5, "the same row twice, and twice the same row for sure it is"),
    (5, "the same row twice, and twice the same row for sure it is"),
    (6, "the same row twice, and twice the same row for sure it is"),
    (7, "word " * 5000),
    (8, "x" * 20000),
    (9, "Größe ÉTÉ ñandú 日本語 " * 8 + "  end"),
    (10, "A line\nA line\n\nanother line\nA line\n"),
]


def odd_documents(spark):
    """With extra columns that clash with names that operators use."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 7, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score int, spans array<int>")


def documents(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return SPACED.findall(text)


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def key(row):
    return repr(row)
