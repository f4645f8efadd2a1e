import re

import pytest
from pyspark.sql import functions as F

from fixtures import ODD, documents, odd_documents, sha, texts
from shelfline.llm import queries, secret_ledger
from shelfline.session import work_folder

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def plain(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, rx, group, least) in enumerate(BASE) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    (20, "secret=token: abcdef1 TOKEN='aa.bb==cc' Api_Key = \"zzzzzz\" apikey:short é日 passwd:  1234567"),
    (21, "AKIAAKIA" + "Q" * 12 + " AKIA12 " + "deadbeef" * 3 + " " + "0" * 23 + "x" + "a" * 24),
    (22, "password==abc secret ::a secret:bbbbbb😀token=😀 token=\n abcdefg"),
    (23, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " https://joe:pass1@host/ xoxb-1234567890-abc"),
]


def test_query_equals_plain_loop(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_secret_ledger(spark, sf_dir).collect()}
    for i, t in texts(spark, sf_dir):
        want = plain(t)
        assert got[i].base_sha256 == sha(joined(want)), i
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex"))
    assert any(r.n_assign or r.n_access or r.n_hex for r in got.values())


@pytest.fixture()
def ledger(spark):
    return work_folder(spark, "ledger")


def test_tricky_texts(spark, ledger):
    for r in secret_ledger.scan_versions(documents(spark, TRICKY), ledger).collect():
        spans = [tuple(s) for s in r.spans]
        assert [s for s in spans if s[0] in ("assign", "access", "hex")] == plain(r.text)
        assert spans == sorted(spans, key=lambda s: (s[1], [x.kind for x in secret_ledger.RULES].index(s[0])))
    kinds = {s.kind for r in secret_ledger.scan_versions(documents(spark, TRICKY), ledger).collect() for s in r.spans}
    assert {"pem", "forge", "login", "chat"} <= kinds


def test_only_unseen_blobs_are_scanned(spark, ledger, monkeypatch):
    scanned, scan = [], secret_ledger.scan

    def counting(blobs, rules):
        scanned.append(blobs.count())
        return scan(blobs, rules)

    monkeypatch.setattr(secret_ledger, "scan", counting)
    first = documents(spark, TRICKY + [(30, TRICKY[0][1]), (31, "nothing")])
    before = secret_ledger.scan_versions(first, ledger).orderBy("doc_id").collect()
    again = secret_ledger.scan_versions(first.union(documents(spark, [(40, "token=abcdefgh"), (41, TRICKY[1][1])])), ledger).orderBy("doc_id").collect()
    assert scanned == [5, 1]
    assert again[: len(before)] == before and before[0].spans == before[4].spans
    assert [len(r.spans) for r in again[-2:]] == [1, len(before[1].spans)]
    secret_ledger.scan_versions(first, ledger, rules=secret_ledger.RULES[:3])
    assert scanned[2] == 5


def test_seen_texts_are_not_scanned(spark, tmp_path):
    """Spark must not move the patterns below the join that leaves the unseen texts."""
    spark.createDataFrame([("x", 1, "")], "blob string, path bigint, mark string").write.parquet(f"{tmp_path}/unseen")
    rows = documents(spark, TRICKY).selectExpr("sha2(text, 256) AS blob", "doc_id AS path", "text")
    plan = secret_ledger.scan(secret_ledger._texts(rows, spark.read.parquet(f"{tmp_path}/unseen")))._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join Inner", 1)[1].split("\n", 1)[1]
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in below and "RLIKE" not in below


def test_redaction(spark, ledger):
    rows = {r.doc_id: r.text for r in secret_ledger.redact(secret_ledger.scan_versions(documents(spark, TRICKY + [(50, "é token=abcdefgh. x"), (51, None)]), ledger)).collect()}
    assert rows[50] == "é [secret] x" and rows[51] is None
    assert all(not plain(t) for i, t in rows.items() if i in (20, 21, 50))


def test_odd_documents(spark, ledger):
    rows = secret_ledger.scan_versions(odd_documents(spark).withColumn("BLOB", F.lit(1)), ledger).collect()
    assert sorted((r.doc_id or -1, r.text or "", [tuple(s) for s in r.spans]) for r in rows) == sorted((i or -1, t or "", plain(t)) for i, t in ODD)
    assert secret_ledger.scan_versions(odd_documents(spark).limit(0), ledger).count() == 0
