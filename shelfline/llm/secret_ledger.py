"""Secret scans with an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its text. A ledger
table names the blobs that each version of the rules has seen; only the others
are scanned, each once, and the findings are joined back to all paths that hold
the blob. A later run over the same folder scans what is new, or everything
again after a change of rules.

Only Spark's own functions take part. A rule's pattern is extracted together
with the gap before it, so that lengths add up to positions.

Defined cases: a null text is the empty blob, without findings; a null path is a
path like any other; repeated rows give repeated results; an empty table gives
none. Other columns of the input stay, those named like the output are replaced.
Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.exchange import shuffles_removed
from shelfline.session import written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; a match counts if group ``part`` (0: all) has ``least`` characters."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1


# The first three are fixed by contract, in this order.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,80}:[^\x00-\x20/:@]{1,80}@"),
)
BASE = 3


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start,kind,end>> of one rule; nothing is extracted from texts without a match."""
    # A gap begins where the last match ended and nowhere else, so a text is read once.
    around = rf"(?s)\G(.*?)({rule.pattern})"
    gaps, matches = F.regexp_extract_all(text, F.lit(around), F.lit(1)), F.regexp_extract_all(text, F.lit(around), F.lit(2))
    parts = F.regexp_extract_all(text, F.lit(around), F.lit(2 + rule.part))
    found = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), parts.alias("part"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["0"])
        end = start + F.char_length(x["1"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["2"]) >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zipped = F.transform(found, lambda x: F.struct(x["gap"].alias("0"), x["match"].alias("1"), x["part"].alias("2")))
    added = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), added).otherwise(empty)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which some rule matches; spans by start, then rule."""
    found = F.sort_array(F.concat(*[_spans(F.col("text"), n, rule) for n, rule in enumerate(rules)]))
    return blobs.select("blob", found.alias("spans")).where(F.size("spans") > 0)


def _read(spark, path: str, schema: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _texts(rows: DataFrame, unseen: DataFrame) -> DataFrame:
    """(blob, text) of the unseen blobs.

    The empty ``mark`` makes the text depend on the join, or Spark would scan
    all rows before it to have fewer to join.
    """
    wanted = unseen.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), "mark")
    found = rows.join(wanted, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")))
    return found.select("blob", F.concat("text", "mark").alias("text"))


def scan_versions(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``blob`` and the ``spans`` found in its text, scanning what ``ledger`` hasn't seen.

    Findings are stored before the blobs are marked as seen, so that a run that
    breaks off is made good by the next.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = versions.drop("blob", "spans").withColumn("blob", F.sha2(content.cast("binary"), 256))
    seen = _read(spark, f"{ledger}/seen/{version}", "blob string")
    # One path stands for each unseen blob: its text alone is scanned, however many copies there are.
    chosen = rows.groupBy("blob").agg(F.min(path).alias("path")).join(seen, "blob", "left_anti")
    unseen = written(chosen.withColumn("mark", F.lit("")), "unseen")
    stored = f"{ledger}/findings/{version}"
    with shuffles_removed(spark):
        scan(_texts(rows.select("blob", F.col(path).alias("path"), content.alias("text")), unseen), rules).dropDuplicates(["blob"]).write.mode("append").parquet(stored)
    unseen.select("blob").write.mode("append").parquet(f"{ledger}/seen/{version}")
    findings = spark.read.schema("blob string, spans array<struct<start:int,kind:int,end:int>>").parquet(stored).dropDuplicates(["blob"])
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    named = F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return rows.join(findings.select("blob", named.alias("spans")), "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``text`` with ``mark`` in place of each run of overlapping spans."""
    step = F.expr(
        f"""aggregate(spans, struct('' as done, 0 as at),
              (acc, s) -> if(s.start >= acc.at,
                struct(concat(acc.done, substring(`{text}`, acc.at + 1, s.start - acc.at), '{mark}') as done, s.end as at),
                struct(acc.done as done, greatest(acc.at, s.end) as at)),
              acc -> concat(acc.done, substring(`{text}`, acc.at + 1)))"""
    )
    return scanned.withColumn(text, F.when(F.size("spans") > 0, step).otherwise(F.col(text)))
