"""Cleans, scans and tokenises a corpus in stages.

Each stage gets what the one before kept, as a Parquet table, and returns the
columns of documents; the last returns token ids. Rows that share an id are one
document: a stage keeps all of them or none.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
import shelfline
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from shelfline.llm import byte_bpe, decontaminate, partenum, secret_ledger, toxicity
from shelfline.llm.exchange import BATCH, BATCH_BYTES
from shelfline.session import small_side, work_folder

# Workers need not have the package installed.
cloudpickle.register_pickle_by_value(shelfline)

TOXIC_FROM = 0.3
SHINGLE_WORDS, ALIKE_PERCENT = 5, 80


def small_batches(stage):
    """``stage`` in a session that keeps to batches of some megabytes, for its result is written after it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC_FROM, by a lexicon learnt from all labels."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC_FROM).select(*docs.columns)


@small_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; those without id or words stay."""
    groups = partenum.components(docs, SHINGLE_WORDS, ALIKE_PERCENT)
    copies = small_side(groups.where("component_id < doc_id").select("doc_id").distinct())
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


@small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(docs, benchmark).where(F.size("items") == 0).select(*docs.columns)


@small_batches
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    scanned = secret_ledger.scan_versions(docs, work_folder(spark, "ledger"))
    clean = secret_ledger.redact(scanned)
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text they came from."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("exact"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]
# Learnt scores, similarity joins and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
