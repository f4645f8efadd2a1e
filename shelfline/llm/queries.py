"""The registered queries of this folder, each a thin layer over its operator."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.llm import byte_bpe, decontaminate, interpolated_lm, licenses, merkle_manifest, packing, partenum, quality_rules, secret_ledger, spelling_variants, substrings, token_files, toxicity
from shelfline.llm.exchange import stored
from shelfline.llm.support import documents, text_crc
from shelfline.session import work_folder

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep_text=False)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every benchmark item that stands in a document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("items").alias("item_id"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", *licenses.OUTPUT)


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substrings.remove_repeats(documents(spark, sf_dir))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), work_folder(spark, "tokens")
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    found = token_files.look_up(docs.select("doc_id"), folder)
    return found.select("doc_id", "start", (F.octet_length("payload") / 4).cast("long").alias("n_tokens"), F.crc32("payload").alias("ids_crc32"))


@query
def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(documents(spark, sf_dir))


@query
def op7_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.components(documents(spark, sf_dir))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, toxicity.training_fold())
    scored = toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    features = stored(quality_rules.with_ratios(quality_rules.measure(docs).drop("text")), "measures")
    rules = quality_rules.learn(features, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    shown = features.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & quality_rules.verdict(rules))
    return shown.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secret_ledger.scan_versions(docs, work_folder(spark, "ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[rule.kind for rule in secret_ledger.RULES[: secret_ledger.BASE]]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [number(rule.kind) for rule in secret_ledger.RULES[: secret_ledger.BASE]]
    return found.select("doc_id", *kinds, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_spellings(documents(spark, sf_dir), planted=199)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = {"text": F.when(text_crc() % 5 == 0, lowered).otherwise(F.col("text"))}
    proven = merkle_manifest.manifest(documents(spark, sf_dir), tampered)
    return proven.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(cut).withColumnRenamed("key", "doc_id")
