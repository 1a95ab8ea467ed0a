"""The thin queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm import decontamination, lm, minhash, packing, quality, repeats, secrets, toxicity, url_filters, warc
from labelframe.llm.common import shared_path, table
from labelframe.llm.oracles import ORACLE_SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    out = toxicity.score(documents, model)
    held_out = ~toxicity.eligible()
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_windows", "coverage", "consistency", "same_values")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan(documents, secrets.train(secrets.labelled_samples(documents)))
    counts = [F.size(secrets.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), root, shard_bytes=64 << 20, roll_bytes=8 << 20)
    return warc.read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_secret_scans": op4_secret_scans,
    "op5_minhash": op5_minhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_repeats": op7_repeats,
    "op8_warc": op8_warc,
    "op9_url_filters": op9_url_filters,
    "op10_lm_scoring": op10_lm_scoring,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
