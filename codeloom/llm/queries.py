"""The registered queries of these operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    alignment,
    chunk_dedup,
    decontaminate,
    language_model,
    licenses,
    near_duplicates,
    packing,
    quality,
    quality_model,
    secrets,
    source_audit,
    token_counts,
    token_records,
)
from codeloom.llm.common import new_folder, table
from codeloom.llm.oracles import ORACLES

try:  # where the box keeps public vocabulary files; a parameter of every operator
    from public_tokenizers import path as tokenizer_path
except ModuleNotFoundError:

    def tokenizer_path(name: str) -> str:
        return f"/opt/tokenizers/{name}"


__all__ = ["QUERIES", "ORACLES", "BYTE_BPE", "tokenizer_path"]
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = new_folder(spark, "token-cache")
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, tokenizer_path(BYTE_BPE), cache)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_leaks(docs, items)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-records")
    docs = table(spark, sf_dir, "documents")
    return token_records.token_output(docs, tokenizer_path(BYTE_BPE), folder)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.withColumn("broken", F.array_join("broken", ","))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "language-model")
    return language_model.score_documents(table(spark, sf_dir, "documents"), folder)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "pair-counts")
    docs = table(spark, sf_dir, "documents")
    return alignment.token_alignment(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE), folder)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_model.score_quality(docs, labels)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_counts,
        op3_decontamination,
        op4_token_records,
        op5_quality_rules,
        op6_secret_scan,
        op7_license_scan,
        op8_substring_dedup,
        op9_near_duplicates,
        op10_lm_scoring,
        op11_source_audit,
        op12_token_alignment,
        op13_quality_classifier,
    )
}
