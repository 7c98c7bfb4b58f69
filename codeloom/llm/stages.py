"""The stages of the corpus pipeline; each takes (spark, docs, sf_dir)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, near_duplicates, packing, quality, secrets
from codeloom.llm.common import table, unused
from codeloom.llm.queries import BYTE_BPE, tokenizer_path

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
REDACTED = "[REDACTED]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` is not in ``ids``; rows without one stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays."""
    found = near_duplicates.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    return _without(docs, found.filter(~F.col("kept")))


def _by_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``, a hash of id and text: ids may be null or have several texts."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, each by its own text.

    Columns of any name stay; null texts hold no passage; an empty table stays empty.
    """
    row = unused(docs, "row")
    rows = _by_row(docs, row)
    texts = rows.select(F.col(row).alias("doc_id"), "text")
    leaks = decontaminate.find_leaks(texts, table(spark, sf_dir, "benchmark"))
    found = leaks.select(F.col("doc_id").alias(row)).distinct()
    return rows.join(found, row, "left_anti").select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by a mark; ``n_chars`` follows the new text.

    Columns of any name stay; null texts stay null; rows equal in id and text
    change alike; an empty table stays empty.
    """
    row, held = unused(docs, "row"), unused(docs, "spans")
    rows = _by_row(docs, row)
    found = secrets.find_secrets(rows.select(F.col(row).alias("doc_id"), "text")).filter(
        F.size("spans") > 0
    )
    spans = found.groupBy(F.col("doc_id").alias(row)).agg(F.first("spans").alias(held))
    joined = rows.join(spans, row, "left").select(*docs.columns, held)
    touched = joined.filter(F.col(held).isNotNull())
    names = docs.columns

    def redact(batches):
        for batch in batches:
            texts = [
                secrets.redact(text, [(s["at"], s["end"]) for s in spans], REDACTED)
                for text, spans in zip(batch["text"].to_pylist(), batch[held].to_pylist(), strict=True)
            ]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(names)

    marked = touched.mapInArrow(redact, docs.schema)
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    clean = joined.filter(F.col(held).isNull()).drop(held)
    return clean.unionByName(marked.select(*docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, one row per piece of a document."""
    return packing.pack_documents(docs, tokenizer_path(BYTE_BPE))
