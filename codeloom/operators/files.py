"""Relational steps of an ingest: routing, deduplication and accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import suffix
from codeloom.schema import META_FIELDS

# Language family of each indexed extension.
FAMILIES = {
    "java": [".java"],
    "jsx": [".jsx", ".tsx"],
    "html": [".html"],
    "cfml": [".cfm", ".cfc"],
    "sql": [".sql"],
}
# Keys every block's metadata document starts with.
BASE_KEYS = ["node_type", "language", "start_line", "end_line", "file_sha256"]


def language_family(path: Column) -> Column:
    """Language family by extension; NULL if there is no route."""
    routes = [(endings, name) for name, endings in FAMILIES.items()]
    family = F.lit(None).cast("string")
    for endings, name in reversed(routes):
        family = F.when(suffix(path).isin(endings), name).otherwise(family)
    return family


def route(files: DataFrame) -> DataFrame:
    return files.withColumn("family", language_family(F.col("file_path")))


def skip_indexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose bytes are not indexed yet, under whatever path.

    Pass files without their content: only path and hash should be shuffled. A
    hash shared by very many files skews only this side of the join, which
    adaptive execution splits.
    """
    known = index.select("file_sha256").distinct()
    return files.join(known, "file_sha256", "left_anti").select(files.columns)


def dedupe_batch(files: DataFrame) -> DataFrame:
    """Of files with equal bytes keep the first path that produced blocks.

    ``files`` has file_path, file_sha256 and blocks. The winner is a partial
    aggregate, so a hash shared by a third of all files stays one row per task.
    """
    winners = (
        files.where(F.col("blocks") > 0).groupBy("file_sha256").agg(F.min("file_path").alias("file_path"))
    )
    return files.join(winners.select("file_path"), "file_path", "left_semi").select(files.columns)


def count_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("file_path").agg(F.count("*").alias("blocks"))


def drop_empty(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files with at least one block, with their number of blocks."""
    return files.join(count_blocks(blocks), "file_path")


def attach_embeddings(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pair the i-th block with the i-th vector of its file; extra ones on either side drop."""
    return blocks.join(vectors.select("file_path", "ordinal", "embedding"), ["file_path", "ordinal"])


def assemble_metadata() -> Column:
    """JSON document of a block: base keys, then whatever metadata it carries."""
    return F.to_json(F.struct(*BASE_KEYS, *META_FIELDS))


def file_outcomes(files: DataFrame) -> DataFrame:
    """One row per discovered file: success, skipped or failed, with counts.

    ``files`` has file_path, family, known (bytes already indexed), blocks,
    vectors, winner (kept by deduplication) and error.
    """
    failed = F.col("error").isNotNull()
    reason = (
        F.when(F.col("known"), "duplicate")
        .when(F.col("family").isNull(), "no parser")
        .when(failed, "error")
        .when(F.coalesce("blocks", F.lit(0)) == 0, "no blocks")
        .when(~F.col("winner"), "duplicate")
    )
    status = F.when(reason == "error", "failed").when(reason.isNotNull(), "skipped").otherwise("success")
    done = status == "success"
    return files.select(
        "file_path",
        status.alias("status"),
        reason.alias("reason"),
        F.when(done, F.col("blocks")).otherwise(0).cast("bigint").alias("blocks_extracted"),
        F.when(done, F.col("vectors")).otherwise(0).cast("bigint").alias("embeddings_generated"),
        F.when(reason == "error", F.col("error")).alias("error"),
    )


def job_metrics(outcomes: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """One row of counts over all outcomes."""
    return outcomes.agg(
        F.count("*").alias("files_discovered"),
        F.count_if(F.col("status") == "success").alias("files_processed"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.count_if(F.col("status") == "failed").alias("files_failed"),
        F.coalesce(
            F.sum(F.when(F.col("status") == "success", F.col("blocks_extracted"))), F.lit(0)
        ).alias("blocks_inserted"),
        F.lit(elapsed_seconds).cast("double").alias("elapsed_seconds"),
    )
