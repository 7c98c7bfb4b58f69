"""The ingest flow: files to blocks to index, with outcomes and metrics."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators import files as steps
from codeloom.operators.embed import embed_blocks, hashed_words
from codeloom.operators.extract import (
    cfml_blocks,
    html_blocks,
    java_blocks,
    jsx_blocks,
    sql_blocks,
)
from codeloom.schema import BLOCKS, FILE_OUTCOMES, conform
from codeloom.session import settings, stage, staging_area
from codeloom.sources.block_index import BUCKETS, index_exists, part_of, parts_for, read_index, write_blocks
from codeloom.sources.files import check_root, fingerprint, list_files, read_files, read_text

SETTINGS = {
    # A query's shuffle files go when it ends. Otherwise they stay until the driver happens to
    # collect its garbage, and a run holds those of all its queries at once.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Staged rows take up to twenty times as much in memory.
    "spark.sql.files.maxPartitionBytes": "16m",
}


@dataclass
class IngestJob:
    """Result of a run: its status, one outcome per file and the one-row metrics."""

    status: str  # completed | failed
    outcomes: DataFrame
    metrics: DataFrame


def extraction_jobs(sql_dialect: str) -> dict[str, Callable[..., DataFrame]]:
    """The extraction job of each language family."""
    return {
        "java": java_blocks,
        "jsx": jsx_blocks,
        "html": html_blocks,
        "cfml": partial(cfml_blocks, sql_dialect=sql_dialect),
        "sql": partial(sql_blocks, sql_dialect=sql_dialect),
    }


def extract_blocks(
    files: DataFrame, sql_dialect: str = "unknown", keep_empty: bool = False
) -> DataFrame:
    """Blocks of all routed files (file_path, family, text; other columns are carried)."""
    parts = [
        job(files.where(F.col("family") == family), keep_empty=keep_empty)
        for family, job in extraction_jobs(sql_dialect).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _read_and_extract(files: DataFrame, root: str, sql_dialect: str) -> DataFrame:
    """Blocks of files on disk, one NULL block for a file without any.

    ``files`` (file_path, family, length) should be staged: paths are split by family
    before their contents are read, so each file is read once although every family is
    a job of its own.
    """
    sizes = {r["family"]: r["bytes"] for r in files.groupBy("family").agg(F.sum("length").alias("bytes")).collect()}
    jobs = extraction_jobs(sql_dialect)
    names = [*[f.name for f in BLOCKS.fields], "file_sha256", "family", "error"]
    parts = []
    for family in [f for f in jobs if f in sizes]:
        read = read_files(files.where(F.col("family") == family), root, sizes[family])
        texts = read_text(fingerprint(read)).withColumn("family", F.lit(family))
        parts.append(jobs[family](texts, keep_empty=True).select(names))
    if not parts:
        empty = "file_sha256 string, family string, error string"
        return files.sparkSession.createDataFrame(
            [], T.StructType([*BLOCKS.fields, *T.StructType.fromDDL(empty).fields])
        )
    return reduce(DataFrame.unionByName, parts)


def ingest(
    spark: SparkSession,
    root: str,
    index_path: str,
    embedder: Callable[[Column], Column] | None = None,
    sql_dialect: str = "unknown",
    buckets: int = BUCKETS,
) -> IngestJob:
    """Index all supported files below ``root``.

    Content already in the index at the start, or twice in this run, is skipped;
    a file that cannot be read, cut or embedded fails alone; every other file
    replaces its own rows. All of it becomes visible with one commit.
    """
    started = time.monotonic()
    if not check_root(spark, root):
        outcomes = spark.createDataFrame([], FILE_OUTCOMES)
        return IngestJob("failed", outcomes, steps.job_metrics(outcomes))

    # The intermediate tables live in an area of this run, the large ones in areas of the steps
    # that read them; outcomes outlive them all.
    with staging_area(spark) as keep, settings(spark, SETTINGS):
        facts = _index_files(spark, root, index_path, embedder, sql_dialect, buckets, keep)
        outcomes = stage(conform(steps.file_outcomes(facts), FILE_OUTCOMES), "outcomes")
    return IngestJob(
        "completed", outcomes, steps.job_metrics(outcomes, time.monotonic() - started)
    )


def _cut(
    copies: DataFrame, root: str, sql_dialect: str, keep: Callable[..., DataFrame]
) -> DataFrame:
    """Blocks of one file of each content and family; another is cut only if that one cannot be read now."""
    cut, tried = None, None
    while True:
        left = copies if tried is None else copies.join(tried, "file_path", "left_anti")
        if cut is not None:
            settled = cut.where(F.col("error").isNull()).select("file_sha256", "family").distinct()
            left = left.join(settled, ["file_sha256", "family"], "left_anti")
        alone = left.groupBy("file_sha256", "family", "length").agg(F.min("file_path").alias("file_path"))
        elected = keep(alone, "elected")
        if cut is not None and elected.isEmpty():
            return cut
        more = keep(_read_and_extract(elected, root, sql_dialect), "blocks")
        cut = more if cut is None else cut.unionByName(more)
        names = elected.select("file_path")
        tried = names if tried is None else tried.unionByName(names)
        if more.where(F.col("error").isNotNull()).isEmpty():
            return cut


def _index_files(
    spark: SparkSession,
    root: str,
    index_path: str,
    embedder: Callable[[Column], Column] | None,
    sql_dialect: str,
    buckets: int,
    keep: Callable[..., DataFrame],
) -> DataFrame:
    """Run all steps up to the commit; returns the facts outcomes are made of."""
    found = keep(list_files(spark, root), "files")
    unlisted = found.where(F.col("error").isNotNull()).select("file_path", F.col("error").alias("unlisted"))
    listed = found.where(F.col("error").isNull()).drop("error")
    # Hash first and drop the bytes: unchanged files and copies are never shuffled, cut or staged.
    hashed = keep(
        fingerprint(read_files(listed, root)).select(
            "file_path", "file_sha256", F.length("content").cast("long").alias("length"), "error"
        ),
        "hashes",
    )
    fresh, known = hashed.where(F.col("error").isNull()), None
    if index_exists(spark, index_path):
        survivors = keep(steps.skip_indexed(fresh, read_index(spark, index_path)).select("file_path"), "fresh")
        known = fresh.join(survivors, "file_path", "left_anti").select("file_path")
        fresh = fresh.join(survivors, "file_path", "left_semi")

    copies = steps.route(fresh.drop("error")).select("file_path", "file_sha256", "family", "length")
    if known is not None:
        copies = keep(copies, "copies")
    with staging_area(spark) as keep_vectors:
        # Blocks are read for the last time when their vectors are made.
        with staging_area(spark) as keep_blocks:
            cut = _cut(copies, root, sql_dialect, keep_blocks)
            # All rows of a file carry its hash, family and error. Few files lose or fail, so blocks
            # and vectors are joined with those and not with all others.
            per_file = keep(
                cut.groupBy("file_path", "file_sha256", "family", "error").agg(F.count("node_type").alias("blocks")),
                "per-file",
            )
            filled = per_file.where(F.col("error").isNull() & (F.col("blocks") > 0))
            winners = steps.dedupe_batch(filled).select("file_path")
            lost = keep_blocks(filled.join(winners, "file_path", "left_anti").select("file_path"), "lost")
            blocks = cut.where(F.col("node_type").isNotNull() & F.col("error").isNull())
            blocks = blocks.join(lost, "file_path", "left_anti")
            # Vectors may come from a paid service: computed once, then only read.
            vectors = embed_blocks(blocks, embedder or hashed_words())
            vectors = vectors.withColumn("has_vector", F.col("embedding").isNotNull())
            # Many rows are written part by part, so that no shuffle holds them all.
            parts = parts_for(filled.agg(F.sum("blocks")).first()[0] or 0, buckets)
            if parts > 1:
                vectors = vectors.withColumn("part", part_of(F.col("file_path"), parts))
            vectors = keep_vectors(vectors, "vectors", partitionBy="part" if parts > 1 else None)
        embedded = keep(vectors.groupBy("file_path").agg(F.count_if("has_vector").alias("vectors")), "embedded")
        refusals = vectors.where(F.col("embed_error").isNotNull())
        refused = keep(refusals.groupBy("file_path").agg(F.max("embed_error").alias("embed_error")), "refused")
        write_blocks(
            spark, index_path, vectors.join(refused.select("file_path"), "file_path", "left_anti"), buckets, parts
        )

    # A copy that was not cut has as many blocks as the file cut for it.
    counted = per_file.where(F.col("error").isNull()).groupBy("file_sha256", "family").agg(F.max("blocks").alias("blocks"))
    alike = copies.join(counted, ["file_sha256", "family"], "left").select("file_path", F.col("blocks").alias("alike"))
    unread = hashed.where(F.col("error").isNotNull()).select("file_path", F.col("error").alias("unread"))
    facts = (
        listed.select("file_path", F.lit(None).cast("string").alias("unlisted"))
        .unionByName(unlisted)
        .join(per_file.drop("family"), "file_path", "left")
        .join(alike, "file_path", "left")
        .join(unread, "file_path", "left")
        .join(embedded, "file_path", "left")
        .join(refused, "file_path", "left")
        .withColumn("blocks", F.coalesce("blocks", "alike"))
        # A directory that could not be listed failed; it is no file without a parser.
        .withColumn("family", F.when(F.col("unlisted").isNotNull(), "directory").otherwise(steps.language_family(F.col("file_path"))))
        .withColumn("winner", F.col("vectors").isNotNull())
        .withColumn("error", F.coalesce("unlisted", "unread", "error", "embed_error"))
        .drop("unlisted", "unread", "alike")
    )
    if known is None:
        facts = facts.withColumn("known", F.lit(False))
    else:
        facts = facts.join(known.withColumn("known", F.lit(True)), "file_path", "left").withColumn(
            "known", F.coalesce("known", F.lit(False))
        )
    return facts
