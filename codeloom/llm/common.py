"""Helpers the operators share: reading columns, staging, files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import stage, work_dir

SPACE = "\t\n\x0b\x0c\r "
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

__all__ = ["SPACE", "LOWER", "stage", "work_dir", "whole_texts", "table", "new_folder", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text``; a null text is the empty text."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front while ``docs`` has a column of that name."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def map_texts(docs: DataFrame, kernel: Callable, schema: str, *args) -> DataFrame:
    """``kernel(batch, *args)`` over Arrow batches, each of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                yield kernel(batch.slice(first, ROWS), *args)

    return docs.mapInArrow(run, schema)


ROWS = 1024


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
