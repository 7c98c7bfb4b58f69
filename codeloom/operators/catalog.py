"""Catalogue lookups on the block index. None of them reads embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.files import assemble_metadata

# Longest list of names that becomes a pushed-down filter instead of a join.
INLINE_NAMES = 200


def _in_order(rows: DataFrame, *leading: str) -> DataFrame:
    ties = [c for c in ("ordinal", "id") if c in rows.columns]
    return rows.orderBy(*leading, F.col("start_line").cast("int"), *ties)


def get_file_blocks(index: DataFrame, file_path: str, metadata: bool = False) -> DataFrame:
    """All blocks of one file by start line; an unknown path gives none.

    With ``metadata`` each block has its JSON document in a further column.
    """
    if not file_path:
        raise ValueError("blocks are looked up by the path of their file, which is missing")
    rows = index.drop("embedding").where(F.col("file_path") == file_path)
    return _in_order(rows.withColumn("metadata", assemble_metadata()) if metadata else rows)


def list_indexed_files(index: DataFrame) -> DataFrame:
    """Each indexed file with its number of blocks and smallest language, by path."""
    return (
        index.groupBy("file_path")
        .agg(
            F.count("*").alias("block_count"),
            F.coalesce(F.min("language"), F.lit("")).alias("language"),
        )
        .orderBy("file_path")
    )


def find_blocks_by_name(index: DataFrame, names: Sequence[str] | DataFrame, by: str) -> DataFrame:
    """Blocks whose class_name or component_name is one of ``names``, exactly."""
    if by not in ("class_name", "component_name"):
        raise ValueError(f"cannot look blocks up by {by}")
    rows = index.drop("embedding")
    if isinstance(names, DataFrame):
        wanted = names.select(F.col(names.columns[0]).alias(by)).distinct()
        return _in_order(rows.join(wanted, by, "left_semi").select(rows.columns), "file_path")
    listed = sorted(set(names))
    if len(listed) <= INLINE_NAMES:
        return _in_order(rows.where(F.col(by).isin(listed) if listed else F.lit(False)), "file_path")
    frame = index.sparkSession.createDataFrame([(n,) for n in listed], f"{by} string")
    return find_blocks_by_name(index, frame, by)
