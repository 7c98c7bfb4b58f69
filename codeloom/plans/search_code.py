"""The search entry point: embed the query, rank, optionally expand dependencies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.deps import ORDER, reach, reach_stored
from codeloom.operators.embed import embed_query
from codeloom.operators.files import assemble_metadata
from codeloom.operators.search import metadata_filter, search
from codeloom.session import stage
from codeloom.sources.block_index import has_names, read_index, read_names, read_rows


MAX_LIMIT, MAX_DEPTH = 50, 3


def _in_range(name: str, value: int, last: int) -> None:
    if value not in range(1, last + 1):
        raise ValueError(f"{name}={value} lies outside 1..{last}")


def check_search(query: str, limit: int, depth: int) -> None:
    if query == "":
        raise ValueError("a search needs some text")
    _in_range("limit", limit, MAX_LIMIT)
    _in_range("dependency_depth", depth, MAX_DEPTH)


def search_code(
    index: DataFrame,
    query: str,
    embedder: Callable[[Column], Column],
    limit: int = 10,
    language: str | None = None,
    node_type: str | None = None,
    expand_dependencies: bool = False,
    dependency_depth: int = 1,
) -> DataFrame:
    """Blocks similar to ``query``; see ``ranked_with_dependencies`` for the result."""
    check_search(query, limit, dependency_depth)
    vector = embed_query(index.sparkSession, query, embedder)
    depth = dependency_depth if expand_dependencies else 0
    return ranked_with_dependencies(index, vector, limit, language, node_type, depth)


def search_stored(
    spark: SparkSession,
    path: str,
    query: str,
    embedder: Callable[[Column], Column],
    limit: int = 10,
    language: str | None = None,
    node_type: str | None = None,
    expand_dependencies: bool = False,
    dependency_depth: int = 1,
    metadata: bool = False,
) -> DataFrame:
    """:func:`search_code` over the index at ``path``, whose stored names the expansion reads.

    With ``metadata`` each result has its JSON document in a further column.
    """
    check_search(query, limit, dependency_depth)
    vector = embed_query(spark, query, embedder)
    depth = dependency_depth if expand_dependencies else 0
    stored = path if has_names(spark, path) else None
    found = ranked_with_dependencies(read_index(spark, path), vector, limit, language, node_type, depth, stored)
    return found.withColumn("metadata", assemble_metadata()) if metadata else found


def ranked_with_dependencies(
    index: DataFrame,
    vector: Sequence[float],
    limit: int,
    language: str | None = None,
    node_type: str | None = None,
    depth: int = 0,
    stored: str | None = None,
) -> DataFrame:
    """Primary results by score, then their dependencies without one.

    ``rank`` keeps the order; ``is_dependency`` tells the two apart. With
    ``stored``, the place of the index, dependencies are followed in its table of
    names and only their own rows are read.
    """
    spark = index.sparkSession
    # At most 50 rows: held as data, so ranking and expansion see the same ones.
    top = _fetched(index, _ranking(index, vector, limit, language, node_type).collect())
    rows = top.collect()
    primary = spark.createDataFrame(rows, top.schema)
    order = Window.orderBy(F.col("score").asc_nulls_last(), "id")
    ranked = primary.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn(
        "is_dependency", F.lit(False)
    )
    reached = None
    if depth and rows:
        names = partial(read_names, spark, stored)
        reached = reach_stored(names, primary, depth) if stored else reach(index, primary, depth)
    if reached is None:
        return ranked.orderBy("rank")
    numbers = _numbered(reached).select("id", (F.col("rank") + len(rows)).alias("rank"))
    whole = read_rows(spark, stored, reached) if stored else index
    deps = (
        whole.drop("embedding")
        .join(numbers, "id")
        .withColumn("score", F.lit(None).cast("double"))
        .withColumn("is_dependency", F.lit(True))
    )
    return ranked.unionByName(deps).orderBy("rank")


def _ranking(
    index: DataFrame, vector: Sequence[float], limit: int, language: str | None, node_type: str | None
) -> DataFrame:
    """``id, file_path, score`` of the best rows; the scan reads no contents."""
    slim = metadata_filter(index, language, node_type).select("id", "file_path", "embedding")
    return search(slim, vector, limit)


def _fetched(index: DataFrame, hits: list[Row]) -> DataFrame:
    """The whole rows of at most 50 hits, with their scores.

    Paths and ids reach the scan as filters, so it skips the other row groups.
    """
    paths, ids = {h["file_path"] for h in hits}, [h["id"] for h in hits]
    known = [p for p in paths if p is not None]
    there = F.col("file_path").isin(known)
    if None in paths:
        there = there | F.col("file_path").isNull()
    rows = index.drop("embedding").where(there & F.col("id").isin(ids))
    score = F.lit(None).cast("double")
    for hit in hits:
        value = F.lit(None) if hit["score"] is None else F.lit(hit["score"])
        score = F.when(F.col("id") == hit["id"], value).otherwise(score)
    return rows.withColumn("score", score)


def _numbered(reached: DataFrame) -> DataFrame:
    """Add ``rank`` 1..n in the order of dependencies.

    A range partitioned sort gives each partition a contiguous stretch; adding
    the sizes of the earlier stretches numbers all rows without one big window.
    """
    placed = stage(
        reached.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "order"
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    local = Window.partitionBy("part").orderBy(*ORDER)
    # One row per partition, so broadcasting ``before`` is always small.
    return placed.join(F.broadcast(before), "part").select(
        "id", (F.row_number().over(local) + F.col("before")).alias("rank")
    )
