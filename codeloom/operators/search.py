"""Cosine search: exact top-k, batched top-k and an approximate variant."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.vectors import (
    CHUNK_NUMBERS,
    as_matrix,
    distance_to,
    matrices,
    row_distances,
)
from codeloom.session import stage

# Bytes of query vectors held by a task at a time in a batch search.
QUERY_BYTES = 32 * 1024 * 1024
# Distances this close may swap under a faster matrix product, so both are re-scored.
SLACK = 1e-9


def metadata_filter(
    index: DataFrame, language: str | None = None, node_type: str | None = None
) -> DataFrame:
    """Keep rows of the given language and node type; None does not filter."""
    for name, value in (("language", language), ("node_type", node_type)):
        if value is not None:
            index = index.where(F.col(name) == value)
    return index


def best_first(score: str = "score") -> list[Column]:
    """Nearest first, then NaN, then NULL; equal scores by id."""
    return [F.col(score).asc_nulls_last(), F.col("id").asc()]


def search(
    index: DataFrame,
    query: Sequence[float],
    limit: int,
    language: str | None = None,
    node_type: str | None = None,
) -> DataFrame:
    """Exact nearest blocks of one query vector, with ``score`` instead of the embedding.

    One scan: each task keeps its own best ``limit`` rows, nothing else moves.
    """
    rows = metadata_filter(index, language, node_type)
    scored = rows.withColumn("score", distance_to(query)(F.col("embedding"))).drop("embedding")
    return scored.orderBy(*best_first()).limit(limit)


def _candidates(rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
    """(query, row, exact distance) of every pair that may be among a query's k nearest.

    A matrix product gives distances up to rounding. Only pairs within the k-th
    best so far, with some slack, are scored exactly, so ties stay ties.
    """
    lengths = np.sqrt((rows * rows).sum(axis=1))
    norms = np.sqrt((queries * queries).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = 1.0 - (queries @ rows.T) / (norms[:, None] * lengths)
    rough[np.isnan(rough)] = np.inf
    if len(rows) > k:
        bounds = np.minimum(bounds, np.partition(rough, k - 1, axis=1)[:, k - 1])
    q, r = np.nonzero(rough <= (bounds + SLACK)[:, None])
    step = max(1, CHUNK_NUMBERS // rows.shape[1])
    exact = [
        row_distances(rows[r[i : i + step]], queries[q[i : i + step]]) for i in range(0, len(q), step)
    ]
    return q, r, np.concatenate(exact) if exact else np.zeros(0)


def _query_blocks(files: Sequence[str], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the staged queries, at most ``size`` at a time, always cut alike."""
    for file in files:
        store, path = pafs.FileSystem.from_uri(file)
        with store.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(size):
                if batch.num_rows:
                    yield batch.column(0), as_matrix(batch.column(1))


def _partial_top(id_type: pa.DataType, files: Sequence[str], size: int, k: int):
    """Task-side top-k of all staged queries over the partition.

    Rows come in chunks of bounded size, and each chunk meets the queries block by
    block. Of a query a task holds its k best distances, 8 bytes each; what beats
    them leaves the task at once, so its rows are at most k per query and chunk.
    """

    def order(row: tuple) -> tuple:
        return row[0] is None, row[0] is not None and row[0] != row[0], row[0] or 0.0, row[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}

        def meet(ids: pa.Array, rows: np.ndarray, unknown: list) -> Iterator[pa.RecordBatch]:
            for number, (qids, queries) in enumerate(_query_blocks(files, size)):
                held = best.setdefault(number, np.full((len(qids), k), np.inf))
                bounds = held[:, -1]
                found: dict[int, list[tuple]] = {}
                # Few enough queries at a time that the distance matrix stays small.
                width = max(1, CHUNK_NUMBERS // max(1, len(rows)))
                for start in range(0, len(qids) if len(rows) else 0, width):
                    part = slice(start, start + width)
                    q, r, score = _candidates(rows, queries[part], bounds[part], k)
                    names, scores = ids.take(pa.array(r, pa.int64())).to_pylist(), score.tolist()
                    edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1)).tolist()
                    for lo, hi in zip(edges, edges[1:], strict=False):
                        found[start + int(q[lo])] = list(zip(scores[lo:hi], names[lo:hi], strict=True))
                for open_ in np.flatnonzero(np.isinf(bounds)).tolist() if unknown else ():
                    found[open_] = [*found.get(open_, []), *((None, i) for i in unknown)]
                out = []
                for at, hits in found.items():
                    hits = sorted(hits, key=order)[:k]
                    out += [(at, i, s) for s, i in hits]
                    real = [s for s, _ in hits if s is not None and s == s]
                    held[at] = np.sort(np.concatenate([held[at], real]))[:k]
                if out:
                    at, i, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [qids.take(pa.array(at)), pa.array(i, id_type), pa.array(s, pa.float64(), from_pandas=False)],
                        ["query_id", "id", "score"],
                    )

        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            present, known = ids.filter(vectors.is_valid()), vectors.drop_null()
            for first, rows in matrices(known):
                yield from meet(present.slice(first, len(rows)), rows, [])
            if len(present) < len(ids):
                unknown = sorted(ids.filter(vectors.is_null()).to_pylist())[:k]
                yield from meet(present.slice(0, 0), np.zeros((0, 1)), unknown)

    return run


def search_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    language: str | None = None,
    node_type: str | None = None,
) -> DataFrame:
    """Exact nearest blocks for many queries: query_id, rank, id, score.

    The queries are staged in the shared folder and read there by the tasks, so
    they pass neither through the driver nor through the plan, and one scan of the
    index serves any number of them. The final ranking shuffles no embeddings.
    """
    rows = metadata_filter(index, language, node_type).select("id", "embedding")
    out_type = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", index.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    id_type = pa.int64() if isinstance(index.schema["id"].dataType, T.LongType) else pa.string()
    staged = stage(queries.select("query_id", "embedding"), "queries")
    width = staged.agg(F.max(F.size("embedding"))).first()[0] or 1
    size = max(1, QUERY_BYTES // (8 * max(1, width)))
    found = rows.mapInArrow(_partial_top(id_type, sorted(staged.inputFiles()), size, k), out_type)
    ranked = Window.partitionBy("query_id").orderBy(*best_first())
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


# --- approximate search -------------------------------------------------------


def hyperplanes(bits: int, dimension: int) -> np.ndarray:
    """Fixed +1/-1 hyperplanes from an arithmetic rule, so signatures never change."""
    b = np.arange(bits, dtype=np.int64)[:, None]
    i = np.arange(dimension, dtype=np.int64)[None, :]
    mixed = ((i + 1) * (b + 3) * 7919 + (i + 1) * (i + 1) * 31 + (b + 1) * (b + 1) * 104729) % 10007
    return np.where((mixed * mixed) % 10007 % 2 == 0, 1.0, -1.0)


def with_signature(index: DataFrame, bits: int, dimension: int) -> DataFrame:
    """Add ``signature``: on which side of each hyperplane the embedding lies.

    Store it with the table, partitioned or sorted by it, and a search reads
    only the few signatures it probes.
    """
    planes = hyperplanes(bits, dimension)

    @F.arrow_udf(T.IntegerType())
    def sign(embedding: pa.Array) -> pa.Array:
        known = embedding.drop_null()
        codes = np.zeros(len(embedding), dtype=np.int32)
        missing = np.asarray(embedding.is_null())
        if len(known):
            sides = [rows @ planes.T >= 0 for _, rows in matrices(known)]
            codes[~missing] = np.concatenate(sides) @ (1 << np.arange(bits))
        return pa.array(codes, pa.int32(), mask=missing)

    return index.withColumn("signature", sign(F.col("embedding")))


def probes(query: Sequence[float], bits: int, flips: int) -> list[int]:
    """Signatures to look at: the query's own and those with its least certain bits flipped."""
    vector = np.asarray(query, dtype=np.float64)
    side = hyperplanes(bits, len(vector)) @ vector
    code = int((side >= 0) @ (1 << np.arange(bits)))
    doubtful = np.argsort(np.abs(side), kind="stable")[:flips].tolist()
    out = []
    for choice in range(1 << len(doubtful)):
        flipped = code
        for n, bit in enumerate(doubtful):
            if choice >> n & 1:
                flipped ^= 1 << bit
        out.append(flipped)
    return sorted(out)


def ann_search(
    signed_index: DataFrame,
    query: Sequence[float],
    limit: int,
    bits: int,
    flips: int = 4,
    language: str | None = None,
    node_type: str | None = None,
) -> DataFrame:
    """Approximate nearest blocks: exact ranking among the probed signatures only.

    ``flips`` doubtful bits give the first probes. While these hold fewer than
    ``limit`` rows more bits are flipped, and in the end every row is ranked, so
    a result is short only where the index is.
    """
    rows = metadata_filter(signed_index, language, node_type)
    for flipped in range(flips, bits, 2):
        near = rows.where(F.col("signature").isin(probes(query, bits, flipped)))
        if near.select("signature").limit(limit).count() == limit:
            return search(near, query, limit)
    return search(rows, query, limit)
