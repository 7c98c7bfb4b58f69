"""Cosine distance, as a column expression and as an Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Left-to-right sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b): 0 for the same direction, 2 for the opposite one.

    A zero vector has no direction, so its distance is NaN; NULL stays NULL.
    """
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(dot(a, b), length))


# Numbers a kernel converts to double precision at a time.
CHUNK_NUMBERS = 2_000_000


def as_matrix(column: pa.Array) -> np.ndarray:
    """Dense float64 rows of a list column without NULL lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row number and dense rows of successive chunks of bounded size."""
    if len(column):
        rows = max(1, CHUNK_NUMBERS // max(1, len(column[0])))
        for first in range(0, len(column), rows):
            yield first, as_matrix(column.slice(first, rows))


def row_distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distance of each row to its query (or to the one query of all rows).

    Every row is summed alone, so equal vectors get equal distances wherever
    they stand.
    """
    lengths = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((queries * queries).sum(axis=-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - (rows * queries).sum(axis=1) / lengths


def distance_to(query: Sequence[float]):
    """Arrow UDF ``embedding -> distance`` for one fixed query vector."""
    probe = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def score(embedding: pa.Array) -> pa.Array:
        known = embedding.drop_null()
        values = np.full(len(embedding), np.nan)
        missing = np.asarray(embedding.is_null())
        if len(known):
            parts = [row_distances(rows, probe) for _, rows in matrices(known)]
            values[~missing] = np.concatenate(parts)
        return pa.array(values, pa.float64(), mask=missing)

    return score
