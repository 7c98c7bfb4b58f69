"""Embedding jobs: one vector per block from a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schema import EMBEDDING

DIMENSION = 3072

# A column embedder maps a text column to a vector column. A client factory is
# called once per task and returns ``texts -> vectors``.
ColumnEmbedder = Callable[[Column], Column]
Client = Callable[[list[str]], Sequence[Sequence[float]]]

_RESULT = T.StructType(
    [T.StructField("embedding", EMBEDDING), T.StructField("error", T.StringType())]
)


# Letters of any script with their marks, digits and the underscore.
WORD = r"[\p{L}\p{M}\p{N}_]+"


def hashed_words(dimension: int = DIMENSION) -> ColumnEmbedder:
    """Deterministic embedder: counts of hashed words, scaled to unit length.

    Words are cut in the JVM; the kernel hashes each distinct word of an Arrow
    batch once and counts for the whole batch.
    """

    def hashed(words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        slots = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dimension for w in coded.dictionary.to_pylist()]
        return np.array(slots, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def unit_counts(row: np.ndarray, flat: np.ndarray, rows: int) -> np.ndarray:
        matrix = np.bincount(row * dimension + flat, minlength=rows * dimension)
        matrix = matrix.reshape(rows, dimension).astype(np.float64)
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, length, out=matrix, where=length > 0).astype(np.float32)

    @F.arrow_udf(EMBEDDING)
    def count(words: pa.Array) -> pa.Array:
        rows = len(words)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        slots = hashed(words.flatten())
        parts = []
        for low in range(0, rows, 512):
            high = min(low + 512, rows)
            row = np.repeat(np.arange(high - low), sizes[low:high])
            parts.append(unit_counts(row, slots[ends[low] : ends[high]], high - low).ravel())
        return pa.ListArray.from_arrays(
            pa.array(np.arange(rows + 1) * dimension, pa.int32()),
            pa.array(np.concatenate(parts) if parts else np.zeros(0, np.float32)),
        )

    def embed(text: Column) -> Column:
        return count(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))

    return embed


def client_embedder(factory: Callable[[], Client], batch: int = 256) -> Callable[[Column], Column]:
    """Embedder around an external client; yields (embedding, error) per text.

    If a batch fails its texts are tried alone, so only the bad ones fail.
    """

    @F.arrow_udf(_RESULT)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = factory()

        def alone(text: str):
            try:
                return [float(x) for x in client([text])[0]], None
            except Exception as problem:
                return None, f"{type(problem).__name__}: {problem}"

        def together(texts: list[str]):
            try:
                vectors = client(texts)
                if len(vectors) != len(texts):
                    raise ValueError("embedder returned a different number of vectors")
                return [([float(x) for x in v], None) for v in vectors]
            except Exception:
                return [alone(t) for t in texts]

        for texts in parts:
            values = texts.to_pylist()
            done = [r for i in range(0, len(values), batch) for r in together(values[i : i + batch])]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([v for v, _ in done], pa.list_(pa.float32())),
                    pa.array([e for _, e in done], pa.string()),
                ],
                ["embedding", "error"],
            )

    return run


def embed_blocks(
    blocks: DataFrame, embedder: Callable[[Column], Column], text: str = "content"
) -> DataFrame:
    """Add ``embedding`` and ``embed_error`` for the text column of each row."""
    out = blocks.withColumn("__vector", embedder(F.col(text)))
    if isinstance(out.schema["__vector"].dataType, T.StructType):
        vector, error = F.col("__vector.embedding"), F.col("__vector.error")
    else:
        vector, error = F.col("__vector"), F.lit(None).cast("string")
    return out.select(*blocks.columns, vector.alias("embedding"), error.alias("embed_error"))


def embed_query(
    spark: SparkSession, text: str, embedder: Callable[[Column], Column]
) -> list[float]:
    """Vector of one query text. An empty text is refused, blanks are not."""
    if not text:
        raise ValueError("query cannot be empty")
    row = embed_blocks(spark.createDataFrame([(text,)], "content string"), embedder).first()
    if row["embed_error"]:
        raise RuntimeError(row["embed_error"])
    return list(row["embedding"])
