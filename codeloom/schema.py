"""Schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR, _INT = T.StringType(), T.IntegerType()
_NAMES = T.ArrayType(T.StringType())

# Dependency metadata a block may carry. NULL means "key absent"; an empty
# array means "key present, nothing found" (only Java imports do that).
META_FIELDS: dict[str, T.DataType] = {
    "imports": _NAMES,
    "annotations": _NAMES,
    "class_name": _STR,
    "extends": _STR,
    "implements": _NAMES,
    "injects": _NAMES,
    "method_name": _STR,
    "return_type": _STR,
    "param_types": _NAMES,
    "calls": _NAMES,
    "component_name": _STR,
    "function_name": _STR,
    "calls_components": _NAMES,
    "hooks": _NAMES,
    "tables": _NAMES,
    "sql_dialect": _STR,
    "block_type": _STR,
    "injection_source_line": _INT,
}

# What an extraction job emits for one block of one file.
SPAN_FIELDS: dict[str, T.DataType] = {
    "file_path": _STR,
    "ordinal": _INT,
    "node_type": _STR,
    "language": _STR,
    "content": _STR,
    "start_line": _INT,
    "end_line": _INT,
}

BLOCKS = T.StructType(
    [T.StructField(n, t, n not in SPAN_FIELDS) for n, t in {**SPAN_FIELDS, **META_FIELDS}.items()]
)

EMBEDDING = T.ArrayType(T.FloatType())

BLOCK_INDEX = T.StructType(
    [
        T.StructField("id", _STR, False),
        *[T.StructField(n, t, False) for n, t in SPAN_FIELDS.items()],
        T.StructField("file_sha256", _STR, False),
        *[T.StructField(n, t, True) for n, t in META_FIELDS.items()],
        T.StructField("embedding", EMBEDDING, True),
    ]
)

FILE_OUTCOMES = T.StructType(
    [
        T.StructField("file_path", _STR, False),
        T.StructField("status", _STR, False),  # success | skipped | failed
        T.StructField("reason", _STR, True),  # why a file was skipped or failed
        T.StructField("blocks_extracted", T.LongType(), False),
        T.StructField("embeddings_generated", T.LongType(), False),
        T.StructField("error", _STR, True),
    ]
)


def conform(df: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    """Select the columns of ``schema`` in order, then ``more``; absent nullable ones become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *more,
    )
