"""Shared shape of all extraction jobs.

A job takes a frame with ``file_path`` and ``text`` (other columns are
carried along) and returns one row per block. Everything happens inside the
file's own row - cut into tokens, pair brackets, build spans - so a job is
map-only: no source text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import newlines
from codeloom.schema import META_FIELDS, SPAN_FIELDS

SPAN_COLUMNS = list(SPAN_FIELDS)
WORK = "__"  # prefix of helper columns


def tokens(text: Column, pattern: str) -> Column:
    """Cut ``text`` into consecutive tokens; ``pattern`` must match everywhere."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def line_counts(parts: Column) -> Column:
    return F.transform(parts, newlines)


def carried(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "text" and not c.startswith(WORK)]


def explode_spans(df: DataFrame, spans: str, keep_empty: bool) -> DataFrame:
    """One row per span struct; with ``keep_empty`` a file without spans keeps one NULL row.

    Always an outer explode: for an inner one the optimizer would add a filter
    that computes all spans a second time.
    """
    keep = [c for c in df.columns if c != spans]
    rows = df.select(*keep, F.posexplode_outer(spans).alias("ordinal", "__span"))
    return rows if keep_empty else rows.where(F.col("__span").isNotNull())


def finish(df: DataFrame, keep: list[str], **columns: Column | None) -> DataFrame:
    """Project to the block schema; unnamed metadata fields are NULL."""
    types = {**SPAN_FIELDS, **META_FIELDS}
    out = []
    for name, kind in types.items():
        if name in keep:
            continue
        value = columns.get(name)
        if value is None and name == "ordinal":
            value = F.col("ordinal")
        out.append((F.lit(None) if value is None else value).cast(kind).alias(name))
    return df.select(*keep, *out)
