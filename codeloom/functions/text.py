"""Text idioms as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends (``trim`` only drops blanks)."""
    return F.regexp_replace(text, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot; a dot-file has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+\z", "")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def distinct_matches(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of one group, first occurrence order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def none_if_empty(names: Column) -> Column:
    # As a filter over one element, so that ``names`` is not worked out a second time.
    return F.get(F.filter(F.array(names), lambda found: F.size(found) > 0), F.lit(0))


def none_if_blank(text: Column) -> Column:
    return F.when(text != "", text)


def join_slice(parts: Column, first: Column, last: Column, glue: str) -> Column:
    """Join array elements ``first..last`` (0-based, inclusive)."""
    return F.array_join(F.slice(parts, first + 1, last - first + 1), glue)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``use`` refer to it any number of times.

    Needed inside lambdas, where the optimizer would otherwise copy a column's
    definition to every place it is used.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
