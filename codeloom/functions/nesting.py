"""Prefix sums and nesting over per-file token arrays.

The inputs are arrays of small integers or tag names, one array per file, so
the text itself never leaves the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = T.ArrayType(T.IntegerType())


def rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values, offsets


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    base = offsets[0]
    return pa.ListArray.from_arrays(
        pa.array(offsets - base, pa.int32()), pa.array(values[base : offsets[-1]], pa.int32())
    )


@F.arrow_udf(INTEGERS)
def running_before(counts: pa.Array) -> pa.Array:
    """For each element the sum of the elements before it, per row."""
    values, offsets = rows(counts)
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    lengths = np.diff(offsets)
    start = np.repeat(before[offsets[:-1]], lengths)
    out = np.zeros(len(values), dtype=np.int32)
    out[offsets[0] : offsets[-1]] = before[offsets[0] : offsets[-1]] - start
    return lists(out, offsets)


@F.arrow_udf(INTEGERS)
def closing_partner(steps: pa.Array) -> pa.Array:
    """For each +1 the index of its -1 (last index if never closed), else -1.

    A bracket and its partner sit at the same depth with nothing of that depth
    between them, so sorting the brackets by (row, depth, position) makes
    partners neighbours.
    """
    values, offsets = rows(steps)
    at = np.flatnonzero(values)
    at = at[(at >= offsets[0]) & (at < offsets[-1])]
    row = np.searchsorted(offsets, at, side="right") - 1
    opens = values[at] > 0
    depth = np.cumsum(values[at], dtype=np.int64) + ~opens
    order = np.lexsort((at, depth, row))
    row, depth, opens, at = row[order], depth[order], opens[order], at[order]
    paired = np.zeros(len(at), dtype=bool)
    paired[:-1] = opens[:-1] & ~opens[1:] & (row[:-1] == row[1:]) & (depth[:-1] == depth[1:])
    partner = np.where(paired, np.append(at[1:], -1), offsets[row + 1] - 1) - offsets[row]
    out = np.full(len(values), -1, dtype=np.int32)
    out[at[opens]] = partner[opens]
    return lists(out, offsets)


@F.arrow_udf(INTEGERS)
def next_known(numbers: pa.Array) -> pa.Array:
    """For each element the first one at or after it that is not negative, else -1."""
    values, offsets = rows(numbers)
    low, high = offsets[0], offsets[-1]
    known = values[low:high] >= 0
    place = np.where(known, np.arange(high - low), high - low)
    place = np.minimum.accumulate(place[::-1])[::-1]
    end = np.repeat(offsets[1:] - low, np.diff(offsets))
    out = np.full(len(values), -1, dtype=np.int32)
    found = place < end
    out[low:high][found] = values[low:high][place[found]]
    return lists(out, offsets)


@F.arrow_udf(INTEGERS)
def last_marked(flags: pa.Array) -> pa.Array:
    """For each element the index of the last positive one up to it, else -1."""
    values, offsets = rows(flags)
    low, high = offsets[0], offsets[-1]
    begin = np.repeat(offsets[:-1] - low, np.diff(offsets))
    place = np.maximum.accumulate(np.where(values[low:high] > 0, np.arange(high - low), -1))
    out = np.full(len(values), -1, dtype=np.int32)
    out[low:high] = np.where(place >= begin, place - begin, -1)
    return lists(out, offsets)


_SPANS = T.ArrayType(
    T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
)


def top_level_spans(ended_by: dict[str, list[str]]):
    """Arrow UDF: token ranges of the outermost elements of each document.

    A token is ``name`` (start tag), ``/name`` (end tag), ``name/`` (start and
    end in one) or empty. ``ended_by`` tells which children end an element
    whose end tag is missing. What is still open at the end runs to the end.
    """
    rules = {parent: frozenset(children) for parent, children in ended_by.items()}

    def outermost(tags: list[str]) -> list[dict]:
        found: list[dict] = []
        open_names: list[str] = []
        begin = 0
        for i, tag in enumerate(tags):
            if not tag:
                continue
            if tag[0] == "/":
                name = tag[1:]
                if name in open_names:
                    while open_names.pop() != name:
                        pass
                    if not open_names:
                        found.append({"first": begin, "last": i})
                continue
            name = tag.rstrip("/")
            nested = bool(open_names)
            while open_names and name in rules.get(open_names[-1], ()):
                open_names.pop()
            if nested and not open_names:
                found.append({"first": begin, "last": i - 1})
            if not open_names:
                begin = i
            if tag[-1] != "/":
                open_names.append(name)
            elif not open_names:
                found.append({"first": i, "last": i})
        if open_names:
            found.append({"first": begin, "last": len(tags) - 1})
        return found

    @F.arrow_udf(_SPANS)
    def spans(documents: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.array([outermost(tags) for tags in documents.to_pylist()], kind)

    return spans
