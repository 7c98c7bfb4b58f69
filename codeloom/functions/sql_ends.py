"""Where the statements of a token array end: at ``;`` outside bodies, and at separator lines.

BEGIN and CASE pair with END within a batch (what stands between separator lines),
so a block that is never closed reaches no further. A ``;`` inside such a pair ends
nothing. In a routine a ``;`` before its body ends nothing either, and one behind
the body only if a new statement begins there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.functions.brackets import pair
from codeloom.functions.nesting import INTEGERS, lists, rows

# Codes of tokens: a gap is white space or a comment, a verb a word that statements begin
# with, a head the first words of a routine or of an anonymous block's declarations.
OTHER, GAP, SEMICOLON, SEPARATOR, OPEN, CLOSE, VERB, HEAD = range(8)


def _next(wanted: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first place at or after each one where ``wanted`` holds, at most ``limit`` there."""
    place = np.where(wanted, np.arange(len(wanted)), len(wanted))
    return np.minimum(np.minimum.accumulate(place[::-1])[::-1], limit)


def statement_ends(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each token ends a statement and is no part of it; ``row`` (ascending) is its text."""
    n = len(code)
    ends = code == SEPARATOR
    if not n:
        return ends
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    batch = np.cumsum(new_row | np.concatenate([[False], ends[:-1]]))
    last = np.searchsorted(batch, batch, side="right")  # behind each token's batch

    at = np.flatnonzero((code == OPEN) | (code == CLOSE))
    depth = np.zeros(n + 1, dtype=np.int64)
    if len(at):
        step = np.where(code[at] == OPEN, 1, -1)
        partner = pair(batch[at], at, step)
        opened = (partner >= 0) & (step > 0)
        np.add.at(depth, at[opened], 1)
        np.add.at(depth, at[partner[opened]], -1)
    outside = np.cumsum(depth)[:-1] == 0

    free = (code == SEMICOLON) & outside
    # A ``;`` is hard if what follows begins a statement or ends the batch.
    word = np.append(_next(code != GAP, last), n)[np.minimum(np.arange(n) + 1, n)]
    word = np.minimum(word, last)
    begins = np.isin(np.append(code, SEPARATOR)[word], (VERB, HEAD, SEPARATOR)) | (word >= last)
    hard = free & begins
    next_hard, next_open = _next(hard, last), _next((code == OPEN) & (depth[:-1] > 0), last)
    # Routines with a body before anything else begins: no soft ``;`` from head to hard end.
    heads = np.flatnonzero((code == HEAD) & outside)
    bodied = heads[next_open[heads] < next_hard[heads]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, bodied, 1)
    np.add.at(cover, np.minimum(next_hard[bodied], n), -1)
    return ends | (free & ((np.cumsum(cover)[:-1] == 0) | hard))


@F.arrow_udf(INTEGERS)
def ends_of_statements(codes: pa.Array) -> pa.Array:
    """:func:`statement_ends` for the tokens of each row, as 0 and 1."""
    values, offsets = rows(codes)
    low, high = offsets[0], offsets[-1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(len(values), dtype=np.int32)
    out[low:high] = statement_ends(values[low:high], row)
    return lists(out, offsets)
