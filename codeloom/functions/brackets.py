"""Which brackets of a token array pair up, and which of these lie inside others.

Parentheses pair within the block (pair of braces) they stand in, so one that is
never closed spoils nothing outside it. Angle brackets pair within the innermost
parentheses, and only where nothing that a type argument cannot hold stands between
them; the parentheses of an annotation do not count as that. There is no limit to
the depth, and no loop over tokens: a bracket and its partner are neighbours once
brackets are ordered by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.functions.nesting import INTEGERS, lists, rows

# Codes of tokens. SPACE is white space or a comment, the last four are pieces of text
# that matter behind a closing bracket.
OTHER, OPEN, CLOSE, LESS, MORE, LEFT, RIGHT, END, BARRED, ANNOTATION, SPACE = range(11)
MEMBER_NAME, MEMBER_DOT, NAME, THROWS = range(11, 15)
# What is told of a token: 1 to 5 an opening parenthesis, by whether it lies inside another
# (3 to 5) and whether a member call (1, 4) or a body (2, 5) follows its partner; the rest
# are brackets inside others.
INNER_CLOSE, INNER_LESS, INNER_MORE = 6, 7, 8


def _fill(group: list[np.ndarray], at: np.ndarray, opener: np.ndarray) -> np.ndarray:
    """For each token the number of the stretch it is in.

    ``group`` are the keys of tokens at one level; an ``opener`` there begins a
    new stretch for the tokens after it.
    """
    order = np.lexsort((at, *group))
    new = opener[order].copy()
    for key in group:
        new[1:] |= np.diff(key[order]) != 0
    stretch = np.empty(len(at), dtype=np.int64)
    stretch[order] = np.cumsum(new)
    return stretch


def _inside(outer: np.ndarray, level: np.ndarray, at: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The innermost bracket of each token as a number: tokens with equal ones share it.

    ``level`` counts the brackets around a token, ``opens`` marks those that open one.
    """
    n = len(at)
    inner = np.flatnonzero(opens)
    groups = [np.concatenate([level, level[inner] + 1]), np.concatenate([outer, outer[inner]])]
    begins = np.concatenate([np.zeros(n, dtype=bool), np.ones(len(inner), dtype=bool)])
    return _fill(groups, np.concatenate([at, at[inner]]), begins)[:n]


def pair(group: np.ndarray, at: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Partner (a place in the arrays, -1 for none) of each +1 and -1 within its group."""
    order = np.lexsort((at, group))
    level = np.empty(len(at), dtype=np.int64)
    level[order] = np.cumsum(step[order])
    level += step < 0
    order = np.lexsort((at, level, group))
    here, after = order[:-1], order[1:]
    paired = (step[here] > 0) & (step[after] < 0) & (level[here] == level[after]) & (group[here] == group[after])
    partner = np.full(len(at), -1, dtype=np.int64)
    partner[here[paired]], partner[after[paired]] = after[paired], here[paired]
    return partner


def _covered(group: np.ndarray, at: np.ndarray, partner: np.ndarray, step: np.ndarray) -> np.ndarray:
    """How many pairs of its group lie around each token."""
    order = np.lexsort((at, group))
    change = np.where(partner >= 0, step, 0)
    around = np.empty(len(at), dtype=np.int64)
    around[order] = np.cumsum(change[order])
    return around - (change > 0)


def _next(wanted: np.ndarray) -> np.ndarray:
    """The first place at or after each one where ``wanted`` holds (its length if none)."""
    place = np.where(wanted, np.arange(len(wanted)), len(wanted))
    return np.append(np.minimum.accumulate(place[::-1])[::-1], len(wanted))


def marks(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """What is told of each token; ``row`` (ascending) is the text it belongs to."""
    out = np.zeros(len(code), dtype=np.int32)
    at = np.flatnonzero((code >= OPEN) & (code <= BARRED))
    if not len(at):
        return out
    kind, of = code[at], row[at]
    braces = np.where(kind == LEFT, 1, np.where(kind == RIGHT, -1, 0))
    depth = np.cumsum(braces) - (kind == LEFT)
    block = _inside(of, depth, at, kind == LEFT)

    # Parentheses, and those inside others or anywhere inside an annotation.
    is_round = np.flatnonzero((kind == OPEN) | (kind == CLOSE))
    step = np.where(kind[is_round] == OPEN, 1, -1)
    partner = pair(block[is_round], at[is_round], step)
    around = _covered(block[is_round], at[is_round], partner, step)
    annotation = (step > 0) & (partner >= 0) & (code[np.maximum(at[is_round] - 1, 0)] == ANNOTATION) & (at[is_round] > 0)
    closes = partner[annotation]
    noted = annotation.astype(np.int64)
    noted[closes] = -1
    within = np.cumsum(noted) - (noted > 0)
    inner = (partner >= 0) & ((around > 0) | (within > 0))

    # Angle brackets: in the same parentheses, with nothing barred in between.
    paired = np.zeros(len(at), dtype=np.int64)
    paired[is_round] = np.where(partner >= 0, step, 0)
    order = np.lexsort((at, block))
    level = np.empty(len(at), dtype=np.int64)
    level[order] = np.cumsum(paired[order])
    level -= paired > 0
    place = _inside(block, level, at, paired > 0)
    clear = (kind == LESS) | (kind == MORE)
    clear[is_round[noted != 0]] = True
    segment = _fill([place], at, ~clear)
    is_angle = np.flatnonzero((kind == LESS) | (kind == MORE))
    turn = np.where(kind[is_angle] == LESS, 1, -1)
    mate = pair(segment[is_angle], at[is_angle], turn)
    nested = (mate >= 0) & (_covered(segment[is_angle], at[is_angle], mate, turn) > 0)
    out[at[is_angle[nested]]] = np.where(turn[nested] > 0, INNER_LESS, INNER_MORE)
    end_of = np.full(len(code) + 1, len(code), dtype=np.int64)
    closed = mate >= 0
    end_of[at[is_angle[closed]]] = at[is_angle[mate[closed]]]

    # What follows the partner of each opening parenthesis.
    opened = np.flatnonzero((step > 0) & (partner >= 0))
    last = at[is_round[partner[opened]]]
    padded = np.concatenate([code, np.full(4, OTHER)])
    own = np.concatenate([row, np.full(4, -1)])
    after = lambda where, n: np.where(own[np.minimum(where + n, len(code))] == row[last], padded[np.minimum(where + n, len(code))], OTHER)
    angle_end = end_of[np.minimum(last + 2, len(code))]
    generic = (after(last, 1) == MEMBER_DOT) & (after(last, 2) == LESS) & (angle_end < len(code))
    member = (after(last, 1) == MEMBER_NAME) & (after(last, 2) == OPEN)
    member |= generic & (after(angle_end, 1) == NAME) & (after(angle_end, 2) == OPEN)
    word = _next(code != SPACE)[last + 1]
    stop = _next((code == LEFT) | (code == RIGHT) | (code == END))[np.minimum(word, len(code))]
    body = (after(word, 0) == LEFT) | ((after(word, 0) == THROWS) & (after(stop, 0) == LEFT))
    out[at[is_round[opened]]] = 3 * inner[opened] + np.where(body, 2, np.where(member, 1, 0))
    shut = inner & (step < 0)
    out[at[is_round[shut]]] = INNER_CLOSE
    return out


@F.arrow_udf(INTEGERS)
def bracket_marks(codes: pa.Array) -> pa.Array:
    """:func:`marks` for the tokens of each row."""
    values, offsets = rows(codes)
    low, high = offsets[0], offsets[-1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(len(values), dtype=np.int32)
    out[low:high] = marks(values[low:high].astype(np.int64), row)
    return lists(out, offsets)


# Spark must keep the result as a column: merged into an expression over arrays it would
# not be evaluated at all. It does not merge what it takes for changeable.
bracket_marks = bracket_marks.asNondeterministic()
