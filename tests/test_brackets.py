"""Bracket marks against a stack machine."""

from __future__ import annotations

import random

import numpy as np
import pytest

from codeloom.functions import brackets as B


def by_stacks(code):
    """The marks of one text, told by stacks and comparisons of intervals."""
    n = len(code)
    stack, strays, block = [], 0, []
    for i, c in enumerate(code):
        if c == B.RIGHT:
            if stack:
                stack.pop()
            else:
                strays += 1
        block.append((strays, tuple(stack)))
        if c == B.LEFT:
            stack.append(i)

    def pairs(places, opening):
        open_, found = [], {}
        for i in places:
            if code[i] == opening:
                open_.append(i)
            elif open_:
                found[open_.pop()] = i
        return found

    by_block = {}
    for i, c in enumerate(code):
        if c in (B.OPEN, B.CLOSE):
            by_block.setdefault(block[i], []).append(i)
    round_ = {a: b for places in by_block.values() for a, b in pairs(places, B.OPEN).items()}
    noted = {a: b for a, b in round_.items() if a and code[a - 1] == B.ANNOTATION}
    quiet = {*noted, *noted.values()}

    def place(i):
        around = [a for a, b in round_.items() if a < i < b and block[a] == block[i]]
        return block[i], max(around, default=None)

    by_place, angles, nested = {}, {}, set()
    for i, c in enumerate(code):
        if B.OPEN <= c <= B.BARRED:
            segments = by_place.setdefault(place(i), [[]])
            if c in (B.LESS, B.MORE):
                segments[-1].append(i)
            elif i not in quiet:
                segments.append([])
    for segments in by_place.values():
        for segment in segments:
            found = pairs(segment, B.LESS)
            angles |= found
            nested |= {x for a, b in found.items() for x in (a, b) if any(c < a and b < d for c, d in found.items())}

    def get(i):
        return code[i] if i < n else B.OTHER

    out = [0] * n
    for i in nested:
        out[i] = B.INNER_LESS if code[i] == B.LESS else B.INNER_MORE
    for a, b in round_.items():
        inner = any(x < a and b < y for x, y in noted.items())
        inner |= any(x < a and b < y and block[x] == block[a] for x, y in round_.items())
        member = get(b + 1) == B.MEMBER_NAME and get(b + 2) == B.OPEN
        if get(b + 1) == B.MEMBER_DOT and b + 2 in angles:
            end = angles[b + 2]
            member |= get(end + 1) == B.NAME and get(end + 2) == B.OPEN
        k = b + 1
        while get(k) == B.SPACE:
            k += 1
        body = get(k) == B.LEFT
        if get(k) == B.THROWS:
            while k < n and code[k] not in (B.LEFT, B.RIGHT, B.END):
                k += 1
            body = get(k) == B.LEFT
        out[a] = 3 * inner + (2 if body else 1 if member else 0)
        if inner:
            out[b] = B.INNER_CLOSE
    return out


@pytest.mark.parametrize("seed", range(6))
def test_marks_equal_a_stack_machine(seed):
    rng = random.Random(seed)
    kinds = [1, 1, 2, 2, 3, 3, 4, 4, *range(15)]
    for _ in range(100):
        texts = [[rng.choice(kinds) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 4))]
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        got = B.marks(np.array([c for t in texts for c in t], dtype=np.int64), row)
        assert got.tolist() == [m for t in texts for m in by_stacks(t)]


def test_depth_has_no_limit():
    n = 3000
    code = np.array([B.OPEN] * n + [B.CLOSE] * n + [B.LESS] * n + [B.MORE] * n)
    told = B.marks(code, np.zeros(len(code), dtype=np.int64))
    assert (told[[0, 2 * n - 1, 2 * n, 4 * n - 1]] == 0).all()
    assert (told[1:n] == 3).all() and (told[n : 2 * n - 1] == B.INNER_CLOSE).all()
    assert (told[2 * n + 1 : 3 * n] == B.INNER_LESS).all() and (told[3 * n : 4 * n - 1] == B.INNER_MORE).all()
