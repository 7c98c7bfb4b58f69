"""Secrets in texts: fixed patterns, and strings that look drawn at random.

A candidate is a long run of key characters with letters and digits. Its
encoding (hex, base32, base64, ...) gives the alphabet under which three tests
ask whether the characters could be drawn evenly and independently: chi-squared
over the alphabet, runs above and below its middle, and serial correlation of
neighbours. Keys pass such tests with evenly spread p-values, other strings
fail them, but short ones often by too little. So the p-values of all distinct
candidates are counted per length class; what exceeds the even share of true
keys above a threshold is the false share there, and each class takes the
lowest threshold at which that share is at most ``rate``.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_texts, stage, whole_texts

# The base patterns and the characters their matches must have.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

CANDIDATE_LENGTH = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{CANDIDATE_LENGTH},}}")
_ALPHABETS = [
    "0123456789abcdef",
    "0123456789ABCDEF",
    string.ascii_uppercase + "234567",
    string.digits + string.ascii_lowercase,
    string.digits + string.ascii_uppercase,
    string.digits + string.ascii_letters,
    string.digits + string.ascii_letters + "+/",
    string.digits + string.ascii_letters + "-_",
]
_INDEX = [({c: i for i, c in enumerate(a)}, len(a)) for a in _ALPHABETS]
# Lengths up to each bound form a class; longer ones are the last class.
LENGTH_CLASSES = (24, 32, 40, 48, 64, 96)
BINS = 20

_SPAN = pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_RANDOM = pa.struct(
    [
        ("at", pa.int32()),
        ("end", pa.int32()),
        ("length_class", pa.int32()),
        ("bin", pa.int32()),
        ("digest", pa.binary()),
    ]
)
FOUND = (
    "doc_id long, base array<struct<at:int, kind:int, end:int>>, "
    "candidates array<struct<at:int, end:int, length_class:int, bin:int, digest:binary>>"
)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def randomness(text: str) -> float:
    """One p-value for "evenly and independently drawn from the inferred alphabet"."""
    for index, size in _INDEX:  # smallest first
        if all(c in index for c in set(text)):
            break
    else:
        index, size = {c: i for i, c in enumerate(sorted(set(text)))}, 66
    n = len(text)
    values = np.fromiter(map(index.__getitem__, text), dtype=np.float64, count=n)
    counts = np.bincount(values.astype(np.int64), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    uneven = (chi - (size - 1)) / math.sqrt(2.0 * (size - 1) * (n - 1) / n)

    high = values >= size / 2
    above = int(high.sum())
    below = n - above
    mean = 2.0 * above * below / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    gap = abs(runs - mean) / math.sqrt(spread) if spread > 0 else math.sqrt(n)

    centred = values - values.mean()
    power = float((centred**2).sum())
    drift = abs(float((centred[1:] * centred[:-1]).sum())) / power * math.sqrt(n) if power else n
    tests = (_upper_tail(uneven), 2 * _upper_tail(gap), 2 * _upper_tail(drift))
    return min(1.0, len(tests) * min(tests))  # valid however the tests depend


def _base(text: str) -> list[tuple[int, int, int]]:
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= ACCESS_LENGTH:
                found.append((m.start(), 1, m.end()))
    return found


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    bases, candidates = [], []
    for value in batch[1]:
        text = value.as_py()
        base, runs = _base(text), _CANDIDATE.findall(text)
        # A hex run of 32 characters lies in a candidate run of that length.
        if any(len(run) >= HEX_LENGTH for run in runs):
            base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        random = []
        for m in _CANDIDATE.finditer(text) if runs else ():
            run, at, end = m[0], m.start(), m.end()
            digits = sum(c in string.digits for c in run)
            if not digits or digits == len(run):
                continue
            if any(at < e and b < end for b, _, e in base):
                continue
            length_class = sum(len(run) > bound for bound in LENGTH_CLASSES)
            bin_ = min(BINS - 1, int(randomness(run) * BINS))
            random.append((at, end, length_class, bin_, xxhash.xxh3_128_digest(run)))
        bases.append([dict(zip(("at", "kind", "end"), b, strict=True)) for b in sorted(base)])
        names = ("at", "end", "length_class", "bin", "digest")
        candidates.append([dict(zip(names, c, strict=True)) for c in random])
    return pa.RecordBatch.from_arrays(
        [batch[0], pa.array(bases, pa.list_(_SPAN)), pa.array(candidates, pa.list_(_RANDOM))],
        ["doc_id", "base", "candidates"],
    )


def thresholds(histogram: list[tuple[int, int, int]], rate: float) -> list[int]:
    """Lowest bin each length class accepts, from rows (class, bin, count).

    True keys spread evenly over the bins, so their number is what the upper
    half holds, times two. If a class has no candidate there, none is accepted.
    """
    counts = np.zeros((len(LENGTH_CLASSES) + 1, BINS))
    for length_class, bin_, count in histogram:
        counts[length_class, bin_] += count
    lowest = []
    for row in counts:
        even = row[BINS // 2 :].sum() / (BINS // 2)
        accepted = BINS
        for bin_ in range(BINS - 1, -1, -1):
            taken = row[bin_:].sum()
            if taken and (taken - min(taken, even * (BINS - bin_))) / taken <= rate:
                accepted = bin_
        lowest.append(accepted)
    return lowest


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["at"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """``doc_id, base, spans``: arrays of (at, kind, end) in code points, by ``at``, then kind.

    ``kind`` is an index into ``KINDS``; ``end`` is exclusive. A null or empty
    text has no spans. Every row is scanned by itself; repeated rows and null
    ids are kept, but in the counts of p-values a string weighs once, however
    often it occurs. An empty table gives no rows.
    """
    found = stage(map_texts(whole_texts(docs), _scan, FOUND), "secrets")
    strings = found.select(F.inline("candidates")).select("length_class", "bin", "digest").distinct()
    counted = strings.groupBy("length_class", "bin").count().collect()  # a row per class and bin
    lowest = thresholds([tuple(row) for row in counted], rate)
    limits = F.array(*map(F.lit, lowest))
    accepted = F.filter("candidates", lambda c: c["bin"] >= F.get(limits, c["length_class"]))
    random = F.transform(
        accepted,
        lambda c: F.struct(
            c["at"].alias("at"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")
        ),
    )
    return found.select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of base spans per kind, their digest, and all spans as text."""

    def count(kind: str) -> Column:
        code = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == code)).cast("long")

    return find_secrets(docs).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    parts, last = [], 0
    for at, end in sorted(spans):
        if at >= last:
            parts += [text[last:at], mark]
        last = max(last, end)
    return "".join([*parts, text[last:]])
