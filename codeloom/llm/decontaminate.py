"""Benchmark passages in documents, also if slightly edited.

The CGK walk reads a string with random steps: at step ``t`` it notes the
current character ``c`` and moves on if the random bit of ``(t, c)`` says so.
Strings at a small edit distance then agree in most notes, so edit distance
becomes Hamming distance, which sampling of positions turns into equal keys.

Windows of an item's length begin at every word of a document, and at every
word of an item a key says how the item goes on from there: the samples are
drawn from the first ``STEPS`` steps of the walk, so one walk serves items of
all lengths, and an item has as many chances to be met as it has words, in
each of ``REPEATS`` independent walks. An equal key proposes a place for the
item; the edit distance of the whole item to that place decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_texts, whole_texts

STEPS, SAMPLES, REPEATS = 40, 20, 2
BLOCK_BYTES = 8_000_000  # of items that travel to the tasks at a time
STARTS = 200_000  # windows walked at a time
_SEED = 20
LEAKS = "doc_id long, item_id long, first int, last int, edits int"
_PAD = 4 * STEPS
_NOT_WORD = re.compile(r"[\W_]+")
_SHORTEST = 32  # normalised bytes; shorter items are only looked for word by word


def _is_break() -> np.ndarray:
    letters = np.zeros(256, dtype=bool)
    letters[128:] = True
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        letters[a:b] = True
    return ~letters


_BREAK = _is_break()


def lowered(text: str) -> str:
    """Lower case of the same number of code points."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def normal_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ASCII non-word bytes as one blank; also which bytes stay (0 is kept)."""
    gap = _BREAK[data] & (data != 0)
    out = np.where(gap, np.uint8(0x20), data)
    stays = np.ones(len(out), dtype=bool)
    stays[1:] = ~(gap[1:] & gap[:-1])
    return out[stays], stays


class Walks:
    """The random bits and the sampled steps, equal in every task."""

    def __init__(self, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (REPEATS, STEPS, 256)).astype(np.int32)
        self.sampled = [
            np.isin(np.arange(STEPS), rng.choice(STEPS, SAMPLES, replace=False))
            for _ in range(REPEATS)
        ]
        self.notes = rng.integers(1, 1 << 63, (REPEATS, 256), dtype=np.uint64) | np.uint64(1)

    def keys(self, data: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
        """Key of the window at each start; ``data`` is padded by ``_PAD`` bytes."""
        at = starts.astype(np.int32)
        key = np.zeros(len(at), dtype=np.uint64)
        factor = np.uint64(0x9E3779B97F4A7C15)
        for step in range(STEPS):
            seen = data[at]
            if self.sampled[repeat][step]:
                key *= factor
                key += self.notes[repeat][seen]
            at += self.moves[repeat][step][seen]
        return key ^ (key >> np.uint64(29))


def _starts(data: np.ndarray) -> np.ndarray:
    """Positions of words."""
    word = (data != 0x20) & (data != 0)
    first = word.copy()
    first[1:] &= ~word[:-1]
    return np.flatnonzero(first)


class Items:
    """Keys of all items, and the exact test."""

    def __init__(self, items: Iterable[tuple[int, str]], share: float):
        self.share, self.walks = share, Walks()
        self.ids: list[int] = []
        self.texts: list[str] = []
        self.short: dict[str, list[int]] = {}
        keys: list[list] = [[] for _ in range(REPEATS)]
        for item_id, text in items:
            low = lowered(text)
            data, _ = normal_bytes(np.frombuffer(low.encode(), dtype=np.uint8))
            plain = bytes(data).decode().strip()
            if not plain:
                continue
            if len(plain.encode()) < _SHORTEST:
                self.short.setdefault(plain, []).append(item_id)
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            self.texts.append(plain)
            data = np.frombuffer(plain.encode() + bytes(_PAD), dtype=np.uint8)
            starts = _starts(data[:-_PAD])
            starts = starts[(starts == 0) | (starts <= len(data) - _PAD - _SHORTEST)]
            for repeat in range(REPEATS):
                for key, start in zip(self.walks.keys(data, starts, repeat), starts, strict=True):
                    keys[repeat].append((key, number, start))
        self.tables = []
        for rows in keys:
            table = np.array(rows, dtype=[("key", "u8"), ("item", "i4"), ("start", "i4")])
            table.sort(order=["key", "item", "start"])
            filter_ = np.zeros(1 << 20, dtype=bool)
            filter_[(table["key"] >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((table, filter_))

    def proposals(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(place, item) pairs: where an item would begin in normalised bytes."""
        found = set()
        starts = _starts(data[:-_PAD])
        for low in range(0, len(starts), STARTS):
            some = starts[low : low + STARTS]
            for repeat, (table, filter_) in enumerate(self.tables):
                keys = self.walks.keys(data, some, repeat)
                hits = np.flatnonzero(filter_[(keys >> np.uint64(44)).astype(np.int64)])
                left = np.searchsorted(table["key"], keys[hits], "left")
                right = np.searchsorted(table["key"], keys[hits], "right")
                for hit in np.flatnonzero(right > left):
                    for row in table[left[hit] : right[hit]]:
                        found.add((int(some[hits[hit]]) - int(row["start"]), int(row["item"])))
        return sorted(found)


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and that part's end.

    Bit-parallel columns: bit ``i`` of ``plus``/``minus`` says that the distance
    grows/falls from row ``i`` to the next one.
    """
    m = len(pattern)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        equal = places.get(c, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(diagonal | plus) & every
        down = plus & diagonal
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up, down = up << 1 & every, down << 1 & every
        plus = down | ~(diagonal | up) & every
        minus = up & diagonal
        if distance < best:
            best, end = distance, j
    return best, end


def _part(data: bytes, first: int, last: int) -> tuple[str, int]:
    """Whole characters of ``data[first:last]`` and where they begin."""
    first, last = max(first, 0), min(last, len(data))
    while first < last and data[first] & 0xC0 == 0x80:
        first += 1
    while last < len(data) and data[last] & 0xC0 == 0x80:
        last += 1
    return data[first:last].decode(), first


def _verified(items: Items, number: int, data: bytes, place: int) -> tuple[int, int, int] | None:
    """(first, last, edits) in bytes of the item near ``place``, if it is there."""
    pattern = items.texts[number]
    allowed = int(items.share * len(pattern))
    size = len(pattern.encode())
    slack = 2 * allowed + 4
    text, begin = _part(data, place - slack, place + size + slack)
    exact = text.find(pattern)
    if exact >= 0:
        first, last, edits = exact, exact + len(pattern), 0
    else:
        edits, last = best_end(pattern, text)
        if edits > allowed:
            return None
        _, back = best_end(pattern[::-1], text[:last][::-1])
        first = last - back
    return (
        begin + len(text[:first].encode()),
        begin + len(text[:last].encode()),
        edits,
    )


def _kernel(items: Items):
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch[0].to_pylist()
        lows = [lowered(text.as_py()).encode().replace(b"\0", b" ") for text in batch[1]]
        gap = bytes(_PAD)
        joined = np.frombuffer(gap.join([*lows, b""]) or gap, dtype=np.uint8)
        data, stays = normal_bytes(joined)
        raw = np.cumsum([0] + [len(low) + _PAD for low in lows])
        kept = np.concatenate([[0], np.cumsum(stays, dtype=np.int64)])
        edges = kept[raw]
        rows: list[tuple] = []
        met: dict[tuple[int, int], int] = {}
        pieces: dict[int, bytes] = {}

        def add(doc: int, item_id: int, first: int, last: int, edits: int) -> None:
            own = stays[raw[doc] : raw[doc + 1] - _PAD]
            back = np.flatnonzero(own)
            low = lows[doc]
            at = len(low[: back[first]].decode(errors="ignore"))
            end = len(low[: back[last - 1] + 1].decode(errors="ignore"))
            rows.append((ids[doc], item_id, at, end, edits))

        for place, number in items.proposals(data) if len(data) > _PAD else ():
            doc = max(int(np.searchsorted(edges, place, "right")) - 1, 0)
            if place < 0 or data[place] == 0:  # before its document's first word
                doc = int(np.searchsorted(edges, place + len(items.texts[number]), "right")) - 1
            if place < met.get((doc, number), -1):
                continue
            if doc not in pieces:
                pieces[doc] = bytes(data[edges[doc] : edges[doc + 1] - _PAD])
            base = int(edges[doc])
            found = _verified(items, number, pieces[doc], place - base)
            if found:
                add(doc, items.ids[number], *found)
                met[doc, number] = base + found[1]
        if items.short:
            for doc, low in enumerate(lows):
                own = data[edges[doc] : edges[doc + 1] - _PAD]
                text = b" " + bytes(own) + b" "
                for plain, item_ids in items.short.items():
                    at = text.find(f" {plain} ".encode())
                    while at >= 0:
                        for item_id in item_ids:
                            add(doc, item_id, at, at + len(plain.encode()), 0)
                        at = text.find(f" {plain} ".encode(), at + 1)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [c.split()[0] for c in LEAKS.split(", ")],
        )

    return scan


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """``doc_id, item_id, first, last, edits``: code points of each place of an item.

    An item is there if its normalised text (lower case, runs of ASCII
    punctuation and white space as one blank) is within ``share`` of its length
    in edits. Items go to the tasks in blocks of a bounded size; every block
    reads all documents. Null and empty texts, of items or documents, match
    nothing; an item below 32 bytes is looked for word by word; equal items are
    reported each; repeated rows and null ids are kept.
    """
    items = benchmark.select(
        benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")
    ).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    texts, found = whole_texts(docs), None
    for number in range(blocks):
        rows = items.filter(block == number).orderBy("item_id", "text").collect()
        if not rows:
            continue
        part = map_texts(texts, _lazy(rows, share), LEAKS)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], LEAKS) if found is None else found


_BUILT: dict[int, tuple] = {}


def _lazy(rows: list, share: float):
    """A kernel that builds its keys once in each task's worker."""
    plain = [(row["item_id"], row["text"]) for row in rows]

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        mark = hash((share, *plain))
        if mark not in _BUILT:
            _BUILT.clear()
            _BUILT[mark] = _kernel(Items(plain, share))
        return _BUILT[mark](batch)

    return scan
