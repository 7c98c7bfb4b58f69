"""Which tokens of two tokenizers cover the same bytes, and how often they meet.

Both tokenizers spell a text as consecutive byte ranges, so the ends of A's and of
B's tokens are two sorted lists and merging them visits every overlap once: a token
pair overlaps exactly between two neighbouring ends. The merge is cut by diagonals
into pieces of equal work; a binary search on each diagonal tells how many ends of
either list come before it, so each piece is merged by itself, wherever documents
begin. An end both lists have closes a group; groups that run across pieces follow
from the closings before and after.

Counts of id pairs over the whole corpus are summed in Spark and stored as sorted
arrays. Their number is bounded by the product of the vocabularies, not by the
corpus, and a task maps the pages it needs.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stage, whole_texts
from codeloom.llm.encoder import byte_letters, encoder
from codeloom.llm.shared_arrays import SortedArrays, save_array

SLICE = 2_000_000  # characters of text aligned at a time
PIECE = 1 << 16  # ends merged at a time
PAIRS_PER_SHARD = 2_000_000
SPACE_PIECE = "▁"
_U = np.uint64


class Spelling:
    """Ids of a text and the bytes each of them stands for."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.ids = lambda text: np.array(model.encode(text, num_threads=1), dtype=np.uint32)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            spelt = [
                bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE_PIECE, " ").encode()
                for i, p in enumerate(pieces)
            ]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)
            plain.no_truncation()
            plain.no_padding()
            plain.encode_special_tokens = True
            with open(path, encoding="utf-8") as file:
                special = [t["content"] for t in json.load(file).get("added_tokens", [])]
            usual = encoder(path)

            def ids(text: str) -> np.ndarray:
                text = " " + text
                if any(s in text for s in special):  # plain text here
                    return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                return np.frombuffer(usual.encode(text), dtype="<u4")

            self.ids = ids
            code = {letter: byte for byte, letter in byte_letters().items()}
            entries = sorted((i, t) for t, i in plain.get_vocab(with_added_tokens=True).items())
            spelt = [b""] * (entries[-1][0] + 1)
            for i, entry in entries:
                spelt[i] = bytes(map(code.__getitem__, entry)) if all(c in code for c in entry) else entry.encode()
        self.size = len(spelt)
        self.lengths = np.array([len(s) for s in spelt], dtype=np.int64)
        self._begins = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        # Decimal digits of every id, and room for what follows it.
        width = len(str(self.size)) + 1
        self.digits = np.zeros((self.size, width), dtype=np.uint8)
        self.shown = np.zeros(self.size, dtype=np.int64)
        for i in range(self.size):
            text = str(i).encode()
            self.digits[i, : len(text)] = list(text)
            self.shown[i] = len(text)

    def spells(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """For each byte of ``data``, whether the tokens' bytes have the same there."""
        same = np.empty(len(data), dtype=bool)
        low = 0
        while low < len(ids):
            high = min(low + PIECE, len(ids))
            lengths = self.lengths[ids[low:high]]
            first = ends[low] - lengths[0]
            shift = self._begins[ids[low:high]] - (ends[low:high] - lengths)
            at = np.arange(first, ends[high - 1]) + np.repeat(shift, lengths)
            same[first : ends[high - 1]] = self._bytes[at] == data[first : ends[high - 1]]
            low = high
        return same


_LOADED: dict[str, Spelling] = {}


def spelling(path: str) -> Spelling:
    """One for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Spelling(path)
    return _LOADED[path]


def split_merge(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first ``d`` of the merge, for each diagonal ``d``.

    Of equal ends that of ``a`` comes first.
    """
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        # a[middle] comes before b[d - 1 - middle]: the split lies further on.
        ahead = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - 1 - middle, 0, len(b) - 1)]
        ahead &= low < high
        low, high = np.where(ahead, middle + 1, low), np.where(ahead | (low >= high), high, middle)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """All overlaps of the token ranges that end at ``a`` and ``b``, from independent pieces.

    Gives, for each token of A, the token of B in which it ends; the tokens of B
    that end inside one of A, with it; and the tokens of A and of B that close a
    group. Both lists end in the same number.
    """
    total = len(a) + len(b)
    diagonals = np.arange(0, total + piece, piece).clip(max=total)
    ia = split_merge(a, b, diagonals)
    ib = diagonals - ia
    under, inner, inner_a, close_a, close_b = [], [], [], [], []
    for a0, a1, b0, b1 in zip(ia, ia[1:], ib, ib[1:], strict=False):
        mine, other = a[a0:a1], b[b0:b1]
        under.append(b0 + np.searchsorted(other, mine))
        at = a0 + np.searchsorted(mine, other)  # ends of A before each of B
        closes = a[np.minimum(at, len(a) - 1)] == other
        if a0 and len(other):  # its equal may be the last of the piece before
            stitched = other == a[a0 - 1]
            at, closes = at - stitched, closes | stitched
        here = np.arange(b0, b1)
        inner.append(here[~closes])
        inner_a.append(at[~closes])
        close_a.append(at[closes])
        close_b.append(here[closes])
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in (under, inner, inner_a, close_a, close_b))


def group_text(a: Spelling, b: Spelling, ids_a, ids_b, close_a, close_b):
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and the length each token of the merged order takes.

    The order is by group, and A's tokens before B's in each; its second array
    holds the lengths in that order.
    """
    group_a = np.searchsorted(close_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(close_b, np.arange(len(ids_b)))
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], close_b + 1])[group_a]
    place_b = np.arange(len(ids_b)) + close_a[group_b] + 1
    n = len(ids_a) + len(ids_b)
    ids, mark = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    mark[place_a[close_a]], mark[place_b[close_b]] = ord("|"), ord(";")
    larger = a if a.size >= b.size else b  # digits are the same in both
    lengths = larger.shown[ids] + 1
    parts = []
    for low in range(0, n, PIECE):
        own = ids[low : low + PIECE]
        cells, shown = larger.digits[own], larger.shown[own]
        cells[np.arange(len(own)), shown] = mark[low : low + PIECE]
        parts.append(cells[np.arange(cells.shape[1]) <= shown[:, None]].tobytes())
    return b"".join(parts), lengths


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _code_type(a: Spelling, b: Spelling) -> str:
    return "<u4" if a.size * b.size <= 1 << 32 else "<u8"


def _align(texts: list[str], a: Spelling, b: Spelling) -> list[tuple]:
    """What ``ALIGNED`` holds after ``doc_id``, for each text."""
    found: list[tuple] = [(0, 0, 0, 0, "", b"")] * len(texts)
    which, held_a, held_b, raw = [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        data, ids_a, ids_b = (" " + text).encode(), a.ids(text), b.ids(text)
        if a.lengths[ids_a].sum() == len(data) == b.lengths[ids_b].sum():
            which.append(i)
            held_a.append(ids_a)
            held_b.append(ids_b)
            raw.append(data)
    if not which:
        return found
    bounds = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    same = np.ones(len(which), dtype=bool)
    for one, held in ((a, held_a), (b, held_b)):
        ids = np.concatenate(held)
        same &= np.logical_and.reduceat(one.spells(ids, np.cumsum(one.lengths[ids]), data), bounds[:-1])
    if not same.all():
        keep = np.flatnonzero(same).tolist()
        which, held_a, held_b = ([column[k] for k in keep] for column in (which, held_a, held_b))
        if not keep:
            return found
    ids_a, ids_b = np.concatenate(held_a), np.concatenate(held_b)
    under, inner, inner_a, close_a, close_b = overlaps(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
    kind = _code_type(a, b)
    pair = lambda x, y: (x.astype(_U) * _U(b.size) + y.astype(_U)).astype(kind)
    at_ends, inside = pair(ids_a, ids_b[under]), pair(ids_a[inner_a], ids_b[inner])
    text, lengths = group_text(a, b, ids_a, ids_b, close_a, close_b)
    to_a, to_b = (np.cumsum([0, *map(len, held)]) for held in (held_a, held_b))
    to_text = np.concatenate([[0], np.cumsum(lengths)])[to_a + to_b]
    to_inner, to_close = np.searchsorted(inner, to_b), np.searchsorted(close_b, to_b)
    for k, i in enumerate(which):
        links = at_ends[to_a[k] : to_a[k + 1]].tobytes() + inside[to_inner[k] : to_inner[k + 1]].tobytes()
        digest = hashlib.sha256(memoryview(text)[to_text[k] : to_text[k + 1] - 1]).hexdigest()
        n_a, n_b, groups = (int(c[k + 1] - c[k]) for c in (to_a, to_b, to_close))
        found[i] = (n_a, n_b, groups, n_a + n_b - groups, digest, links)
    return found


def _by_size(batches: Iterator[pa.RecordBatch], sizes, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` (or one row) by the sizes of their rows."""
    for batch in batches:
        ends = np.cumsum(sizes(batch))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high


def _widths(column: pa.Array) -> np.ndarray:
    kind = column.cast(pa.large_binary())
    return np.diff(np.frombuffer(kind.buffers()[1], dtype=np.int64)[kind.offset : kind.offset + len(kind) + 1])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``ALIGNED`` of each row: token, group and link counts, and the linked id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = spelling(a_path), spelling(b_path)
        for part in _by_size(batches, lambda batch: _widths(batch.column(1)), SLICE):
            columns = list(zip(*_align(part.column(1).to_pylist(), a, b), strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [f.split()[0] for f in ALIGNED.split(", ")])

    return whole_texts(docs).mapInArrow(run, ALIGNED)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits, so that shards are even."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``key, b, n``: how many links hold each id pair; ``key`` is the pair's scrambled number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = spelling(a_path), spelling(b_path)
        kind = _code_type(a, b)
        for part in _by_size(batches, lambda batch: _widths(batch.column(0)), 8 * SLICE):
            codes = np.concatenate([np.frombuffer(x, kind) for x in part.column(0).to_pylist()])
            pairs, n = np.unique(codes, return_counts=True)
            pairs = pairs.astype(_U)
            columns = [_mix(pairs).view(np.int64), (pairs % _U(b.size)).astype(np.int32), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "b", "n"])

    found = aligned.select("links").mapInArrow(run, "key long, b int, n long")
    return found.groupBy("key", "b").agg(F.sum("n").alias("n"))


FILES = "file string, entries long"


def store_counts(counts: DataFrame, folder: str) -> tuple[list[str], int]:
    """Write ``counts(key, n, best)`` as sorted arrays; their files and the key bits that choose one."""
    bits = max(0, (counts.count() // PAIRS_PER_SHARD).bit_length())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        keys = held["key"].to_numpy().view(_U)
        order = np.argsort(keys)
        shard = int(keys[0] >> _U(64 - bits)) if bits else 0
        file = f"pairs-{shard:06d}-{uuid.uuid4().hex[:12]}"
        n, best = held["n"].to_numpy().astype(_U), held["best"].to_numpy(zero_copy_only=False)
        for name, values in (("key", keys), ("n", n), ("best", best.astype(np.uint8))):
            save_array(folder, f"{file}.{name}", values[order])
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(keys)])], ["file", "entries"])

    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    one_each = counts.select("key", "n", "best").repartitionById(1 << bits, shard)
    written = stage(one_each.mapInArrow(write, FILES), "pair-files")
    return [row["file"] for row in written.orderBy("file").collect()], bits  # one row per shard


SUMS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def token_alignment(docs: DataFrame, a_path: str, b_path: str, folder: str) -> DataFrame:
    """``SUMS`` of each row of ``docs``; the counts of id pairs are written into ``folder``.

    A spells a space and the text, B adds that space itself. A null or empty
    text, and one whose bytes either tokenizer does not give back, has no
    tokens: zeros and an empty digest. Repeated rows count each; a row without
    ``doc_id`` is aligned like any other; an empty table gives no rows.
    """
    aligned = stage(align(docs, a_path, b_path), "aligned", compression="zstd")
    counts = stage(pair_counts(aligned, a_path, b_path), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # one row per id of B
    best = (F.col("n") == F.col("highest")).alias("best")
    files, bits = store_counts(counts.join(highest, "b").select("key", "n", best), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SortedArrays.of(folder, files, ["n", "best"], bits)
        kind = _code_type(spelling(a_path), spelling(b_path))
        for part in _by_size(batches, lambda batch: _widths(batch.column(6)), 4 * SLICE):
            held = [np.frombuffer(x, kind) for x in part.column(6).to_pylist()]
            distinct, at = np.unique(np.concatenate(held), return_inverse=True)
            ends = np.cumsum([0, *map(len, held)])
            sums = []
            for values in table.find(_mix(distinct.astype(_U)))[::-1]:
                running = np.concatenate([[0], np.cumsum(values.astype(np.int64)[at])])
                sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], *sums, part.column(5)], [f.split()[0] for f in SUMS.split(", ")]
            )

    return aligned.mapInArrow(run, SUMS)
