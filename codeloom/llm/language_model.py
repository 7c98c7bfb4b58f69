"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Words and word pairs are 64-bit hashes. Counting is two passes: the first
shuffles pair counts by ranges of the hash and writes each range as one sorted
array; the second looks every pair up there and sums, per word, how often and
with how many different neighbours it stands, which become sorted arrays too.
Scoring tasks map these files into memory and search them; a task holds its
own texts and the pages it touches, not the model.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import LOWER, stage
from codeloom.llm.shared_arrays import SortedArrays, save_array

_U = np.uint64
END, START = _U(0x5F3C_A1B2_77D0_E4C9), _U(0xA8D1_3E57_90CB_2F64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BLOCK = 1_000_000
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
PAIRS_PER_SHARD = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``."""
    n = len(data)
    if not _POWERS or len(_POWERS[0]) < n + 1:
        _POWERS[:] = [_powers(_BASE, n + 1), _powers(_INVERSE, n + 1)]
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _POWERS[0][:n], out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * _POWERS[1][starts]
    return mix(hashes + (stops - starts).astype(np.uint64)), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end each) and where each text's begin."""
    found, sizes = [], []
    group: list[bytes] = []

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b" ".join(group), dtype=np.uint8)
        hashes, at = _hashes(data)
        ends = np.cumsum([len(g) + 1 for g in group])
        counts = np.diff(np.searchsorted(at, ends), prepend=0)
        stops = np.cumsum(counts)
        found.append(np.insert(hashes, stops, END))
        sizes.extend((counts + 1).tolist())
        group.clear()

    held = 0
    for text in texts:
        raw = text.translate(LOWER).encode()
        if len(raw) > _BLOCK:
            flush()
            held, parts, low = 0, [], 0
            while low < len(raw):  # cut at white space
                high = min(low + _BLOCK, len(raw))
                while high < len(raw) and not _SPACE[raw[high]]:
                    high += 1
                parts.append(_hashes(np.frombuffer(raw[low:high], dtype=np.uint8))[0])
                low = high
            found.append(np.append(np.concatenate(parts), END))
            sizes.append(len(found[-1]))
            continue
        group.append(raw)
        held += len(raw)
        if held > _BLOCK:
            flush()
            held = 0
    flush()
    starts = np.cumsum([0, *sizes])
    return np.concatenate([np.zeros(0, dtype=np.uint64), *found]), starts


def contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token; ``START`` at the beginning of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = START
    return before


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _U(3) + mix(tokens))


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _text_list(column: pa.Array) -> list[str]:
    return column.to_pylist()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that belong to no word."""

    folder: str
    pair_files: list[str]
    word_files: list[str]
    tokens: int
    words: int
    pairs: int
    texts: int
    bits: int  # of a key, that choose its file
    pair_discounts: list[float]
    word_discounts: list[float]
    word_classes: list[int]  # words with 1, 2, 3 or more different predecessors

    def save(self) -> None:
        files, path = pafs.FileSystem.from_uri(self.folder)
        files.create_dir(path)
        with files.open_output_stream(f"{path}/model.json") as out:
            out.write(json.dumps(asdict(self)).encode())


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Discounts for counts of 1, 2, and 3 or more, from counts of counts.

    Where a small corpus leaves a class empty the ratio is taken as that of the
    geometric case, and each discount stays between 0 and its count.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratios = [(n2, n1), (n3, n2), (n4, n3)]
    return [
        min(max(i - (i + 1) * y * (high / low if low else 0.5), 0.0), float(i))
        for i, (high, low) in enumerate(ratios, 1)
    ]


def _shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _sum_by_key(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else order
    return keys[first], [np.add.reduceat(c[order], first) if len(keys) else c for c in columns]


WORD_ARRAYS = ["count", "one", "two", "more", "before"]
PAIRS = "key long, count long"
SHARDS = "file string, entries long, total long, n1 long, n2 long, n3 long, n4 long, more long"
WORDS = "word long, count long, one double, two double, more double, before double"


def _write_shards(folder: str, label: str, bits: int, names: list[str], class_column: int):
    """Kernel: sums the rows of whole shards, writes each sorted, reports class sizes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        rows = []
        if parts:
            held = pa.Table.from_batches(parts)
            keys = held.column(0).to_numpy().view(np.uint64)
            keys, sums = _sum_by_key(keys, [held.column(i + 1).to_numpy() for i in range(len(names))])
            del held
            shards = _shard(keys, bits)
            edges = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
            for low, high in zip(edges, edges[1:], strict=False):
                attempt = uuid.uuid4().hex[:12]
                file = f"{label}-{shards[low]:06d}-{attempt}"
                save_array(folder, f"{file}.key", keys[low:high])
                for name, values in zip(names, sums, strict=True):
                    whole = np.rint(values[low:high]).astype(np.uint64)
                    small = np.min_scalar_type(int(whole.max()))
                    save_array(folder, f"{file}.{name}", whole.astype(small))
                kind = np.rint(sums[class_column][low:high]).astype(np.int64)
                sizes = np.bincount(np.minimum(kind, 5), minlength=6)
                rows.append((file, high - low, int(np.rint(sums[0][low:high]).sum()), *sizes[1:].tolist()))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.string()] + [pa.int64()] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [c.split()[0] for c in SHARDS.split(", ")],
        )

    return write


def train(texts: DataFrame, folder: str) -> Model:
    """Count ``texts(text)`` and write the model's arrays into ``folder``."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (size // (4 * PAIRS_PER_SHARD)).bit_length())
    shards = 1 << bits

    def shard_of(key: str) -> Column:
        return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1024):
            tokens, starts = word_hashes(_text_list(batch[0]))
            keys, counts = np.unique(pair_keys(contexts(tokens, starts), tokens), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [_signed(keys), pa.array(counts.astype(np.int64))],
                ["key", "count"],
            )

    written = stage(
        texts.mapInArrow(count_pairs, PAIRS)
        .repartition(shards, shard_of("key"))
        .mapInArrow(_write_shards(folder, "pairs", bits, ["count"], 0), SHARDS),
        "pair-files",
    )
    pair_rows = written.orderBy("file").collect()  # one row per shard
    pair_files = [row["file"] for row in pair_rows]
    sums = [sum(row[f"n{i}"] for row in pair_rows) for i in (1, 2, 3, 4)]
    pairs = sum(row["entries"] for row in pair_rows)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SortedArrays.of(folder, pair_files, ["count"], bits)
        for batch in _batches(batches, 1024):
            tokens, starts = word_hashes(_text_list(batch[0]))
            before = contexts(tokens, starts)
            count = table.find(pair_keys(before, tokens))[0].astype(np.float64)
            share = 1.0 / np.maximum(count, 1)
            words, at = np.unique(np.concatenate([tokens, before]), return_inverse=True)
            own, prior = at[: len(tokens)], at[len(tokens) :]

            def total(index: np.ndarray, weights: np.ndarray, n: int = len(words)) -> pa.Array:
                return pa.array(np.bincount(index, weights, n), pa.float64())

            yield pa.RecordBatch.from_arrays(
                [
                    _signed(words),
                    pa.array(np.bincount(own, minlength=len(words)).astype(np.int64)),
                    total(prior, share * (count == 1)),
                    total(prior, share * (count == 2)),
                    total(prior, share * (count > 2)),
                    total(own, share),
                ],
                [c.split()[0] for c in WORDS.split(", ")],
            )

    names = WORD_ARRAYS
    written = stage(
        texts.mapInArrow(count_words, WORDS)
        .groupBy("word")
        .agg(*[F.sum(name).alias(name) for name in names])
        .repartition(shards, shard_of("word"))
        .mapInArrow(_write_shards(folder, "words", bits, names, 4), SHARDS),
        "word-files",
    )
    word_rows = written.orderBy("file").collect()
    before = [sum(row[n] for row in word_rows) for n in ("n1", "n2", "n3", "n4", "more")]
    entries = sum(row["entries"] for row in word_rows)
    model = Model(
        folder=folder,
        pair_files=pair_files,
        word_files=[row["file"] for row in word_rows],
        tokens=sum(row["total"] for row in word_rows),
        words=entries - (1 if entries else 0),  # START is in the table, never predicted
        pairs=pairs,
        texts=texts.count(),
        bits=bits,
        pair_discounts=discounts(*sums),
        word_discounts=discounts(*before[:4]),
        word_classes=[before[0], before[1], sum(before[2:])],
    )
    model.save()
    return model


def _discounted(counts: np.ndarray, amounts: list[float]) -> np.ndarray:
    step = np.array([0.0, *amounts])[np.minimum(counts, 3).astype(np.int64)]
    return np.maximum(counts - step, 0.0)


def log_probabilities(model: Model, tokens: np.ndarray, starts: np.ndarray, tables) -> tuple:
    """log10 p of each token under the model, and its training count."""
    pairs, words = tables
    before = contexts(tokens, starts)
    distinct, at = np.unique(np.concatenate([tokens, before]), return_inverse=True)
    stats = [c.astype(np.float64) for c in words.find(distinct)]
    own, prior = at[: len(tokens)], at[len(tokens) :]
    count, one, two, more, preceding = stats
    # Continuation probability, interpolated with an even share for every word and one unknown.
    d = model.word_discounts
    left = sum(x * n for x, n in zip(d, model.word_classes, strict=True))
    base = (_discounted(preceding, d) + left / (model.words + 1)) / max(model.pairs, 1)
    if not model.pairs:
        base = np.full(len(distinct), 1.0 / (model.words + 1))
    # A word as context: how often something follows it, and what its discounts leave over.
    d = model.pair_discounts
    pair_count = pairs.find(pair_keys(before, tokens))[0].astype(np.float64)
    follows = _follows(count, distinct, model)
    reserve = d[0] * one + d[1] * two + d[2] * more
    total = follows[prior]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (_discounted(pair_count, d) + reserve[prior] * base[own]) / total
    p = np.where(total > 0, p, base[own])
    return np.log10(p), count[own]


def _follows(count: np.ndarray, distinct: np.ndarray, model: Model) -> np.ndarray:
    """Every word is followed by something; START as often as there are ends."""
    at = np.searchsorted(distinct, START)
    total = count.copy()
    if at < len(distinct) and distinct[at] == START:
        total[at] = model.texts
    return total


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, held_out, text)`` with token counts and both log10 scores.

    ``base_score`` sums the smoothed unigram logarithms, ``score`` those of the
    model. A text without words is one end token.
    """
    floor = np.log10(model.tokens + 0.5 * (model.words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (
            SortedArrays.of(model.folder, model.pair_files, ["count"], model.bits),
            SortedArrays.of(model.folder, model.word_files, WORD_ARRAYS, model.bits),
        )
        for batch in _batches(batches, 1024):
            if not batch.num_rows:
                continue
            tokens, starts = word_hashes(_text_list(batch[2]))
            logs, counts = log_probabilities(model, tokens, starts, tables)
            first, sizes = starts[:-1], np.diff(starts)
            known = np.add.reduceat((counts > 0).astype(np.int64), first)
            base = np.add.reduceat(np.log10(counts + 0.5) - floor, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0],
                    batch[1],
                    pa.array(sizes, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array([model.tokens] * len(sizes), pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(np.add.reduceat(logs, first), pa.float64()),
                ],
                [c.split()[0] for c in SCORES.split(", ")],
            )

    return docs.mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, folder: str, folds: int = 5, held: int = 1) -> DataFrame:
    """Train on all documents but one fold and score every document.

    A document's fold is the CRC-32 of its id as text, modulo ``folds``; a row
    without ``doc_id`` is in fold 0. A null text is the empty text, one end
    token. Repeated rows count as often as they are there. From an empty table
    nothing is learnt and no row comes out; if only held-out rows exist every
    token is unknown.
    """
    fold = F.crc32(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))) % folds
    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (fold == held).alias("held_out"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )
    model = train(texts.filter(~F.col("held_out")).select("text"), folder)
    return score(texts, model)
