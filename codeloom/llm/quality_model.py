"""A byte-level convolutional network, in numpy, that tells good documents from bad.

Bytes are looked up as short learned vectors; learned filters of eight bytes slide
over a document in steps of four. Their answers are pooled (maximum and mean) in
overlapping chunks of 256 bytes that begin every 128, a small dense layer reads each
chunk, and the chunks' answers are pooled over the whole document and combined into
one probability. The same network sees every document whole, whatever its length.

It is fitted by one task on a bounded sample of labelled rows (``SAMPLE`` documents,
of each at most ``FIT_CHUNKS`` evenly spread chunks). Scoring has no bounds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stage, whole_texts

SAMPLE = 3000  # labelled documents the network is fitted on, at most
FIT_CHUNKS = 16  # chunks of each of these, at most
EPOCHS, BATCH, RATE = 6, 32, 0.01

BLOCK, PER_CHUNK, HOP = 64, 4, 2  # bytes of a block; blocks of a chunk, and from one to the next
STRIDE = 4  # bytes from one place of a filter to the next; a filter is twice as long
VECTOR, FILTERS, DENSE = 6, 24, 16
PAD = 256  # the byte value beyond a text's end
PIECE = 1 << 18  # bytes convolved at a time
SLICE = 8_000_000  # bytes of text scored at a time
_PLACES = BLOCK // STRIDE

Weights = dict[str, np.ndarray]


def start_weights(seed: int = 13) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(rows: int, columns: int) -> np.ndarray:
        return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

    vectors = (0.5 * rng.standard_normal((PAD + 1, VECTOR))).astype(np.float32)
    vectors[PAD] = 0
    return {
        "vectors": vectors,
        "filters": normal(STRIDE * VECTOR, 2 * FILTERS),  # first and second half of each filter
        "filter_bias": np.zeros(FILTERS, dtype=np.float32),
        "dense": normal(2 * FILTERS, DENSE),
        "dense_bias": np.zeros(DENSE, dtype=np.float32),
        "last": normal(2 * DENSE, 1),
        "last_bias": np.zeros(1, dtype=np.float32),
    }


def _convolve(w: Weights, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter inputs and answers at every place but the last of ``padded``."""
    inputs = w["vectors"][padded].reshape(-1, STRIDE * VECTOR)
    halves = inputs @ w["filters"]
    return inputs, np.maximum(halves[:-1, :FILTERS] + halves[1:, FILTERS:] + w["filter_bias"], 0)


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each text, and where each text's first block is.

    Every text has a block more than it fills, so no filter reaches the next text.
    """
    blocks = lengths // BLOCK + 1
    return blocks, np.cumsum(blocks) - blocks


def block_pools(w: Weights, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum, sum and number of the filter answers in each block of all texts."""
    lengths = np.diff(offsets)
    blocks, _ = layout(lengths)
    # The last place of a text reads a stride further; without room for that a block is put behind.
    more = lengths % BLOCK > BLOCK - STRIDE
    stored = blocks + more
    first = np.cumsum(stored) - stored
    n = int(stored.sum())
    padded = np.full(n * BLOCK + STRIDE, PAD, dtype=np.int16)
    shift = first * BLOCK - offsets[:-1]
    padded[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    # A place counts if it begins inside its text; an empty text has one place.
    inside = np.clip(np.repeat(lengths, stored) - (np.arange(n) - np.repeat(first, stored)) * BLOCK, 0, BLOCK)
    places = -(-inside // STRIDE)
    highest = np.zeros((n, FILTERS), dtype=np.float32)
    summed = np.zeros((n, FILTERS), dtype=np.float32)
    step = PIECE // BLOCK
    for low in range(0, n, step):
        high = min(low + step, n)
        _, answers = _convolve(w, padded[low * BLOCK : high * BLOCK + STRIDE])
        answers = answers.reshape(high - low, _PLACES, FILTERS)
        answers = answers * (np.arange(_PLACES)[None, :, None] < places[low:high, None, None])
        highest[low:high], summed[low:high] = answers.max(axis=1), answers.sum(axis=1)
    own = np.ones(n, dtype=bool)
    own[first[more] + blocks[more]] = False
    return highest[own], summed[own], places[own]


def chunk_blocks(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each chunk (-1 beyond the text), and how many chunks each text has."""
    chunks = np.maximum(1, -(-(blocks - PER_CHUNK) // HOP) + 1)
    number = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = number[:, None] * HOP + np.arange(PER_CHUNK)[None, :]
    return np.where(at < np.repeat(blocks, chunks)[:, None], at + np.repeat(first, chunks)[:, None], -1), chunks


def _chunk_inputs(highest: np.ndarray, summed: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    held = (at >= 0)[:, :, None]
    top = (highest[at] * held).max(axis=1)
    total = (summed[at] * held).sum(axis=1)
    count = np.maximum((places[at] * held[:, :, 0]).sum(axis=1), 1)
    return np.concatenate([top, total / count[:, None]], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(w: Weights, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text of ``data``, cut at ``offsets``."""
    blocks, first = layout(np.diff(offsets))
    at, chunks = chunk_blocks(blocks, first)
    read = np.tanh(_chunk_inputs(*block_pools(w, data, offsets), at) @ w["dense"] + w["dense_bias"])
    begins = np.cumsum(chunks) - chunks
    pooled = [np.maximum.reduceat(read, begins), np.add.reduceat(read, begins) / chunks[:, None]]
    return _sigmoid(np.concatenate(pooled, axis=1) @ w["last"] + w["last_bias"])[:, 0].astype(np.float64)


def gradients(w: Weights, chunks: np.ndarray, lengths: np.ndarray, text: np.ndarray, labels: np.ndarray) -> tuple[float, Weights]:
    """Loss and its gradients for texts given as chunks (rows of padded bytes).

    ``lengths`` are the chunks' bytes and ``text`` the text of each chunk, ascending.
    """
    n, size = chunks.shape
    places = size // STRIDE
    inputs, answers = _convolve(w, np.concatenate([chunks.ravel(), np.full(STRIDE, PAD, dtype=chunks.dtype)]))
    valid = np.arange(places)[None, :] < -(-lengths // STRIDE)[:, None]
    answers = answers.reshape(n, places, FILTERS) * valid[:, :, None]
    best = answers.argmax(axis=1)
    top = np.take_along_axis(answers, best[:, None, :], axis=1)[:, 0]
    count = np.maximum(valid.sum(axis=1), 1)[:, None].astype(np.float32)
    pooled = np.concatenate([top, answers.sum(axis=1) / count], axis=1)
    read = np.tanh(pooled @ w["dense"] + w["dense_bias"])
    edges = np.flatnonzero(np.diff(text, prepend=-1))
    per_text = np.diff(np.append(edges, n))
    row = np.repeat(np.arange(len(edges)), per_text)
    most = np.maximum.reduceat(read, edges)
    joined = np.concatenate([most, np.add.reduceat(read, edges) / per_text[:, None]], axis=1)
    p = _sigmoid(joined @ w["last"] + w["last_bias"])[:, 0]
    loss = float(-np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))

    grad: Weights = {}
    back = ((p - labels) / len(labels)).astype(np.float32)[:, None]
    grad["last"], grad["last_bias"] = joined.T @ back, back.sum(axis=0)
    back = back @ w["last"].T
    is_most = read == most[row]
    shared = np.add.reduceat(is_most.astype(np.float32), edges)[row]
    to_read = is_most / shared * back[row, :DENSE] + (back[:, DENSE:] / per_text[:, None])[row]
    to_read = (to_read * (1 - read * read)).astype(np.float32)
    grad["dense"], grad["dense_bias"] = pooled.T @ to_read, to_read.sum(axis=0)
    to_pool = to_read @ w["dense"].T
    to_answers = np.repeat((to_pool[:, FILTERS:] / count)[:, None, :], places, axis=1)
    rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    to_answers[rows, best, filters] += to_pool[:, :FILTERS]
    to_answers = (to_answers * (answers > 0)).reshape(-1, FILTERS)
    grad["filter_bias"] = to_answers.sum(axis=0)
    halves = np.zeros((len(inputs), 2 * FILTERS), dtype=np.float32)
    halves[:-1, :FILTERS], halves[1:, FILTERS:] = to_answers, to_answers
    grad["filters"] = inputs.T @ halves
    to_inputs = (halves @ w["filters"].T).reshape(-1, VECTOR)[: n * size]
    flat = chunks.ravel()
    grad["vectors"] = np.stack([np.bincount(flat, to_inputs[:, d], PAD + 1) for d in range(VECTOR)], axis=1)
    grad["vectors"][PAD] = 0
    return loss, grad


def fit_chunks(data: bytes) -> list[bytes]:
    """The chunks of a text that training looks at: all of them, or evenly spread ones."""
    starts = np.arange(0, max(len(data) - HOP * BLOCK, 1), HOP * BLOCK)
    if len(starts) > FIT_CHUNKS:
        starts = starts[np.linspace(0, len(starts) - 1, FIT_CHUNKS).astype(np.int64)]
    return [data[s : s + BLOCK * PER_CHUNK] for s in starts.tolist()]


def fit(texts: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 13) -> Weights:
    """Weights learnt by Adam from texts given as chunks.

    With a single label, or no text at all, nothing can be learnt: the answer is then
    the labels' smoothed share.
    """
    w = start_weights(seed)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        w["last"][:] = 0
        w["last_bias"][:] = np.log(share / (1 - share))
        return w
    parts = [part for text in texts for part in text]
    chunks = np.full((len(parts), BLOCK * PER_CHUNK), PAD, dtype=np.int16)
    lengths = np.array([len(part) for part in parts])
    owner = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
    chunks[np.arange(BLOCK * PER_CHUNK) < lengths[:, None]] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    share = min(max(float(labels.mean()), 0.02), 0.98)
    w["last_bias"][:] = np.log(share / (1 - share))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    steps = epochs * -(-len(texts) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            step += 1
            chosen = np.sort(order[low : low + BATCH])
            at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in chosen])
            _, grad = gradients(w, chunks[at], lengths[at], owner[at], labels[chosen])
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                w[k] -= (rate * move).astype(np.float32)
    return w


def _fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))) % folds


def _train(docs: DataFrame, labels: DataFrame, sample: int, folds: int) -> Weights:
    """Fit on the labelled rows outside the held-out fold, in one task, and keep the weights."""
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"].cast("int") > 0).cast("int").alias("label"))
    marked = marked.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id"), folds) != 0))
    # At most ``sample`` narrow rows, so they may travel to every task.
    drawn = F.xxhash64("doc_id", "label")
    chosen = F.broadcast(marked.orderBy(drawn, "doc_id").limit(sample))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fit_chunks(text.encode()) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(parts, pa.list_(pa.binary()))], ["doc_id", "label", "chunks"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        weights = fit([r["chunks"] for r in rows], np.array([r["label"] for r in rows], dtype=np.float32))
        out = io.BytesIO()
        np.savez(out, **weights)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], ["weights"])

    texts = docs.join(chosen, "doc_id").select("doc_id", "label", "text")
    one = stage(texts.mapInArrow(spread, "doc_id long, label int, chunks array<binary>"), "fit-sample")
    learnt = one.repartition(1).sortWithinPartitions("doc_id", "label").mapInArrow(learn, "weights binary")
    kept = stage(learnt, "quality-weights").collect()  # one row of about 20 kB
    if not kept:
        return fit([], np.zeros(0, dtype=np.float32))
    with np.load(io.BytesIO(kept[0]["weights"])) as held:
        return {k: held[k] for k in held.files}


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, folds: int = 5) -> DataFrame:
    """``SCORES`` of every row of ``docs``, learnt from ``labels(doc_id, quality)``.

    Labels of documents whose fold (CRC-32 of the id as text, modulo ``folds``)
    is 0 are never read. Only the text enters a score. A null text is the empty
    text, which has a score like any other; a row without ``doc_id`` is scored
    and in fold 0; repeated rows score alike. Labels without a row, an id or a value are
    passed over. Without labels of both kinds every score is their smoothed share. An empty table gives no rows.
    """
    texts = whole_texts(docs)
    weights = _train(texts, labels, sample, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1)
                held = data[offsets[low] : offsets[high]]
                score = probabilities(weights, held, offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(low, high - low).columns[:2],
                        pa.array(score),
                        pa.array((score >= threshold).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )
                low = high

    held_out = (_fold(F.col("doc_id"), folds) == 0).alias("held_out")
    return texts.select("doc_id", held_out, "text").mapInArrow(run, SCORES)
