"""Repeated passages by content-defined chunking with a gear rolling hash.

The gear hash of the last ``WINDOW`` bytes is computed at every byte. A chunk
ends where the hash is least among its neighbours within ``REACH`` bytes, so
where chunks end depends on nearby bytes alone: inside a passage they are the
same wherever the passage stands, however far an insertion shifted it. Chunks
are compared by a 128-bit digest; runs of chunks that also occur elsewhere form
the repeated spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import map_texts, stage, unused, whole_texts

WINDOW = 16
REACH = 16
SPAN_CHARS = 96
_GEAR = np.random.default_rng(8).integers(0, 1 << 16, 256, dtype=np.uint16)
CHUNKS = "doc_id long, text_key long, high long, low long, first int, last int"


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the last 16 bytes at each byte: the sum of ``gear[b] << age``."""
    rolled = _GEAR[data]
    width = 1
    while width < WINDOW:  # twice as many bytes each time
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint16(width)
        rolled, width = wider, 2 * width
    return rolled


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a chunk ends after each byte."""
    hashes = gear(data)
    behind = np.full(len(data), 0xFFFF, dtype=np.uint16)
    ahead = behind.copy()
    for distance in range(1, REACH + 1):
        np.minimum(behind[distance:], hashes[:-distance], out=behind[distance:])
        np.minimum(ahead[:-distance], hashes[distance:], out=ahead[:-distance])
    ends = (hashes < behind) & (hashes <= ahead)
    ends[:-1] &= data[1:] & 0xC0 != 0x80  # whole characters only
    return ends


def _chunks(batch: pa.RecordBatch) -> pa.RecordBatch:
    if not batch.num_rows:
        kinds = {"long": pa.int64(), "int": pa.int32()}
        fields = [c.split() for c in CHUNKS.split(", ")]
        return pa.RecordBatch.from_pylist([], pa.schema([(name, kinds[kind]) for name, kind in fields]))
    which, counts, firsts, lasts, digests = [], [], [], [], []
    gap = bytes(WINDOW)
    raws = [text.as_py().encode() for text in batch[1]]
    data = np.frombuffer(gap + gap.join([*raws, b""]), dtype=np.uint8)
    ends = cuts(data)
    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)  # characters up to each byte
    start = WINDOW
    for number, raw in enumerate(raws):
        stop = start + len(raw)
        if raw:
            inner = np.flatnonzero(ends[start : stop - 1]) + 1
            edges = [0, *inner.tolist(), len(raw)]
            digests += [
                xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)
            ]
            at = chars[np.asarray(edges) + start - 1] - chars[start - 1]
            firsts.append(at[:-1])
            lasts.append(at[1:])
            which.append(number)
            counts.append(len(edges) - 1)
        start = stop + WINDOW
    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    rows = pa.array(np.repeat(np.array(which, dtype=np.int64), counts))
    none = np.zeros(0, dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch[0].take(rows),
            batch[2].take(rows),
            pa.array(np.ascontiguousarray(halves[:, 0]), pa.int64()),
            pa.array(np.ascontiguousarray(halves[:, 1]), pa.int64()),
            pa.array(np.concatenate([none, *firsts]), pa.int32()),
            pa.array(np.concatenate([none, *lasts]), pa.int32()),
        ],
        [c.split()[0] for c in CHUNKS.split(", ")],
    )


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, high, low`` (digest), ``first, last`` (code points) of every chunk.

    ``text_key`` is a hash of the whole text: different texts may share a ``doc_id``, or have none.
    """
    return map_texts(whole_texts(docs).withColumn("text_key", F.xxhash64("text")), _chunks, CHUNKS)


def repeated_spans(docs: DataFrame, least: int = SPAN_CHARS) -> DataFrame:
    """``doc_id, text_key, first, last, first_doc_id, first_at, n_chunks, copies, kept``.

    One row per maximal run of chunks that occur at least twice, of ``least``
    characters or more. The occurrence with the smallest (doc_id, text_key, first) of a
    chunk is the one to keep; a run is broken where kept and repeated chunks
    meet. ``first_doc_id, first_at`` name the kept occurrence of the run's
    first chunk, ``copies`` the most occurrences of any of its chunks. Null and
    empty texts have no chunks; rows without ``doc_id`` come first. Texts that
    share a ``doc_id`` are apart, each by its ``text_key``; rows equal in both are
    one occurrence with one set of spans. An empty table gives no rows.
    """
    all_chunks = chunks(docs)
    place = F.struct("doc_id", "text_key", "first")
    counted = all_chunks.groupBy("high", "low").agg(
        F.count("*").alias("copies"), F.min(place).alias("owner")
    )
    shared = stage(counted.filter("copies > 1"), "chunks")
    found = all_chunks.join(shared, ["high", "low"])
    owned = place.eqNullSafe(F.col("owner"))
    marked = found.withColumn("kept", owned)
    along = Window.partitionBy("doc_id", "text_key").orderBy("first", "last")
    previous = F.lag("last").over(along)
    same = (F.col("first") <= previous) & (F.col("kept") == F.lag("kept").over(along))
    runs = marked.withColumn("new", F.when(same, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(along)
    )

    def of_first(column: Column) -> Column:
        return F.min_by(column, "first")

    return (
        runs.groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            of_first(F.col("owner.doc_id")).alias("first_doc_id"),
            of_first(F.col("owner.first")).alias("first_at"),
            F.count("*").alias("n_chunks"),
            F.max("copies").alias("copies"),
            F.first("kept").alias("kept"),
        )
        .drop("run")
        .filter(F.col("last") - F.col("first") >= least)
    )


def remove_repeats(docs: DataFrame, least: int = SPAN_CHARS) -> DataFrame:
    """``docs`` with every repeated span but the kept one cut out of ``text``.

    All columns stay, whatever their names. Null and empty texts stay as they are,
    and so do rows equal to one another, which are one occurrence; an empty table gives no rows.
    """
    spans, key, of, cut = (unused(docs, name) for name in ("spans", "text_key", "of_doc", "of_key"))
    found = (
        repeated_spans(docs, least)
        .filter(~F.col("kept"))
        .groupBy(F.col("doc_id").alias(of), F.col("text_key").alias(cut))
        .agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias(spans))
    )
    before = lambda i: F.coalesce(F.get(spans, i - 1)["last"], F.lit(0))
    edges = F.transform(spans, lambda s, i: F.substring("text", before(i) + 1, s["first"] - before(i)))
    tail = F.substring("text", F.element_at(spans, -1)["last"] + 1, F.length("text"))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(edges, ""), tail))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(cut))
    joined = keyed.join(found, same, "left")
    return joined.withColumn("text", text).select(*docs.columns)
