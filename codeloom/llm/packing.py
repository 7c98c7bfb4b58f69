"""Best-fit packing of token sequences by hierarchical residual merging.

Each task packs a bounded number of items by best fit. Bins that are nearly
full are final; an underfull bin becomes one item of the next round, in which
fewer tasks each see the leftovers of several earlier ones. A bin carries its
members, at most one per token, so no join is needed to place them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_texts, stage, whole_texts
from codeloom.llm.encoder import WIDTH, crc, encoder, pack

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = f"struct<{', '.join(c.replace(' ', ':') for c in PIECES.split(', '))}, offset:long>"
BINS = f"size long, members array<{_MEMBER}>"
ITEMS_PER_TASK = 20_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Every document as ids plus ``end_id``, in pieces of at most ``capacity``.

    Only a longer document is cut; all its pieces but the first are full.
    """
    end = pack([end_id])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer).encode
        rows: list[tuple] = []
        for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
            ids = encode(text.as_py()) + end
            n = len(ids) // WIDTH
            stops = range(n % capacity or capacity, n + 1, capacity)
            for piece, stop in enumerate(stops):
                start = stops[piece - 1] if piece else 0
                code = crc(ids[start * WIDTH : stop * WIDTH])
                rows.append((doc_id, piece, start, stop - start, code))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECES.split(", ")])

    return map_texts(whole_texts(docs), cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: largest first, each into the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = 0  # bit r is set if a bin with room r waits
    made = 0
    for item in order.tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, number = capacity, made
            made += 1
        bins[item] = number
        if room > size:
            waiting[room - size].append(number)
            rooms |= 1 << (room - size)
    return bins


def _merged(items: pa.Table, capacity: int) -> pa.RecordBatch:
    """One row per bin; members keep their item's order and get their offsets."""
    sizes = items["size"].to_numpy()
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    lists = items["members"].combine_chunks().take(pa.array(order))
    counts = np.diff(lists.offsets.to_numpy())
    first_item = np.flatnonzero(np.diff(bins[order], prepend=-1))
    members = lists.flatten()
    starts = np.concatenate([[0], np.cumsum(counts)])
    edges = np.append(starts[first_item], len(members)).astype(np.int32)
    names = [f.name for f in members.type]
    lengths = members.field("length").to_numpy()
    before = np.cumsum(lengths) - lengths
    offsets = before - np.repeat(before[edges[:-1]], np.diff(edges))
    fields = [members.field(n) for n in names if n != "offset"] + [pa.array(offsets, pa.int64())]
    values = pa.StructArray.from_arrays(fields, [n for n in names if n != "offset"] + ["offset"])
    sums = np.add.reduceat(sizes[order], first_item)
    return pa.RecordBatch.from_arrays(
        [pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), values)],
        ["size", "members"],
    )


def pack_bins(items: DataFrame, capacity: int, nearly: float = 0.998) -> DataFrame:
    """Bins (``size``, ``members``) of items of the same columns, none above ``capacity``.

    Rounds end when one task has seen all that is left, or when a round joins
    less than one bin in fifty (then sizes are such that little can be joined).
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is not None and held.num_rows:
            whole = _merged(held, capacity)
            for first in range(0, whole.num_rows, 2000):
                yield whole.slice(first, 2000)

    full = F.col("size") >= int(capacity * nearly)
    done = items.filter(F.col("size") >= capacity)
    left = items.filter(F.col("size") < capacity)
    count = left.count()
    while count:
        tasks = -(-count // ITEMS_PER_TASK)
        bins = stage(left.repartition(tasks).mapInArrow(fit, BINS), "bins")
        done = done.unionByName(bins.filter(full))
        left = bins.filter(~full)
        before, count = count, left.count()
        if tasks == 1 or count > 0.98 * before:
            return done.unionByName(left)
    return done


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """Place of every piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the one id ``end_id``. Repeated rows and a null
    ``doc_id`` are packed as they are, so every row appears. An empty table
    gives no rows. Of the other columns none is read.
    """
    pieces = stage(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    member = F.struct(*pieces.columns, F.lit(0).cast("long").alias("offset"))
    items = pieces.select(F.col("length").alias("size"), F.array(member).alias("members"))
    bins = pack_bins(items, capacity)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.select("sequence_id", F.inline("members"))
