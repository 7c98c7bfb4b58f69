"""Token ids as length-delimited binary records with a separate offset index.

A record is: length of the payload (8 bytes), masked checksum of these bytes
(4), payload, masked checksum of the payload (4), all little-endian. The
payload is one document's ids in the fewest bytes that hold the vocabulary (2
or 4 each). The index has one row per record, so a reader can take any record
by itself, in any order, and check it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import ROWS, stage, whole_texts
from codeloom.llm.encoder import WIDTH, crc, encoder, pack

INDEX = "doc_id long, part int, file string, position long, n_bytes long, first long, n_tokens long"
RECORDS = "doc_id long, part int, first long, n_tokens long, ids_crc32 long"
_MASK = 0xA282EAD8
READ = 4 << 20


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that a checksum of checksums stays sound."""
    code = zlib.crc32(data)
    return ((code >> 15 | code << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join(
        [length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))]
    )


def unframe(record: bytes) -> bytes:
    """The payload of one record; raises ``ValueError`` if a byte was changed."""
    length, payload = record[:8], record[12:-4]
    head, tail = struct.unpack("<I", record[8:12])[0], struct.unpack("<I", record[-4:])[0]
    if struct.unpack("<Q", length)[0] != len(payload) or masked(length) != head:
        raise ValueError("damaged record length")
    if masked(payload) != tail:
        raise ValueError("damaged record payload")
    return payload


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write the ids of all texts in ascending ``doc_id`` order; returns the index.

    Files follow each other by ``part``, records in a file by ``position``.
    Every attempt of a task writes a file of its own name and only the
    successful one is in the index, so a lost executor leaves no half record
    that a reader could meet.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, out, position, first = f"part-{part:06d}-{uuid.uuid4().hex}.rec", None, 0, 0
        coder = encoder(tokenizer)
        end, narrow = pack([end_id]), max(coder.vocabulary, end_id + 1) <= 1 << 16
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                rows = []
                for doc_id, text in zip(piece[0].to_pylist(), piece[1], strict=True):
                    ids = coder.encode(text.as_py()) + end
                    n = len(ids) // WIDTH
                    if narrow:
                        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                    record = frame(ids)
                    if out is None:
                        files, path = pafs.FileSystem.from_uri(folder)
                        files.create_dir(path)
                        out = files.open_output_stream(f"{path}/{name}")
                    out.write(record)
                    rows.append((doc_id, part, name, position, len(record), first, n))
                    position += len(record)
                    first += n
                yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    ordered = (
        whole_texts(docs)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return stage(ordered.mapInArrow(write, INDEX), "records")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [pa.array(c, kinds[f[1]]) for c, f in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [f[0] for f in fields])


def _neighbours(names: list[str], position: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows whose records lie side by side in one file, ``READ`` bytes or one record at a time."""
    low = 0
    for i in range(1, len(names) + 1):
        if i < len(names) and names[i] == names[low] and position[i] == position[i - 1] + size[i - 1]:
            if position[i] + size[i] - position[low] <= READ:
                continue
        yield low, i
        low = i


def read_records(index: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """The records an index (or any part of it, in any order) names, read and checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        open_name, source = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, rows = batch.column(2).to_pylist(), []
            position, size = (batch.column(c).to_numpy() for c in (3, 4))
            for low, high in _neighbours(names, position, size):
                if names[low] != open_name:
                    files, path = pafs.FileSystem.from_uri(folder)
                    open_name, source = names[low], files.open_input_file(f"{path}/{names[low]}")
                begin = int(position[low])
                source.seek(begin)
                held = memoryview(source.read(int(position[high - 1] + size[high - 1]) - begin))
                ends = (position[low:high] + size[low:high] - begin).tolist()
                for end, n in zip(ends, size[low:high].tolist(), strict=True):
                    ids = np.frombuffer(unframe(held[end - n : end]), kind).astype("<u4")
                    rows.append((len(ids), crc(ids.tobytes())))
            tokens, codes = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            columns = [batch.column(0), batch.column(1), batch.column(5), tokens, codes]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RECORDS.split(", ")])

    return index.mapInArrow(read, RECORDS)


def token_output(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write all documents, read the files back: ``doc_id, start, n_tokens, ids_crc32``.

    A null or empty text is the end id alone; rows without ``doc_id`` come
    first; of rows with the same ``doc_id`` each is written, ordered by the hash
    of the text. An empty table writes no file and gives no rows.
    """
    index = write_records(docs, tokenizer, folder, end_id)
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row per written file, never one per document.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
    starts = sizes.select("part", before)
    rows = read_records(index, tokenizer, folder, end_id)
    return rows.join(starts, "part").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
