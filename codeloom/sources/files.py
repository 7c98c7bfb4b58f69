"""Source files as DataFrames: discovery, reading, text and fingerprints."""

from __future__ import annotations

import os
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import suffix
from codeloom.session import stage

# Fixed value: the extensions that are indexed.
SUPPORTED_EXTENSIONS = [".java", ".jsx", ".tsx", ".html", ".cfm", ".cfc", ".sql"]

_ENTRY = "file_path string, is_dir boolean, length long, error string"
_CONTENT = "file_path string, content binary, error string"
# Directories one task lists before it hands the rest back for redistribution.
DIRECTORIES_PER_TASK = 2000
# Files one task lists before it hands the rest back, in the first round; later rounds list
# four times as many each, so that few rounds reach any size.
FILES_PER_TASK = 10_000
# Bytes of file content per Arrow batch, and per task, while reading.
BATCH_BYTES = 16 * 1024 * 1024
TASK_BYTES = 256 * 1024 * 1024
# A larger file cannot be one value of a row.
LARGEST = (1 << 31) - (1 << 16)
# Rows of a listing, or of contents, per Arrow batch.
ROWS = 10_000
# Address of a folder whose files lie in zip archives, which then count as folders.
PACKED = "zip:"


def mounted_path(root: str) -> str | None:
    """Path on a mounted file system, or None for an object store or HDFS address."""
    parsed = urlparse(root)
    if parsed.scheme in ("", "file"):
        return parsed.path if parsed.scheme else root
    return None


def check_root(spark: SparkSession, root: str) -> bool:
    """Whether the repository path exists, on any file system Spark knows."""
    root = root.removeprefix(PACKED)
    mounted = mounted_path(root)
    address = root if mounted is None else f"file:{os.path.abspath(mounted)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class _Mount:
    """Listing and reading on a mounted file system; entries come one by one."""

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, True, 0
                elif entry.is_file():
                    yield entry.path, False, entry.stat().st_size

    def size(self, path: str) -> int:
        return os.stat(path).st_size

    def read(self, path: str) -> bytes:
        with open(path, "rb") as handle:
            return handle.read()

    def is_file(self, path: str) -> bool:
        return os.path.isfile(path)

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb")


class _Store:
    """The same on any other store that pyarrow has a handle for; paths are addresses below ``root``."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.files, self.base = pafs.FileSystem.from_uri(self.root)

    def _inside(self, address: str) -> str:
        return self.base + address[len(self.root) :]

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        for info in self.files.get_file_info(pafs.FileSelector(self._inside(folder))):
            address = self.root + info.path[len(self.base) :]
            if info.type == pafs.FileType.Directory:
                yield address, True, 0
            elif info.type == pafs.FileType.File:
                yield address, False, info.size or 0

    def size(self, path: str) -> int:
        info = self.files.get_file_info(self._inside(path))
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        return info.size or 0

    def read(self, path: str) -> bytes:
        with self.files.open_input_stream(self._inside(path)) as handle:
            return handle.read()

    def is_file(self, path: str) -> bool:
        return self.files.get_file_info(self._inside(path)).type == pafs.FileType.File

    def open(self, path: str) -> BinaryIO:
        return self.files.open_input_file(self._inside(path))


class _Packed:
    """The same for files in zip archives, which another store holds; an archive is a folder.

    Its members' paths are the archive's, a slash and their names. The archive opened last stays
    open, so what is read should come archive by archive.
    """

    def __init__(self, store: _Mount | _Store):
        self.store = store
        self.place: str | None = None
        self.archive: zipfile.ZipFile | None = None

    def _open(self, place: str) -> zipfile.ZipFile:
        if place != self.place:
            self.place = None
            try:
                self.archive = zipfile.ZipFile(self.store.open(place))
            except (zipfile.BadZipFile, NotImplementedError, ValueError) as problem:
                raise OSError(_message(problem)) from problem
            self.place = place
        return self.archive

    def _member(self, path: str) -> tuple[str, str]:
        """Path of the archive and the name in it."""
        if self.place and path.startswith(self.place + "/"):
            return self.place, path[len(self.place) + 1 :]
        end = path.lower().find(".zip/")
        while end >= 0:
            if self.store.is_file(path[: end + 4]):
                return path[: end + 4], path[end + 5 :]
            end = path.lower().find(".zip/", end + 1)
        raise FileNotFoundError(path)

    def _info(self, path: str) -> tuple[zipfile.ZipFile, zipfile.ZipInfo]:
        place, name = self._member(path)
        archive = self._open(place)
        try:
            return archive, archive.getinfo(name)
        except KeyError as problem:
            raise FileNotFoundError(path) from problem

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        if folder.lower().endswith(".zip") and self.store.is_file(folder):
            # A name that is in an archive twice is the file that was added last, as when it is read.
            for name, info in {i.filename: i for i in self._open(folder).infolist()}.items():
                if not info.is_dir():
                    yield f"{folder}/{name}", False, info.file_size
        else:
            for path, is_dir, _ in self.store.entries(folder):
                if is_dir or path.lower().endswith(".zip"):
                    yield path, True, 0

    def size(self, path: str) -> int:
        return self._info(path)[1].file_size

    def read(self, path: str) -> bytes:
        archive, info = self._info(path)
        try:
            return archive.read(info)
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as problem:
            raise OSError(_message(problem)) from problem


def _handle(root: str | None) -> _Mount | _Store | _Packed:
    """What lists and reads below ``root``, or on a mount if that is None."""
    if root is None:
        return _Mount()
    if not root.startswith(PACKED):
        return _Store(root)
    inner = root.removeprefix(PACKED)
    return _Packed(_Mount() if mounted_path(inner) is not None else _Store(inner))


def _has_handle(root: str) -> bool:
    root = root.removeprefix(PACKED)
    if mounted_path(root) is not None:
        return True
    try:
        pafs.FileSystem.from_uri(root.rstrip("/"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def _message(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def _lister(root: str | None, most: int):
    """Kernel: walks the given directories; unvisited ones beyond the budget come back as rows.

    A directory that cannot be listed is one row with an error; what was found
    in it before stays. Rows leave in batches also inside a huge directory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _handle(root)
        pending = [d for batch in batches for d in batch.column(0).to_pylist()]
        budget, files = DIRECTORIES_PER_TASK, 0
        rows: list[tuple[str, bool, int, str | None]] = []
        while pending and budget > 0 and files < most:
            budget -= 1
            folder = pending.pop()
            try:
                for path, is_dir, size in store.entries(folder):
                    if is_dir:
                        pending.append(path)
                    else:
                        rows.append((path, False, size, None))
                        files += 1
                    if len(rows) >= ROWS:
                        yield _batch(rows, _ENTRY)
                        rows = []
            except OSError as problem:
                rows.append((folder, False, 0, _message(problem)))
        rows += [(d, True, 0, None) for d in pending]
        for low in range(0, len(rows), ROWS):
            yield _batch(rows[low : low + ROWS], _ENTRY)

    return run


def supported(path: Column) -> Column:
    return suffix(path).isin(SUPPORTED_EXTENSIONS)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` with a supported extension: file_path, length, error.

    Hidden names count. Directories are listed by tasks, round by round, so one
    huge subtree spreads over the cluster; a directory that cannot be listed is
    one row with an error. Stores that are not mounted are listed through a
    handle of pyarrow; only an address it has no handle for goes through Spark's
    own listing, which skips names that start with ``_`` or ``.``. An address that
    begins with ``zip:`` is a folder of zip archives at any depth, and the files are theirs.
    """
    path = mounted_path(root)
    if path is None and not _has_handle(root):
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(root)
            .select(F.col("path").alias("file_path"), "length", F.lit(None).cast("string").alias("error"))
        )
        return listed.where(supported(F.col("file_path")))
    slots = spark.sparkContext.defaultParallelism
    base = root.removeprefix(PACKED)
    frontier = spark.createDataFrame([(mounted_path(base) or base.rstrip("/"),)], "file_path string")
    rounds = []
    while True:
        kernel = _lister(root if path is None else None, FILES_PER_TASK * 4 ** len(rounds))
        listing = stage(frontier.repartition(slots).mapInArrow(kernel, _ENTRY), "listing")
        rounds.append(listing.where(~F.col("is_dir")).select("file_path", "length", "error"))
        frontier = listing.where("is_dir").select("file_path")
        if frontier.isEmpty():
            break
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return files.where(supported(F.col("file_path")) | F.col("error").isNotNull())


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of :func:`list_files` without its errors: file_path, length."""
    return list_files(spark, root).where(F.col("error").isNull()).drop("error")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array(values, kinds[kind]) for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _reader(root: str | None):
    """Kernel: the bytes of each path, or why it could not be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _handle(root)
        rows: list[tuple[str, bytes | None, str | None]] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    size = store.size(path)
                    if size > LARGEST:
                        raise OSError(f"{size} bytes are more than a row can hold")
                    if held and held + size > BATCH_BYTES:
                        yield _batch(rows, _CONTENT)
                        rows, held = [], 0
                    rows.append((path, store.read(path), None))
                    held += size
                except OSError as problem:
                    rows.append((path, None, _message(problem)))
                if len(rows) >= ROWS:
                    yield _batch(rows, _CONTENT)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _CONTENT)

    return run


def read_files(files: DataFrame, root: str, total_bytes: int | None = None) -> DataFrame:
    """Bytes of the given files: file_path, content, error (unreadable files have an error).

    The number of tasks follows from the total length, which is summed up
    unless the caller knows it.
    """
    spark = files.sparkSession
    mounted = mounted_path(root) is not None
    if not mounted and not _has_handle(root):
        contents = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(root)
            .select(F.col("path").alias("file_path"), "content", F.lit(None).cast("string").alias("error"))
        )
        return contents.join(files.select("file_path"), "file_path", "left_semi")
    if total_bytes is None:
        total_bytes = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total_bytes // TASK_BYTES))
    paths = files.select("file_path")
    if root.startswith(PACKED):  # archive by archive, so that a task opens each once
        paths = paths.repartitionByRange(int(tasks), "file_path").sortWithinPartitions("file_path")
    else:
        paths = paths.repartition(int(tasks))
    return paths.mapInArrow(_reader(None if mounted else root), _CONTENT)


def read_text(files: DataFrame) -> DataFrame:
    """Decode ``content`` as UTF-8 into ``text``; bad bytes become U+FFFD."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")


def fingerprint(files: DataFrame) -> DataFrame:
    """Add ``file_sha256`` of the raw bytes."""
    return files.withColumn("file_sha256", F.sha2(F.col("content"), 256))
