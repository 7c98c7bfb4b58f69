"""Sorted arrays in the shared folder that tasks map into memory."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile

import numpy as np
import pyarrow.fs as pafs


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path)
    data = io.BytesIO()
    np.save(data, values)
    with files.open_output_stream(f"{path}/{name}.npy") as out:
        out.write(data.getbuffer())


class _Folder:
    """Maps files of a mounted folder where they are; of another store, copies that end with the worker."""

    def __init__(self, folder: str):
        self.files, self.path = pafs.FileSystem.from_uri(folder)
        self.local = isinstance(self.files, pafs.LocalFileSystem)
        if not self.local:
            self.copies = tempfile.mkdtemp(prefix="arrays-")
            atexit.register(shutil.rmtree, self.copies, ignore_errors=True)

    def array(self, name: str) -> np.ndarray:
        path = f"{self.path}/{name}.npy"
        if not self.local:
            copy = os.path.join(self.copies, f"{name}.npy")
            if not os.path.exists(copy):
                pafs.copy_files(path, copy, self.files, pafs.LocalFileSystem())
            path = copy
        return np.load(path, mmap_mode="r")


_OPEN: dict[tuple, SortedArrays] = {}


class SortedArrays:
    """Values by 64-bit key, in files that each hold one range of keys in order."""

    def __init__(self, folder: str, files: list[str], names: list[str], bits: int):
        place = _Folder(folder)
        self.bits, self.width = bits, len(names)
        self.shards = {
            int(file.split("-")[1]): (
                place.array(f"{file}.key"),
                [place.array(f"{file}.{name}") for name in names],
            )
            for file in files
        }

    @classmethod
    def of(cls, folder: str, files: list[str], names: list[str], bits: int) -> SortedArrays:
        """One mapping per worker, for the last models asked for."""
        mark = (folder, *files)
        if mark not in _OPEN:
            while len(_OPEN) > 3:
                _OPEN.pop(next(iter(_OPEN)))
            _OPEN[mark] = cls(folder, files, names, bits)
        return _OPEN[mark]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of each key, 0 where it is missing."""
        order = np.argsort(keys)
        wanted = keys[order]
        found = [np.zeros(len(keys), dtype=np.uint64) for _ in range(self.width)]
        shift = np.uint64(64 - self.bits) if self.bits else None
        shard = (wanted >> shift).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(keys) else []
        for low, high in zip(edges, edges[1:], strict=False):
            if shard[low] not in self.shards:
                continue
            have, values = self.shards[shard[low]]
            at = np.minimum(np.searchsorted(have, wanted[low:high]), len(have) - 1)
            hit = np.flatnonzero(have[at] == wanted[low:high])
            for out, column in zip(found, values, strict=True):
                out[order[low:high][hit]] = column[at[hit]]
        return found
