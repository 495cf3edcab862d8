"""Plain files in the shared folder, from the driver and from executors."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs as pafs


def open_fs(uri: str):
    """The file system of a URI or local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


class Out:
    """A file that has its name only once it is whole, so a lost or repeated task leaves no half of one."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.f = self.fs.open_output_stream(self.tmp)

    def write(self, data) -> None:
        self.f.write(data)

    def done(self) -> None:
        self.f.close()
        self.fs.move(self.tmp, self.path)


class _Ranges:
    """A flat file in a store: a slice reads its bytes and no others."""

    def __init__(self, fs, path: str, size: int, dtype):
        self.f, self.dtype = fs.open_input_file(path), np.dtype(dtype)
        self.n = size // self.dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: slice) -> np.ndarray:
        i, j, _ = at.indices(self.n)
        one = self.dtype.itemsize
        return np.frombuffer(self.f.read_at(max(0, j - i) * one, i * one), self.dtype)


def mapped(uri: str, dtype):
    """A flat file to take slices of: memory-mapped where it is local or mounted, else read range by range."""
    fs, path = open_fs(uri)
    size = fs.get_file_info(path).size
    if not size:
        return np.empty(0, dtype)
    return np.memmap(path, dtype, "r") if fs.type_name == "local" else _Ranges(fs, path, size, dtype)
