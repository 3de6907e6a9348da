"""Binary files that tasks write and read in the shared folder, by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs as arrow_fs


def filesystem(uri: str):
    """The file system of a URI (file, hdfs, s3, gs) and the path in it."""
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class RollingWriter:
    """Files in a folder, each up to about ``most`` bytes.

    Names are unique to the attempt; readers go by the names that a successful task returned, so what
    a lost or repeated attempt has left is never read.
    """

    def __init__(self, folder: str, most: int, suffix: str):
        self.fs, self.folder = filesystem(folder)
        self.most, self.suffix = most, suffix
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.name, self.size = None, "", 0

    def open(self) -> str:
        self.name = f"{uuid.uuid4().hex}{self.suffix}"
        self.out, self.size = self.fs.open_output_stream(f"{self.folder}/{self.name}"), 0
        return self.name

    def write(self, data: bytes) -> int:
        """Where the data begin in the current file."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    @property
    def full(self) -> bool:
        return self.size >= self.most

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def read_range(folder: str, name: str, at: int, size: int) -> bytes:
    fs, path = filesystem(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        f.seek(at)
        return f.read(size)


def write_small(folder: str, name: str, data: bytes) -> None:
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as f:
        f.write(data)
