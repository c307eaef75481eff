"""Files by path or URI, the same on the driver and in tasks: ranged reads, listings, writes that appear at once."""

from __future__ import annotations

import posixpath
import re
import uuid
from contextlib import contextmanager

from pyarrow import fs

AHEAD = 1 << 16


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one (see qualified)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)


def qualified(spark, path: str) -> str:
    """path with the scheme that Spark's own readers would give it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return path
    root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if root.startswith("file:") else root.rstrip("/") + "/" + path.lstrip("/")


def sizes(path: str) -> dict[str, int]:
    """Files and their bytes: of a directory all in it, sorted; of a file itself."""
    system, inner = at(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return {path: info.size}
    found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    return {path.rstrip("/") + "/" + f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name)}


def beside(path: str, name: str) -> str:
    """The file of that name in the folder of path."""
    return posixpath.join(posixpath.dirname(path), name)


class Ranged:
    """Reads of a file by position; short ones come from a window read ahead."""

    def __init__(self, path: str):
        system, inner = at(path)
        self.f = system.open_input_file(inner)
        self.size, self.low, self.window = self.f.size(), 0, b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read(self, low: int, n: int) -> bytes:
        if n >= AHEAD:
            return self.f.read_at(n, low)
        if low < self.low or low + n > self.low + len(self.window):
            self.low, self.window = low, self.f.read_at(AHEAD, low)
        return self.window[low - self.low : low - self.low + n]


def whole(path: str) -> bytes:
    with Ranged(path) as f:
        return f.f.read_at(f.size, 0)


@contextmanager
def appearing(path: str):
    """A stream to path, which appears when it is complete: a task that fails or runs twice leaves no half file."""
    system, inner = at(path)
    draft = f"{inner}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(draft) as out:
            yield out
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_file(inner)
        system.move(draft, inner)
    except BaseException:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise
