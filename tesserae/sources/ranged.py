"""Reading parts of files: HTTP servers that answer byte ranges, and the file systems that Arrow opens (local, s3, gs, hdfs)."""

from __future__ import annotations

import glob
import os
import urllib.error
import urllib.request

from pyarrow import fs

from tesserae.errors import InvalidArgument, NotFound, RasterError

WINDOW = 64 << 10
STORES = ("s3", "s3a", "gs", "hdfs")


def remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def reachable(path: str) -> bool:
    """Whether tasks can open paths like this in ranges; others go through Spark's own file source."""
    return remote(path) or "://" not in path.removeprefix("file://") or path.split("://")[0] in STORES


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path in it."""
    if path.split("://")[0] in STORES:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def found(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in nanoseconds) of paths and globs, separated by commas, in order of name.

    Only listings are read. HTTP URLs stand for themselves, with neither.
    """
    out = []
    for p in map(str.strip, path.split(",")):
        if remote(p):
            out.append((p, 0, 0))
            continue
        store, inside = place(p)
        if not isinstance(store, fs.LocalFileSystem):
            from fnmatch import fnmatch

            base = inside.split("*")[0].rsplit("/", 1)[0] if "*" in inside else inside
            listed = store.get_file_info(fs.FileSelector(base, recursive=True)) if "*" in inside else [store.get_file_info(inside)]
            head = p[: len(p) - len(inside)]
            out += sorted((head + i.path, i.size, i.mtime_ns) for i in listed if i.type == fs.FileType.File and fnmatch(i.path, inside))
            continue
        for name in sorted(glob.glob(inside)):
            names = sorted(e.path for e in os.scandir(name) if e.is_file()) if os.path.isdir(name) else [name]
            out += [(n, s.st_size, s.st_mtime_ns) for n in names for s in [os.stat(n)]]
    return out


class Ranged:
    """read(offset, size) over one file; fewer bytes at its end. For URLs a small window around the last read is kept."""

    def __init__(self, path: str, token: str | None = None, window: int = WINDOW):
        self.path, self.token, self.window = path, token, window
        self.remote = remote(path)
        self.at, self.held, self.whole = 0, b"", None
        if self.remote:
            self.at, self.held = 0, self._fetch(0, window)
            return
        store, inside = place(path)
        try:
            self.file = store.open_input_file(inside)
        except (FileNotFoundError, IsADirectoryError):
            raise NotFound(path) from None
        self.whole = self.file.size()

    @property
    def size(self) -> int:
        return self.whole

    def _fetch(self, offset: int, size: int) -> bytes:
        head = {"Range": f"bytes={offset}-{offset + size - 1}"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.path, headers=head), timeout=60) as r:
                data = r.read()
                if r.status == 200:  # a server without ranges sends everything
                    self.whole = len(data)
                    return data[offset : offset + size]
                self.whole = int(r.headers.get("Content-Range", "/0").rpartition("/")[2] or 0)
                return data
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise NotFound(self.path) from None
            if e.code == 416:  # beyond the end
                self.whole = self.whole or 0
                return b""
            raise RasterError(f"{self.path}: HTTP {e.code}") from None

    def read(self, offset: int, size: int) -> bytes:
        if offset < 0 or size < 0:
            raise InvalidArgument("range")
        if self.whole is not None:
            size = max(0, min(size, self.whole - offset))
        if not self.remote:
            return self.file.read_at(size, offset) if size else b""
        if not self.at <= offset or offset + size > self.at + len(self.held):
            self.at, self.held = offset, self._fetch(offset, max(size, self.window)) if size else b""
        return self.held[offset - self.at : offset - self.at + size]

    def close(self) -> None:
        if not self.remote:
            self.file.close()

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
