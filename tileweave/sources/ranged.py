"""Bytes of a file read by ranges where they are needed, on any file system."""

from __future__ import annotations

from collections import OrderedDict

PAGE = 1 << 16
#: Pages that a file keeps; longer reads go past them.
KEPT = 64


def file_system(path: str):
    """pyarrow's file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


class Ranged:
    """A file as a sequence of bytes: slices are read when they are asked for, small ones by whole pages.

    ``read`` counts the bytes that were fetched.
    """

    def __init__(self, path: str):
        system, at = file_system(path)
        self.file = system.open_input_file(at)
        self.size, self.read = self.file.size(), 0
        self.pages: OrderedDict[int, bytes] = OrderedDict()

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def __len__(self) -> int:
        return self.size

    def _fetch(self, start: int, size: int) -> bytes:
        data = self.file.read_at(size, start)
        self.read += len(data)
        return data

    def _page(self, n: int) -> bytes:
        page = self.pages.get(n)
        if page is None:
            page = self.pages[n] = self._fetch(n * PAGE, min(PAGE, self.size - n * PAGE))
            if len(self.pages) > KEPT:
                self.pages.popitem(last=False)
        else:
            self.pages.move_to_end(n)
        return page

    def __getitem__(self, at):
        if not isinstance(at, slice):
            at = at + self.size if at < 0 else at
            if not 0 <= at < self.size:
                raise IndexError(at)
            return self._page(at // PAGE)[at % PAGE]
        start, stop, step = at.indices(self.size)
        if step != 1:
            raise ValueError("bytes are read in order")
        if stop <= start:
            return b""
        first, last = start // PAGE, (stop - 1) // PAGE
        if last - first > 3:
            return self._fetch(start, stop - start)
        joined = b"".join(self._page(n) for n in range(first, last + 1))
        return joined[start - first * PAGE : stop - first * PAGE]
