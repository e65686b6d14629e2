"""Where files' bytes come from: local files and web servers, both behind a cache of pages that is bounded in bytes.

A source has seek() and read(), as a file has; reads are widened to whole pages, and each run of missing pages is fetched once."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections import OrderedDict

PAGE = 64 * 1024
MOST_BYTES = 32 << 20  # of pages that a process keeps
LONGEST = 4 << 20  # longer reads go past the cache, which they would sweep
TIMEOUT_S = 30
PAGE_TTL_S = 3600  # of pages from the web


def range_body(status: int, body: bytes, offset: int, n: int) -> bytes:
    """What of an answer is the range asked for: a partial answer is the range, a whole one holds it."""
    if status == 206:
        return body[:n]
    if status == 200:
        return body if len(body) == n and offset == 0 else body[offset : offset + n]
    raise OSError(f"the server answered {status} to a range request")


class WebFile:
    """Ranges of a web address."""

    def __init__(self, url: str):
        self.name, self.version = url, str(int(time.time() // PAGE_TTL_S))

    def fetch(self, offset: int, n: int) -> bytes:
        request = urllib.request.Request(self.name, headers={"Range": f"bytes={offset}-{offset + n - 1}"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:  # noqa: S310
                return range_body(answer.status, answer.read(), offset, n)
        except urllib.error.HTTPError as e:
            if e.code == 416:  # beyond the end
                return b""
            raise OSError(f"the server answered {e.code} to a range request") from e

    def close(self) -> None:
        pass


class LocalFile:
    """Ranges of a local file; reads don't share a position."""

    def __init__(self, path: str):
        self.handle = os.open(path, os.O_RDONLY)
        self.name, self.version = os.path.realpath(path), str(os.fstat(self.handle).st_mtime_ns)

    def fetch(self, offset: int, n: int) -> bytes:
        return os.pread(self.handle, n, offset)

    def close(self) -> None:
        os.close(self.handle)


class Pages:
    """Pages of files, the least recently used going first."""

    def __init__(self, most: int = MOST_BYTES):
        self.most, self.held, self.bytes = most, OrderedDict(), 0

    def get(self, key) -> bytes | None:
        if key in self.held:
            self.held.move_to_end(key)
        return self.held.get(key)

    def put(self, key, page: bytes) -> None:
        if key not in self.held and len(page) <= self.most:
            self.held[key] = page
            self.bytes += len(page)
        while self.bytes > self.most:
            self.bytes -= len(self.held.popitem(last=False)[1])


PAGES = Pages()


class Source:
    """A file's bytes, by pages."""

    def __init__(self, file, pages: Pages = PAGES):
        self.file, self.pages, self.place, self.fetches = file, pages, 0, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, place: int) -> None:
        self.place = place

    def read(self, n: int) -> bytes:
        offset, self.place = self.place, self.place + n
        if n > LONGEST:
            return self._fetch(offset, n)
        first, last = offset // PAGE, (offset + n - 1) // PAGE if n else offset // PAGE
        key = lambda k: (self.file.name, self.file.version, k)
        found = {k: page for k in range(first, last + 1) if (page := self.pages.get(key(k))) is not None}
        k = first
        while k <= last:
            if k in found:
                k += 1
                continue
            end = k
            while end <= last and end not in found:
                end += 1
            data = self._fetch(k * PAGE, (end - k) * PAGE)
            for i in range(k, end):  # short pages mark the end of the file
                found[i] = data[(i - k) * PAGE : (i - k + 1) * PAGE]
                self.pages.put(key(i), found[i])
            k = end
        data = b"".join(found[k] for k in range(first, last + 1))
        return data[offset - first * PAGE : offset - first * PAGE + n]

    def _fetch(self, offset: int, n: int) -> bytes:
        self.fetches += 1
        return self.file.fetch(offset, n)


def open_source(path: str) -> Source:
    return Source(WebFile(path) if path.startswith(("http://", "https://")) else LocalFile(path))
