"""Files behind HTTP or FTP as ranges of octets: ``spark.read.format("http_ranges")``.

Options: ``url``, one or several separated by blanks; ``block``, octets of a range (4 MB); ``timeout``
in seconds; ``proxy``, the address of a proxy (else the environment's), and ``bypass``, host names
separated by commas that are asked directly. The driver asks for each file's size; a task reads
one range, and asks again from where a broken answer ended. A server that knows no ranges is read
whole by one task for a file. Rows are (url, start, size, data): ``size`` is the whole file's.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, start long, size long, data binary"
TRIES = 3


def _opener(url: str, options: Mapping[str, str]) -> urllib.request.OpenerDirector:
    host = urlsplit(url).hostname or ""
    direct = host in [h.strip() for h in options.get("bypass", "").split(",")]
    if direct:
        return urllib.request.build_opener(urllib.request.ProxyHandler({}))
    if proxy := options.get("proxy"):
        return urllib.request.build_opener(urllib.request.ProxyHandler({"http": proxy, "https": proxy, "ftp": proxy}))
    return urllib.request.build_opener()


class RangeFile:
    """A file behind a URL with ``seek``, ``tell``, ``read`` and ``size``, each read a request for its range."""

    def __init__(self, url: str, options: Mapping[str, str] | None = None) -> None:
        self.url, self.options = url, dict(options or {})
        self.at = 0
        self.size, self.ranges = self._probe()

    def _open(self, headers: Mapping[str, str], method: str = "GET"):
        request = urllib.request.Request(self.url, headers=dict(headers), method=method)
        return _opener(self.url, self.options).open(request, timeout=float(self.options.get("timeout", 60)))

    def _probe(self) -> tuple[int, bool]:
        """The size, and whether the server gives ranges."""
        with self._open({"Range": "bytes=0-0"}) as answer:
            whole = answer.headers.get("Content-Range", "").rpartition("/")[2]
            if answer.status == 206 and whole.isdigit():
                return int(whole), True
            length = answer.headers.get("Content-Length")
            return (int(length) if length else -1), False

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to if whence == 0 else self.at + to if whence == 1 else self.size + to
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        if not self.ranges:
            with self._open({}) as answer:
                data = answer.read()[self.at :]
            data = data if n < 0 else data[:n]
            self.at += len(data)
            return data
        end = self.size if n < 0 else min(self.size, self.at + n)
        out = bytearray()
        tries = 0
        while self.at < end:
            try:
                with self._open({"Range": f"bytes={self.at}-{end - 1}"}) as answer:
                    part = answer.read()
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                part = b""
            if not part:
                tries += 1
                if tries == TRIES:
                    raise OSError(f"{self.url}: no octets from {self.at}")
            out += part[: end - self.at]
            self.at += len(part[: end - self.at])
        return bytes(out)


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = dict(options)
        self.block = int(self.options.get("block", 4 << 20))

    def partitions(self) -> list[InputPartition]:
        out = []
        for url in self.options["url"].split():
            f = RangeFile(url, self.options)
            whole = not f.ranges or f.size <= 0
            out += [InputPartition((url, a, None if whole else self.block)) for a in (range(0, f.size, self.block) if not whole else [0])]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, start, n = partition.value
        f = RangeFile(url, self.options)
        f.seek(start)
        data = f.read(-1 if n is None else n)
        yield url, start, f.size if f.size >= 0 else len(data), data


class HttpRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpRanges)
