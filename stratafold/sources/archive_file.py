"""Archive files as tables: ``spark.read.format("solid_archive")``.

An archive is a run of blocks; its footer, found by the signature nearest the end, describes the
control blocks, and each directory block lists its solid blocks and their files column by column.
Whole numbers there have one to nine octets: as many low one bits as octets follow the first.

Options: ``path``, a glob of files that every executor can open; ``table``, one of ``archives``,
``blocks``, ``files``, ``contents``; ``mode``, ``strict`` (a damaged archive fails the query) or
``permissive`` (it has a row in ``archives`` with its class of damage, and no others). A task
reads one archive: its footer and directories, and for ``contents`` one solid block at a time.
Chains of the registered codecs can be read. Streams made by other programs' codecs cannot.
"""

from __future__ import annotations

import glob
import io
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratafold.operators.codecs import CODECS

# fixed values of the format
SIGNATURE = b"ArC\x01"
FOOTER_WINDOW = 4096
DESCRIPTOR, HEADER, DATA, DIRECTORY, FOOTER, RECOVERY = range(6)

SCHEMAS = {
    "archives": "archive string, locked boolean, comment string, recovery string, sfx_size long, blocks int, error string",
    "blocks": "archive string, type int, compressor string, pos long, origsize long, compsize long, crc long, n_files int",
    "files": "archive string, file_id long, dir string, name string, size long, mtime timestamp, isdir boolean, crc long, block int, compressor string",
    "contents": "archive string, file_id long, dir string, name string, size long, crc long, intact boolean, content binary",
}


class Damaged(Exception):
    """An archive that cannot be read; its first argument names the class of damage."""


@dataclass
class Block:
    type: int
    compressor: str
    pos: int
    origsize: int
    compsize: int
    crc: int
    n_files: int = 0


class _Octets:
    """Values from the front of a byte string."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if n < 0 or len(out) < n:
            raise Damaged("bad_data")
        self.at += n
        return out

    def left(self) -> bool:
        return self.at < len(self.data)

    def whole(self) -> int:
        first = self.take(1)[0]
        more = (~first & (first + 1)).bit_length() - 1 if first < 255 else 8
        rest = self.take(more)
        return int.from_bytes(rest, "little") if more == 8 else int.from_bytes(bytes([first]) + rest, "little") >> (more + 1)

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Damaged("bad_data")
        return self.take(end + 1 - self.at)[:-1].decode("utf-8", "replace")

    def fixed(self, n: int, code: str) -> tuple[int, ...]:
        return struct.unpack(f"<{n}{code}", self.take(struct.calcsize(f"<{n}{code}")))


def whole_number(v: int) -> bytes:
    """The octets of a whole number, as few as will do."""
    for n in range(1, 9):
        if v < 1 << (7 * n):
            return ((v << n) | ((1 << (n - 1)) - 1)).to_bytes(n, "little")
    return b"\xff" + v.to_bytes(8, "little")


def _unpack(compressor: str, data: bytes, size: int) -> bytes:
    for m in reversed(compressor.split("+")):
        codec = CODECS.get(m.split(":")[0])
        if codec is None:
            raise Damaged("unsupported_method")
        try:
            data = codec.decode(data)
        except Exception as e:
            raise Damaged("decompression") from e
    if len(data) != size:
        raise Damaged("decompression")
    return data


def _control(f: io.BufferedIOBase, b: Block) -> _Octets:
    f.seek(b.pos)
    data = _unpack(b.compressor, f.read(b.compsize), b.origsize)
    if zlib.crc32(data) != b.crc:
        raise Damaged("block_crc")
    return _Octets(data)


def _footer(f: io.BufferedIOBase) -> Block:
    size = f.seek(0, io.SEEK_END)
    f.seek(max(0, size - FOOTER_WINDOW))
    tail = f.read()
    at = tail.rfind(SIGNATURE)
    if at < 0:
        raise Damaged("no_footer")
    descriptor, own = tail[at:-4], tail[-4:]
    if zlib.crc32(descriptor) != int.from_bytes(own, "little"):
        raise Damaged("descriptor_crc")
    o = _Octets(descriptor[4:])
    kind, compressor, orig, comp = o.whole(), o.text(), o.whole(), o.whole()
    start = size - len(tail) + at
    if kind != FOOTER or not orig or not 0 < comp <= start:
        raise Damaged("bad_descriptor")
    return Block(kind, compressor, start - comp, orig, comp, o.fixed(1, "I")[0])


@dataclass
class Structure:
    control: list[Block]
    locked: bool
    comment: str
    recovery: str | None

    @property
    def sfx_size(self) -> int:
        return self.control[0].pos if self.control else 0


def read_structure(f: io.BufferedIOBase) -> Structure:
    """What the footer says; positions are from the file's start."""
    foot = _footer(f)
    o = _control(f, foot)
    control = []
    for _ in range(o.whole()):
        kind, compressor, back, orig, comp = o.whole(), o.text(), o.whole(), o.whole(), o.whole()
        control.append(Block(kind, compressor, foot.pos - back, orig, comp, o.fixed(1, "I")[0]))
    locked = o.take(1) == b"\1"
    comment = o.take(4 * o.whole()).decode("utf-32-le", "replace")
    recovery = o.text() if o.left() else None
    if o.left() and (n := o.whole()):
        comment = o.take(n).decode("utf-8", "replace")
    return Structure(control, locked, comment, recovery)


def read_directory(f: io.BufferedIOBase, b: Block) -> tuple[list[Block], list[tuple]]:
    """A directory's solid blocks, and its files as (dir, name, size, mtime, isdir, crc, block)."""
    o = _control(f, b)
    n = o.whole()
    counts, names = [o.whole() for _ in range(n)], [o.text() for _ in range(n)]
    back, packed = [o.whole() for _ in range(n)], [o.whole() for _ in range(n)]
    blocks = [Block(DATA, c, b.pos - p, 0, s, 0, k) for c, p, s, k in zip(names, back, packed, counts, strict=True)]
    owner = [i for i, k in enumerate(counts) for _ in range(k)]
    dirs = [o.text().replace("\\", "/") for _ in range(o.whole())]
    m = len(owner)
    name, folder, size = [o.text() for _ in range(m)], [o.whole() for _ in range(m)], [o.whole() for _ in range(m)]
    if any(d >= len(dirs) for d in folder):
        raise Damaged("bad_data")
    times, flags, crcs = o.fixed(m, "I"), o.fixed(m, "B"), o.fixed(m, "I")
    return blocks, [(dirs[folder[i]], name[i], size[i], times[i], bool(flags[i]), crcs[i], owner[i]) for i in range(m)]


def _contents(f: io.BufferedIOBase, blocks: list[Block], files: list[tuple]) -> Iterator[tuple[tuple, bytes]]:
    at = 0
    for b in blocks:
        mine = files[at : at + b.n_files]
        at += b.n_files
        total = sum(x[2] for x in mine)
        data = b""
        if total:  # directories and empty files need no reading
            f.seek(b.pos)
            data = _unpack(b.compressor, f.read(b.compsize), total)
        start = 0
        for x in mine:
            yield x, data[start : start + x[2]]
            start += x[2]


def rows(path: str, table: str, strict: bool) -> Iterator[tuple]:
    with open(path, "rb") as f:
        yield from rows_of(f, path, table, strict)


def rows_of(f: io.BufferedIOBase, path: str, table: str, strict: bool) -> Iterator[tuple]:
    try:
        s = read_structure(f)
        if table == "archives":
            yield path, s.locked, s.comment, s.recovery, s.sfx_size, len(s.control), None
        elif table == "blocks":
            for c in s.control:
                yield path, c.type, c.compressor, c.pos, c.origsize, c.compsize, c.crc, None
        seen = blocks_before = 0
        for c in s.control if table != "archives" else ():
            if c.type != DIRECTORY:
                continue
            blocks, files = read_directory(f, c)
            if table == "blocks":
                for b in blocks:
                    yield path, b.type, b.compressor, b.pos, None, b.compsize, None, b.n_files
            elif table == "files":
                for i, (folder, name, size, t, isdir, crc, k) in enumerate(files):
                    yield path, seen + i, folder, name, size, datetime.fromtimestamp(t, UTC), isdir, crc, blocks_before + k, blocks[k].compressor
            else:
                for i, (x, data) in enumerate(_contents(f, blocks, files)):
                    yield path, seen + i, x[0], x[1], x[2], x[5], zlib.crc32(data) == x[5], data
            seen, blocks_before = seen + len(files), blocks_before + len(blocks)
    except Damaged as e:
        if strict:
            raise ValueError(f"{path}: {e.args[0]}") from e
        if table == "archives":
            yield path, None, None, None, None, None, e.args[0]


def from_store(spark: SparkSession, path: str, table: str = "files", strict: bool = True) -> DataFrame:
    """The same tables of archives in any store that Spark reads: each is read whole, up to two gigabytes.

    The masks of ``path`` are Spark's; folders are searched with all below them.
    """
    schema = StructType.fromDDL(SCHEMAS[table])
    names = schema.fieldNames()
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                for row in rows_of(io.BytesIO(content.as_buffer()), name, table, strict):
                    held.append(row)
                    if len(held) == 1000 or table == "contents":
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=kinds)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


def items(spark: SparkSession, path: str) -> Iterator[tuple]:
    """A cursor over archives' files in order, a few rows on the driver at a time; closing it ends the job."""
    listed = from_store(spark, path, "files").orderBy("archive", "file_id")
    yield from listed.toLocalIterator()


class _Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str], table: str, strict: bool) -> None:
        self.paths, self.table, self.strict = paths, table, strict

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None and partition.value is not None:
            yield from rows(partition.value, self.table, self.strict)


class SolidArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "solid_archive"

    def _table(self) -> str:
        table = self.options.get("table", "files")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table}; there are {sorted(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> _Reader:
        paths = sorted(glob.glob(self.options["path"], recursive=True)) or [None]
        return _Reader(paths, self._table(), self.options.get("mode", "strict") == "strict")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SolidArchive)


def pack(blocks: Sequence[tuple[str, Sequence[tuple[str, str, int, bytes]]]], comment: str = "", locked: bool = False, prefix: bytes = b"") -> bytes:
    """An archive of solid blocks, each a chain and its files as (dir, name, mtime, content)."""

    def packed(chain: str, data: bytes) -> bytes:
        for m in chain.split("+"):
            data = CODECS[m.split(":")[0]].encode(data)
        return data

    def described(kind: int, chain: str, pos: bytes, data: bytes, size: int) -> bytes:
        return whole_number(kind) + chain.encode() + b"\0" + pos + whole_number(len(data)) + whole_number(size) + struct.pack("<I", zlib.crc32(data))

    out, places = bytearray(prefix), []
    for chain, files in blocks:
        body = packed(chain, b"".join(x[3] for x in files))
        places.append((len(out), len(body)))
        out += body
    start = len(out)
    files = [x for _, part in blocks for x in part]
    dirs = sorted({x[0] for x in files})
    text = lambda items: b"".join(t.encode() + b"\0" for t in items)
    many = lambda items: b"".join(map(whole_number, items))
    listing = whole_number(len(blocks)) + many(len(part) for _, part in blocks) + text(c for c, _ in blocks)
    listing += many(start - p for p, _ in places) + many(n for _, n in places) + whole_number(len(dirs)) + text(dirs)
    listing += text(x[1] for x in files) + many(dirs.index(x[0]) for x in files) + many(len(x[3]) for x in files)
    listing += struct.pack(f"<{len(files)}I", *(x[2] for x in files)) + bytes(len(files)) + struct.pack(f"<{len(files)}I", *(zlib.crc32(x[3]) for x in files))
    body = packed("tor", listing)
    out += body
    foot = len(out)
    note = comment.encode()
    footer = whole_number(1) + described(DIRECTORY, "tor", whole_number(foot - start), listing, len(body)) + bytes([locked]) + whole_number(0) + b"\0" + whole_number(len(note)) + note
    out += footer
    descriptor = SIGNATURE + described(FOOTER, "storing", b"", footer, len(footer))
    return bytes(out + descriptor + struct.pack("<I", zlib.crc32(descriptor)))
