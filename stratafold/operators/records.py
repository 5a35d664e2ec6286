"""Byte records: their detection, planes, differences with carry, sorts by context, block bounds.

Works on one block's bytes at a time, with numpy, inside Arrow maps; ``over`` applies a function
to a binary column. Blocks bound the memory; a text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the record test and of the adaptive blocks
GAIN_2, GAIN_4 = 0.93, 0.95
FIRST_BLOCK, LEAST_STEP, WORSE = 24 * 1024, 256, 1.25
LZP_FLAG = b"\xb5"


def over(df: DataFrame, id_col: str, data_col: str, f: Callable[[bytes], object], out: str, kind: str) -> DataFrame:
    """(id, out) with ``f`` of each row's bytes; null data is empty data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [f(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, types[kind])], names=["id", out])

    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    picked = df.select(F.col(id_col).cast("long"), F.col(data_col).cast("binary"))
    return picked.mapInArrow(run, f"id long, {out} {kind}").withColumnRenamed("id", id_col)


def _cost(data: np.ndarray, phases: int) -> float:
    """Order-0 cost of the phases of the bytes, in units of log10."""
    total = 0.0
    for p in range(phases):
        n = np.bincount(data[p::phases], minlength=256)
        n = n[n > 0]
        total -= float((n * np.log10(phases * n / len(data))).sum())
    return total


def _zigzag_steps(v: np.ndarray, width: int) -> np.ndarray:
    """Wrapped differences, folded so that small ones of both signs are small."""
    step = np.diff(v, prepend=v.dtype.type(0)).astype(v.dtype)
    sign = (step >> (8 * width - 1)).astype(bool)
    return np.where(sign, (~step << 1) | 1, step << 1).astype(v.dtype)


def record_kind(data: bytes) -> int:
    """0 no records, 1 and 2 records of two and four octets, 3 and 4 the same where differences pay."""
    if not data:
        return 0
    a = np.frombuffer(data, np.uint8)
    best, kind = GAIN_2 * _cost(a, 1), 0
    if (two := _cost(a, 2)) < best:
        best, kind = GAIN_4 * two, 1
    if _cost(a, 4) < best:
        kind = 2
    if kind:
        width = 2 * kind
        v = np.frombuffer(data, f"<u{width}", len(data) // width)
        steps = int(_zigzag_steps(v, width).astype(np.uint64).sum())
        if len(v) and int(v.astype(np.uint64).sum()) - int(v.min()) * len(v) > steps + steps // 16:
            kind += 2
    return kind


def to_planes(data: bytes, kind: int) -> bytes:
    """Octets by their place in a record; kinds 3 and 4 take differences first, high octets in front."""
    if kind in (1, 2):
        return b"".join(data[p :: 2 * kind] for p in range(2 * kind))
    if kind in (3, 4):
        width = 2 * (kind - 2)
        n = len(data) // width
        steps = _zigzag_steps(np.frombuffer(data, f"<u{width}", n), width)
        return steps.astype(f">u{width}").view(np.uint8).reshape(n, width).T.tobytes() + data[n * width :]
    return data


def from_planes(data: bytes, kind: int) -> bytes:
    if kind in (1, 2):
        width, out, at = 2 * kind, np.empty(len(data), np.uint8), 0
        a = np.frombuffer(data, np.uint8)
        for p in range(width):
            n = len(out[p::width])
            out[p::width] = a[at : at + n]
            at += n
        return out.tobytes()
    if kind in (3, 4):
        width = 2 * (kind - 2)
        n = len(data) // width
        z = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(f">u{width}").ravel().astype(f"<u{width}")
        steps = np.where(z & 1, ~(z >> 1), z >> 1).astype(z.dtype)
        return np.cumsum(steps, dtype=z.dtype).tobytes() + data[n * width :]
    return data


def table_diff(data: bytes, width: int, diffed: Sequence[bool]) -> bytes:
    """Rows of ``width`` octets less the row before; adjacent diffed columns are one little-endian number."""
    n = len(data) // width
    a = np.frombuffer(data, np.uint8, n * width).reshape(n, width).astype(np.int16)
    out, borrow = a.copy(), np.zeros(max(n - 1, 0), np.int16)
    for c in range(width):
        if diffed[c] and n > 1:
            d = a[1:, c] - a[:-1, c] - borrow
            borrow = (d < 0).astype(np.int16)
            out[1:, c] = d & 255
        else:
            borrow[:] = 0
    return out.astype(np.uint8).tobytes() + data[n * width :]


def table_undiff(data: bytes, width: int, diffed: Sequence[bool]) -> bytes:
    n = len(data) // width
    out = np.frombuffer(data, np.uint8, n * width).reshape(n, width).astype(np.int64)
    carry = np.zeros(n, np.int64)
    for c in range(width):
        if diffed[c]:
            s = np.cumsum(out[:, c]) + carry
            out[:, c], carry = s & 255, s >> 8
        else:
            carry[:] = 0
    return out.astype(np.uint8).tobytes() + data[n * width :]


def column_roles(data: bytes, width: int) -> list[bool]:
    """Which columns to diff: all but those that change in under a quarter of the rows, which only
    widths other than 2, 4 and 8 have."""
    n = len(data) // width
    a = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    changes = (a[1:] != a[:-1]).sum(axis=0)
    return [width in (2, 4, 8) or 4 * int(k) >= n for k in changes]


def table_encode(data: bytes, width: int) -> tuple[list[bool], bytes]:
    """Column roles, then the still columns' octets row by row, the diffed ones' and what is left over."""
    roles = column_roles(data, width)
    n = len(data) // width
    a = np.frombuffer(table_diff(data, width, roles), np.uint8, n * width).reshape(n, width)
    still = np.array(roles) == 0
    return roles, a[:, still].tobytes() + a[:, ~still].tobytes() + data[n * width :]


def table_decode(roles: Sequence[bool], data: bytes, width: int) -> bytes:
    n = len(data) // width
    still = np.array(roles) == 0
    k, out = int(still.sum()) * n, np.empty((n, width), np.uint8)
    a = np.frombuffer(data, np.uint8, n * width)
    out[:, still], out[:, ~still] = a[:k].reshape(n, int(still.sum())), a[k:].reshape(n, int((~still).sum()))
    return table_undiff(out.tobytes() + data[n * width :], width, roles)


def block_bounds(data: bytes) -> list[int]:
    """Ends of blocks: a block goes on while the next window costs at most a quarter more under the
    block's counts than under its own; a window that costs more is halved, down to a least step."""
    a, ends, start = np.frombuffer(data, np.uint8), [], 0
    while start < len(a):
        size = _block_size(a[start:])
        start += size
        ends.append(start)
    return ends


def _block_size(a: np.ndarray) -> int:
    if len(a) <= FIRST_BLOCK:
        return len(a)
    seen, at, step = np.bincount(a[:FIRST_BLOCK], minlength=256), FIRST_BLOCK, FIRST_BLOCK // 2
    while at + step < len(a):
        n = np.bincount(a[at : at + step], minlength=256)
        occurs = n > 0
        k, halved = n[occurs], seen[occurs] // 2
        own = -(k * np.log10(k / step)).sum()
        under = -(k * np.log10((k + halved) / (step + at // 2))).sum()
        if under <= WORSE * own:
            seen, at = seen + n, at + step
        elif step < LEAST_STEP:
            return at
        else:
            step //= 2
    return len(a)


def rotation_sort(data: bytes, depth: int | None = None) -> np.ndarray:
    """Starts of the cyclic rotations in order of their first ``depth`` octets (whole if None); ties by start."""
    n = len(data)
    order, rank = np.arange(n), np.frombuffer(data, np.uint8).astype(np.int64)
    known = 1
    while n:
        if depth is not None and known > depth:
            raise ValueError("depth must be a power of two")
        order = np.argsort(rank, kind="stable")
        if known == depth or known >= n:
            break
        both = rank * (int(rank.max()) + 1) + np.roll(rank, -known)
        rank, known = np.unique(both, return_inverse=True)[1].astype(np.int64), 2 * known
    return order


def sorted_by_context(data: bytes, depth: int | None = None) -> bytes:
    """The octet before each rotation, in the rotations' order: with no depth the Burrows-Wheeler transform."""
    a = np.frombuffer(data, np.uint8)
    return a[rotation_sort(data, depth) - 1].tobytes() if data else b""


def unsorted(last: bytes, row: int) -> bytes:
    """The text whose whole rotations sort to ``last``, it being the rotation at place ``row``."""
    a = np.frombuffer(last, np.uint8)
    follow, out = np.argsort(a, kind="stable"), bytearray()
    for _ in range(len(a)):
        row = follow[row]
        out.append(a[row])
    return bytes(out)


def chunk_hashes(a: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` octets (a power of two) at every place: halves are combined, then doubled."""
    h, m, base = a.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while m < length:
        h = h[:-m] * np.uint64(base) + h[m:]
        base, m = (base * base + 2) % (1 << 64), 2 * m
    return h


def far_matches(data: bytes, least: int = 32) -> list[tuple[int, int, int]]:
    """(at, source, length): long repeats of earlier octets, any distance back, found by the hashes of
    aligned chunks of half the least length and extended both ways; matches do not overlap."""
    length = 1 << (max(least, 4).bit_length() - 2)
    a = np.frombuffer(data, np.uint8)
    if len(a) < 2 * length:
        return []
    h = chunk_hashes(a, length)
    starts = np.arange(0, len(h), length)
    keys, first = np.unique(h[starts], return_index=True)
    place = np.searchsorted(keys, h).clip(max=len(keys) - 1)
    source = starts[first][place]
    out, done = [], 0
    for at in np.flatnonzero((keys[place] == h) & (source < np.arange(len(h)))):
        s, at = int(source[at]), int(at)
        if at < done or data[s : s + length] != data[at : at + length]:
            continue
        n = length
        while at + n < len(data) and data[s + n] == data[at + n]:
            n += 1
        while at > done and s > 0 and data[s - 1] == data[at - 1]:
            at, s, n = at - 1, s - 1, n + 1
        if n >= least:
            out.append((at, s, n))
            done = at + n
    return out


def rep_encode(data: bytes, least: int = 32) -> bytes:
    """(literals, match length, distance) after (literals' length); numbers of eight octets would be waste: four."""
    out, at = bytearray(), 0
    for start, source, n in [*far_matches(data, least), (len(data), len(data), 0)]:
        out += (start - at).to_bytes(4, "little") + n.to_bytes(4, "little") + (start - source).to_bytes(4, "little") + data[at:start]
        at = start + n
    return bytes(out)


def rep_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        literals, n, back = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (0, 4, 8))
        out += data[at + 12 : at + 12 + literals]
        at += 12 + literals
        while n:  # a match may run into itself
            part = out[len(out) - back : len(out) - back + min(n, back)]
            out += part
            n -= len(part)
    return bytes(out)


def wav_header(data: bytes) -> list[int] | None:
    """[channels, bits, offset of the samples] of a RIFF WAVE file, over any chunks before its samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"fmt " and size >= 16 and at + 24 <= len(data):
            form = [int.from_bytes(data[at + 10 : at + 12], "little"), int.from_bytes(data[at + 22 : at + 24], "little")]
        if kind == b"data":
            return None if form is None else [*form, at + 8]
        at += 8 + size + size % 2
    return None


def lzp_encode(data: bytes, least: int = 8) -> bytes:
    """Octets, each run that repeats what last followed the four octets before it as a flag and a length."""
    out, seen, at = bytearray(), {}, 0
    while at < len(data):
        source, n = _predicted(data, at, seen), 0
        if source is not None:
            while at + n < len(data) and n < 65535 and data[source + n] == data[at + n]:
                n += 1
        if n >= least:
            out += LZP_FLAG + n.to_bytes(2, "little")
            at += n
        else:
            out += data[at : at + 1]
            if data[at] == LZP_FLAG[0]:  # a length of 0 marks the octet itself
                out += b"\0\0"
            at += 1
    return bytes(out)


def lzp_decode(data: bytes) -> bytes:
    out, seen, at = bytearray(), {}, 0
    while at < len(data):
        source = _predicted(out, len(out), seen)
        n = int.from_bytes(data[at + 1 : at + 3], "little") if data[at] == LZP_FLAG[0] else -1
        if n <= 0:
            out += data[at : at + 1]
            at += 3 if n == 0 else 1
        else:
            for k in range(source, source + n):
                out.append(out[k])
            at += 3
    return bytes(out)


def _predicted(data: bytes | bytearray, at: int, seen: dict[bytes, int]) -> int | None:
    """Where the last four octets stood before; notes them."""
    if at < 4:
        return None
    context = bytes(data[at - 4 : at])
    source, seen[context] = seen.get(context), at
    return source


# --- tables of byte records ------------------------------------------------------------------

# fixed values of the search for tables
WIDEST, LINE, REPEATS, SHORT_RUN = 30, 32, 5, 4
LEAST_WORTH, SKIP_WORTH = 30, 4


def _bits(v: np.ndarray) -> np.ndarray:
    """Places of the highest one bit of 1 + |v|."""
    return np.log2(1 + np.abs(v)).astype(np.int64)


def monotone_runs(v: np.ndarray) -> np.ndarray:
    """Steps between successive values by the run they belong to, from 0: a run goes on in one direction or stands still."""
    sign = np.sign(np.diff(v.astype(np.int64)))
    at = np.where(sign != 0, np.arange(len(sign)), -1)
    last = np.maximum.accumulate(at) if len(at) else at
    direction = np.where(last >= 0, sign[last], 0)
    turn = np.zeros(len(sign), bool)
    turn[1:] = (direction[1:] != direction[:-1]) & (direction[:-1] != 0)
    return np.cumsum(turn)


def table_rows(v: np.ndarray) -> tuple[int, int]:
    """(rows, useful ones) of the table that the values begin: it ends where two runs in a row are short.

    A row is useful where the step is written in fewer bits than the value, whose tenth bit and above count one less.
    """
    if len(v) < 2:
        return 0, 0
    run = monotone_runs(v)
    short = np.bincount(run) < SHORT_RUN
    bad = np.flatnonzero(short[1:] & short[:-1])
    rows = int(np.searchsorted(run, bad[0])) if len(bad) else len(run)
    step, value = _bits(np.diff(v.astype(np.int64)))[:rows], _bits(v[1 : rows + 1])
    value = value - (value > 10)
    return rows, int((step < value).sum())


def find_tables(data: bytes) -> list[tuple[int, int, int]]:
    """(start, width, rows) of tables of records of 2 to 30 octets, which do not overlap.

    A line of octets proposes the distances at which more than ``REPEATS`` high halves of an octet
    come again; from each of that many places the table's length is measured both ways. It counts
    if its useful rows are worth the octets skipped before it.
    """
    a = np.frombuffer(data, np.uint8)
    out: list[tuple[int, int, int]] = []
    if len(a) < 4 * WIDEST:
        return out
    order = np.argsort(a >> 4, kind="stable")
    back = np.full(len(a), 1 << 30)
    same = (a[order][1:] >> 4) == (a[order][:-1] >> 4)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    pairs = a[:-1].astype(np.int64) | (a[1:].astype(np.int64) << 8)
    done = at = 0
    while at + LINE + 4 * WIDEST < len(a):
        far = back[at : at + LINE]
        counts = np.bincount(far[far <= WIDEST], minlength=WIDEST + 1)
        best = None
        for width in np.flatnonzero(counts > REPEATS):
            if width < 2:
                continue
            for start in range(at, at + int(width)):
                before, _ = table_rows(pairs[done : start + 1][::-1][::width])
                first = start - before * int(width)
                rows, useful = table_rows(pairs[first::width])
                if useful * width**0.5 > LEAST_WORTH + SKIP_WORTH * np.log2(max(first - done, 1)) and (best is None or useful * width > best[0]):
                    best = (useful * width, first, int(width), rows)
        if best is None:
            at += LINE
        else:
            _, first, width, rows = best
            rows = min(rows, (len(a) - first) // width)
            out.append((first, width, rows))
            done = first + rows * width
            at = max(at + LINE, done)
    return out


def tables_encode(data: bytes) -> bytes:
    """Tables as differences with their still columns in front, after a list of (skip, width, rows, columns to diff)."""
    found, head, body, done = find_tables(data), bytearray(), bytearray(), 0
    for start, width, rows in found:
        roles, packed = table_encode(data[start : start + rows * width], width)
        mask = sum(1 << i for i, r in enumerate(roles) if r)
        head += (start - done).to_bytes(4, "little") + bytes([width]) + rows.to_bytes(4, "little") + mask.to_bytes(4, "little")
        body += data[done:start] + packed
        done = start + rows * width
    return len(found).to_bytes(4, "little") + bytes(head) + bytes(body) + data[done:]


def tables_decode(data: bytes) -> bytes:
    n = int.from_bytes(data[:4], "little")
    at, out = 4 + 13 * n, bytearray()
    for i in range(n):
        h = data[4 + 13 * i : 17 + 13 * i]
        skip, width, rows, mask = int.from_bytes(h[:4], "little"), h[4], int.from_bytes(h[5:9], "little"), int.from_bytes(h[9:], "little")
        out += data[at : at + skip]
        at += skip
        out += table_decode([bool(mask >> k & 1) for k in range(width)], data[at : at + rows * width], width)
        at += rows * width
    return bytes(out + data[at:])


def rec_encode(data: bytes) -> bytes:
    """The record filter as a codec: its kind, then the planes."""
    kind = record_kind(data)
    return bytes([kind]) + to_planes(data, kind)


def rec_decode(data: bytes) -> bytes:
    return from_planes(data[1:], data[0]) if data else b""
