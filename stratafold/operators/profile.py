"""Content profiling: byte histograms, entropy, record structure and type detection.

Histograms are made in one pass per text, in Arrow batches, as (id, byte, n) rows of the bytes
that occur; everything after that is SQL on at most 256 rows for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.arrow import append


def byte_histogram(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, byte, n); null and empty texts have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, byte, n = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    c = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
                    b = np.flatnonzero(c)
                    ids.append(np.full(len(b), i))
                    byte.append(b)
                    n.append(c[b])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, byte, n)], names=["id", "byte", "n"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return picked.mapInArrow(run, "id long, byte long, n long").withColumnRenamed("id", id_col)


def order0(hist: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, total, order0): octets at the order-0 entropy, each count's share floored before the log."""
    w = Window.partitionBy(id_col)
    h = hist.withColumn("total", F.sum("n").over(w))
    bits = F.col("n") * F.log2(F.floor(F.col("total") / F.col("n")))
    return h.groupBy(id_col).agg(F.max("total").alias("total"), F.round(F.sum(bits) / 8, 3).alias("order0"))


def normal_chars(hist: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, normal_chars): of symbols by falling count, without those above a fifth of the text,
    how many make up nine tenths of the rest; 256 where none does."""
    total = F.sum("n").over(Window.partitionBy(id_col))
    h = hist.withColumn("total", total).where(5 * F.col("n") <= F.col("total"))
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "byte")
    h = h.withColumn("rest", F.sum("n").over(Window.partitionBy(id_col)))
    h = h.withColumn("acc", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order))
    return h.where(10 * F.col("acc") > 9 * F.col("rest")).groupBy(id_col).agg(F.min("k").cast("long").alias("normal_chars"))


def near_of(t: bytes) -> tuple[int, int, int]:
    """(match_bytes, matches, repeats) of greedy matches of four bytes or more at distances below 256.

    A match's source is the last place looked at, outside matches, that has the same four bytes.
    repeats: matches whose distance is one of the last four different ones. Only places whose four
    bytes stood less than 256 before at all are looked at one by one.
    """
    n = len(t) - 3
    if n < 2:
        return 0, 0, 0
    a = np.frombuffer(t, np.uint8).astype(np.uint32)
    key = a[:n] | a[1 : n + 1] << np.uint32(8) | a[2 : n + 2] << np.uint32(16) | a[3 : n + 3] << np.uint32(24)
    order = np.argsort(key, kind="stable")
    before = np.full(n, -1, np.int64)
    same = key[order][1:] == key[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    inside = bytearray(n)  # places in a match, which are no sources
    back = before.tolist()
    recent: list[int] = []
    free = covered = found = again = 0
    for at in np.flatnonzero((before >= 0) & (np.arange(n) - before < 256)).tolist():
        if at < free:
            continue
        p = back[at]
        while p >= 0 and inside[p]:
            p = back[p]
        if p < 0 or at - p >= 256:
            continue
        size, d = 4, at - p
        while at + size < len(t) and t[p + size] == t[at + size]:
            size += 1
        stop = min(at + size, n)
        inside[at + 1 : stop] = b"\1" * (stop - at - 1)
        found, covered, free = found + 1, covered + size, at + size
        if d in recent:
            again += 1
            recent.remove(d)
        recent = [d, *recent[:3]]
    return covered, found, again


def near_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, match_bytes, matches, repeats) of every text; a null one is empty."""
    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("__t"))
    kinds = [("match_bytes", "long"), ("matches", "long"), ("repeats", "long")]
    return append(picked, ["__t"], kinds, lambda t: near_of(t or b"")).drop("__t")


def type_of(t: bytes) -> str:
    """``$compressed``, ``$text`` or ``default``, by one pass over a text's counts and one over its near matches."""
    n = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    n = np.sort(n[n > 0])[::-1]
    total = len(t)
    order0 = round(float((n * np.log2(total // n)).sum()) / 8, 3) if total else None
    rest = n[5 * n <= total]
    enough = np.flatnonzero(10 * np.cumsum(rest) > 9 * rest.sum())
    normal = int(enough[0]) + 1 if len(enough) else 256
    match_bytes, matches, repeats = near_of(t)
    if order0 is not None and order0 > 0.95 * total and 10 * match_bytes < total:
        return "$compressed"
    return "$text" if 17 <= normal <= 80 and 5 * repeats < matches and 10 * match_bytes > total else "default"


def types(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, type) of every text; a null one is empty. What ``datatype`` says of the parts, in one pass."""
    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("__t"))
    return append(picked, ["__t"], [("type", "string")], lambda t: (type_of(t or b""),)).drop("__t")


def datatype(entropy: DataFrame, normal: DataFrame, near: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, type): ``$compressed``, ``$text`` or ``default``."""
    x = near.join(entropy, id_col, "left").join(normal, id_col, "left")
    n, m = F.coalesce("total", F.lit(0)), F.coalesce("normal_chars", F.lit(256))
    packed = (F.col("order0") > 0.95 * n) & (10 * F.col("match_bytes") < n)
    text = m.between(17, 80) & (5 * F.col("repeats") < F.col("matches")) & (10 * F.col("match_bytes") > n)
    return x.select(id_col, F.when(packed, "$compressed").when(text, "$text").otherwise("default").alias("type"))


def slot_histogram(df: DataFrame, value: str) -> DataFrame:
    """(slot, n, extra_bits): signed values folded to 2x or -2x-1 and counted by the octets they need.

    Extra bits are those below a value's top octet, which a slot is followed by.
    """
    v = F.col(value).cast("long")
    z = F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)
    slot = F.when(z < 1 << 8, 0).when(z < 1 << 16, 1).when(z < 1 << 24, 2).otherwise(3)
    out = df.groupBy(slot.cast("long").alias("slot")).agg(F.count("*").alias("n"))
    return out.withColumn("extra_bits", 8 * F.col("slot") * F.col("n"))
