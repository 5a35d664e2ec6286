"""Keys from passwords, and texts under them.

A key is PBKDF2 with HMAC-SHA-512 over a row's own salt; content is under AES-GCM, whose tag
tells a wrong password from a right one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITERATIONS = 1000


def derive_keys(df: DataFrame, id_col: str, salt_col: str, password: str, iterations: int = ITERATIONS, size: int = 32) -> DataFrame:
    """(id, key) of every row's salt; a null salt is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.pbkdf2_hmac("sha512", password.encode(), x or b"", iterations, size) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["id", "key"])

    picked = df.select(F.col(id_col).cast("long"), F.col(salt_col).cast("binary"))
    return picked.mapInArrow(run, "id long, key binary").withColumnRenamed("id", id_col)


def seal(data: Column, key: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("GCM"))


def unseal(data: Column, key: Column) -> Column:
    """The content; null under a wrong key."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"))


def outcome(data: Column, key: Column) -> Column:
    """``open``, ``wrong password``, or ``nothing`` where there are no data or no key."""
    return F.when(data.isNull() | key.isNull(), "nothing").when(unseal(data, key).isNull(), "wrong password").otherwise("open")
