"""Catalogs of files over the tables: what a file, a block and an archive are here.

A file is a row of ``documents``: directory ``lang/source``, name ``doc_id.txt``, size in
octets, CRC-32 of its bytes. Files of a directory's language, in order of their ids, fill solid
blocks of about ``limit`` octets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.running import running_before

BLOCK_LIMIT = 65536
#: Ids in one range of a running sum.
ID_SPAN = 65536


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(docs: DataFrame) -> DataFrame:
    """(file_id, dir, name, size, crc, isdir) of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "lang", "source").alias("dir"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length(text).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.lit(False).alias("isdir"),
        F.coalesce("lang", F.lit("")).alias("grp"),
        F.col("source").alias("source"),
    )


def path(dir_col: Column, name: Column) -> Column:
    """Directory and name, without a separator where there is no directory."""
    return F.when(dir_col == "", name).otherwise(F.concat_ws("/", dir_col, name))


def solid_blocks(f: DataFrame, limit: int = BLOCK_LIMIT, group: str = "grp", order: str = "file_id") -> DataFrame:
    """f with ``block``: octets before a file in its group, in units of the limit.

    ``order`` is a whole number; groups run in ranges of it.
    """
    out = running_before(f, F.col("size"), [group], [order], id_range(order), "block")
    return out.withColumn("block", F.floor(F.col("block") / F.lit(limit)).cast("long"))


def blocks_of(f: DataFrame, count: int, group: str = "grp", order: str = "file_id") -> DataFrame:
    """f with ``block``: every ``count`` files of a group."""
    out = running_before(f, F.lit(1).cast("long"), [group], [order], id_range(order), "block")
    return out.withColumn("block", F.floor(F.col("block") / F.lit(count)).cast("long"))


def id_range(order: str) -> Column:
    return F.floor(F.col(order) / F.lit(ID_SPAN))
