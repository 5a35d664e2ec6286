"""Training-data pipeline over ``documents``: five stages, each written as Parquet and reread.

Belongs to the package's llm part. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of ``documents``.

Defined results: rows with a null or empty text, or without a letter, go in the first stage, as no
language can be told; ids may be null or repeat, and a document is then named by id and text; of
rows that repeat an id and a text one is left; other columns, null or not, are carried; texts of
any length are taken whole; an empty table passes all stages empty. What stages write below the
shared folder is theirs to read once: ``run`` removes a stage's input when its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm import bitplanes, decontam, jaccard, langid, mixing
from stratafold.llm._common import remove, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be identified go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the document with the least id stays, named by id and text."""
    return jaccard.keep_heads(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as their sources' targets ask."""
    return mixing.mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids are written as bit planes; what is read back is returned.

    Workers have run the other stages before, so they are given less room than an operator of its own.
    """
    return bitplanes.tokenised(docs, cache_words=1 << 17, piece_bytes=1 << 20, release=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Language models, classes of near duplicates and token ids are beyond SQL: tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
    # the last stage has written its files: nothing reads the documents before it any more
    remove(spark, before)
    return docs
