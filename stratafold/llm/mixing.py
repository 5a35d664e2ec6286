"""Mixing sources to target weights.

Tokens (whitespace-delimited words) are summed per source, the sums are turned into target
sizes by water-filling, and the ratio target / source size is the rate at which each document
of that source is repeated: floor(rate) times, plus one copy drawn by a hash of the document's
id with probability equal to the fraction. Everything is DataFrame expressions; the only state
that is computed apart is one row per source: these rows, some 50 bytes each and no texts, are
put in order by one task, which a table with a source for nearly every document would burden.

Defined results:
* null text counts as size 0; null source is a source of its own, ordered last;
* rows that repeat an id share one draw, so a rerun or a repeated row gets the same copies;
* sources of size 0 have target 0 and rate 0 (nothing of theirs can be weighed);
* an empty table gives an empty result;
* columns beside the three named ones are carried through by ``mix_documents``, whatever
  their names: the working columns carry the prefix ``__mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm._common import WS_WORD, cut, text_or_empty

#: Sources of more bytes than this, names and numbers, are joined by a shuffle with salted keys instead of a broadcast.
MAX_BROADCAST_BYTES = 16 << 20
#: The salts that spread one hot source over tasks in that case.
SALTS = 32


def word_count(col: Column | str) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WS_WORD)).cast("long")


def draw(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) that only the id and the seed decide (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size) -> the same with ``target`` and ``rate``; one row per source.

    Sources ordered by code point, nulls last, take the weights in turn. The targets share
    ``share`` times the total by weight, none above ``cap`` times its source's size: with the
    sources ordered by cap / weight, the level is the first at which the next source is not
    yet full, which is where resharing the excess again and again ends. Past that source the
    levels only fall, so the first such level is also the greatest.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % n
    weight = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:], 1):
        weight = F.when(turn == i, F.lit(float(w))).otherwise(weight)
    full = F.lit(float(cap)) * F.col("source_size")
    one = sizes.select("source", "source_size", weight.alias("w")).withColumn("full", full)
    by_ratio = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    one = one.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(everything)
         - F.coalesce(F.sum("full").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    )
    level = F.col("left") / F.col("w_left")
    one = one.withColumn(
        "level", F.max(F.when(level <= F.col("full") / F.col("w"), level)).over(everything)
    )
    target = F.when(F.col("level").isNull(), F.col("full")).otherwise(
        F.least(F.col("full"), F.col("level") * F.col("w"))
    )
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return one.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def with_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    size: Column | None = None,
) -> DataFrame:
    """docs with __mix_source_size, __mix_target and __mix_copies for every row."""
    size = word_count(text_col) if size is None else size
    sizes = (
        docs.select(F.col(source_col).alias("source"), size.alias("size"))
        .groupBy("source")
        .agg(F.sum("size").alias("source_size"))
    )
    rates = cut(source_targets(sizes, weights, share, cap))
    rates = rates.select(*[F.col(c).alias(f"__mix_{c}") for c in rates.columns])
    held = rates.agg(F.sum(F.coalesce(F.octet_length(F.col("__mix_source").cast("string")), F.lit(0)) + 40)).first()[0] or 0
    if held <= MAX_BROADCAST_BYTES:
        joined = docs.join(F.broadcast(rates), docs[source_col].eqNullSafe(rates["__mix_source"]))
    else:
        salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int")
        left = docs.withColumn("__mix_salt", salt)
        right = rates.withColumn("__mix_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(
            right,
            left["__mix_salt"].eqNullSafe(right["__mix_salt2"])
            & left[source_col].eqNullSafe(right["__mix_source"]),
        ).drop("__mix_salt", "__mix_salt2")
    whole = F.floor("__mix_rate")
    extra = (draw(F.col(id_col), seed) < F.col("__mix_rate") - whole).cast("long")
    return joined.withColumn("__mix_copies", whole + extra).drop("__mix_source", "__mix_rate")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as the mix takes it; the same columns."""
    out = with_copies(docs, **options).where(F.col("__mix_copies") > 0)
    times = F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))
    return out.withColumn("__mix_n", times).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # one pass over the texts: their sizes are read again from the shared folder
    sized = cut(docs.select("doc_id", "source", word_count("text").alias("size")))
    return with_copies(sized, size=F.col("size")).select(
        "doc_id",
        "size",
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("size") * F.col("__mix_copies")).alias("taken"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             2.0::DOUBLE * source_size AS full_size FROM s),
l AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
               - coalesce(sum(full_size) OVER r, 0.0::DOUBLE) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER r, 0.0::DOUBLE) AS w_rest
      FROM w WINDOW r AS (ORDER BY full_size / w, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, max(CASE WHEN rest / w_rest <= full_size / w THEN rest / w_rest END) OVER () AS level FROM l),
g AS (SELECT source, source_size,
             CASE WHEN level IS NULL THEN full_size ELSE least(full_size, level * w) END AS target FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM g)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (floor(rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
                                    / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
