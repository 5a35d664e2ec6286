"""Transforms of value sequences, byte records and texts, and their inverses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.running import running_before, value_before


def diff(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str = "diff", within: Column | None = None) -> DataFrame:
    """df with the difference from the value before, the first from 0.

    within: a column that never falls along the order, by whose ranges hot keys are split.
    """
    if within is not None:
        out = value_before(df, value, keys, order, within, "_before")
        return out.withColumn(name, F.col(value) - F.coalesce("_before", F.lit(0))).drop("_before")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value, 1, 0).over(w))


def undiff(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str = "value", within: Column | None = None) -> DataFrame:
    """df with the running sum, which undoes diff; within as there."""
    if within is not None:
        return running_before(df, F.col(value), keys, order, within, name).withColumn(name, F.col(name) + F.col(value))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def wrapped_diff(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], bits: int, name: str = "diff", within: Column | None = None) -> DataFrame:
    """diff modulo 2^bits, as samples of 8, 16, 24 or 32 bits wrap."""
    out = diff(df, value, keys, order, name, within)
    return out.withColumn(name, F.pmod(F.col(name), F.lit(1 << bits)))


def array_diff(values: Column) -> Column:
    """Lag-1 differences of an array, the first value as it is."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def immutable_columns(df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = (), within: Column | None = None, width: int | None = None) -> DataFrame:
    """(column, changes, rows, immutable): a column that changes in under a quarter of the rows.

    width: octets of a record; those of 2, 4 and 8 have no immutable columns.
    """
    if within is not None:
        x = value_before(df.withColumn("_all", F.struct(*columns)), "_all", list(keys), order, within, "_before")
        flags = x.select(*[(F.col(f"_before.{c}") != F.col(c)).cast("long").alias(c) for c in columns])
    else:
        w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
        flags = df.select(*[(F.lag(c).over(w) != F.col(c)).cast("long").alias(c) for c in columns])
    sums = flags.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changes")) for c in columns])
    out = sums.select("rows", F.explode(pairs).alias("p")).select("p.column", "p.changes", "rows")
    return out.withColumn("immutable", (F.col("changes") * 4 < F.col("rows")) & F.lit(width not in (2, 4, 8)))


def chunks(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, digest, length) of each text's consecutive chunks of ``size`` characters."""
    t = F.coalesce(text_col, F.lit(""))
    n = F.ceil(F.length(t) / F.lit(size)).cast("int")
    # one regular-expression pass cuts the text; substr from the start for each chunk would cost its square
    cut = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = docs.select(F.col(id_col), F.posexplode(F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))).alias("chunk_no", "chunk"))
    return rows.select(id_col, F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("digest"), F.length("chunk").cast("long").alias("length"))


def dedup_chunks(c: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(digest, copies, length, first_id): chunks that occur more than once; a partial aggregate."""
    first = F.min(F.struct(id_col, "chunk_no"))
    out = c.groupBy("digest").agg(F.count("*").alias("copies"), F.max("length").alias("length"), first.alias("f"))
    return out.where("copies > 1").select("digest", "copies", "length", F.col(f"f.{id_col}").alias("first_id"))


def words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    split = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select(F.explode(split).alias("word"))


def top_words(docs: DataFrame, k: int, least: int = 1, text_col: str = "text", shortest: int = 1) -> DataFrame:
    """(word, n): the k most frequent words, ties by word; k is the report's size."""
    return words(docs, text_col).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(k)


# fixed values of the dictionary's rules
LARGE, MEDIUM, SMALL, RATIO = 2048, 100, 50, 4


def phrases(docs: DataFrame, longest: int = 3, text_col: str = "text") -> DataFrame:
    """(phrase, words, n) of the runs of one to ``longest`` words of a text, joined by a blank, and how often they occur."""
    split = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(split.alias("w")).where(F.size("w") > 0)

    def of(k: int) -> Column:
        starts = F.filter("w", lambda x, i: i <= F.size("w") - k)
        return F.transform(starts, lambda x, i: F.struct(F.array_join(F.slice("w", i + 1, k), " ").alias("phrase"), F.lit(k).cast("long").alias("words")))

    runs = F.concat(*[of(k) for k in range(1, longest + 1)])
    return rows.select(F.explode(runs).alias("p")).select("p.*").groupBy("phrase", "words").agg(F.count("*").alias("n"))


def promoted(counts: DataFrame, large: int = LARGE, medium: int = MEDIUM, small: int = SMALL, ratio: int = RATIO) -> DataFrame:
    """counts (phrase, words, n) that a dictionary takes, with ``parent``, the count of the phrase without its last word.

    A phrase is taken if it is frequent by itself (``large``); else one word if it has ``small``
    occurrences, and a longer phrase if it has ``medium`` and a good part, 1 / ``ratio``, of its
    parent's. Parents are at least as frequent, so phrases below the least limit are left out at once.
    """
    c = counts.where(F.col("n") > min(large, medium, small))
    parents = c.select(F.col("phrase").alias("prefix"), F.col("n").alias("parent"))
    c = c.withColumn("prefix", F.when(F.col("words") > 1, F.regexp_replace("phrase", " [^ ]*$", "")))
    both = c.join(parents, "prefix", "left")
    alone = F.col("parent").isNull() & (F.col("n") > small)
    child = (F.col("n") > medium) & (F.col("n") * ratio > F.col("parent"))
    return both.where((F.col("n") > large) | alone | child).select("phrase", "words", "n", "parent")


def xor_parity(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bit_xor(value).alias("parity"), F.count("*").alias("members"))


def rebuild(parity: DataFrame, left: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The one lost value of each group, from its parity and the values left."""
    rest = left.groupBy(*keys).agg(F.bit_xor(value).alias("rest"), F.count("*").alias("found"))
    joined = parity.join(rest, list(keys), "left").where(F.col("members") - F.coalesce("found", F.lit(0)) == 1)
    return joined.select(*keys, F.col("parity").bitwiseXOR(F.coalesce("rest", F.lit(0))).alias(value))
