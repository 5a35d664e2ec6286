"""Benchmark decontamination by winnowing.

Texts become lower-cased words; every run of ``k`` words is hashed, and of every ``window`` -
``k`` + 1 consecutive hashes the least is kept as a fingerprint. Two texts that share
``window`` words in a row share the least hash of that stretch, so joining the documents'
fingerprints with the test items' misses no shared span of that length. Each hit is then
extended: the document windows that a common fingerprint stands for are compared, word by
word as text, with the items' windows. Items shorter than a window are looked up whole.

All steps are DataFrame expressions. Each document is read once for its fingerprints, which
carry the few words around them, so no text is shuffled; what leaves the scan is the hits. The
items' fingerprints are broadcast while they are small (their bytes are summed first), else joined
by a shuffle in which every window of the items is copied to ``SALTS`` places and the documents'
are dealt over them, so that a passage in a third of all documents is no one task's. A window that
many items share is carried through the hits as the number of its set of items.

Defined results: a null text has no words; an item without words matches nothing; repeated
rows each get their result; an empty document table gives no rows, an empty benchmark gives
``n_hit`` 0 everywhere; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm._common import cut, table, text_or_empty

#: What separates words: every ASCII character that is not a lower-case letter or a digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the items' windows above which they are joined by a shuffle and not broadcast, and its salts.
MAX_BROADCAST_BYTES, SALTS = 32 << 20, 32
#: More documents with hits than this are taken out by a shuffle of the texts (16 bytes each).
MAX_BROADCAST_HITS = 1_000_000


def words(col: Column | str) -> Column:
    return F.array_remove(F.split(F.translate(text_or_empty(col), UPPER, LOWER), SEPARATORS), "")


def _part(array: str, first: str, count: str) -> str:
    """SQL for a part of an array; slice() would copy the whole array each time."""
    return f"transform(sequence({first}, {first} + ({count}) - 1), t -> get({array}, t))"


def _least_hashes(k: int, window: int) -> list[Column]:
    """From the column __w (words): __m, the least of each window's k-word hashes."""
    gram = ", ".join(["x", *(f"get(__w, i + {j})" for j in range(1, k))])
    mins = ", ".join(["x", *(f"get(__h, i + {j})" for j in range(1, window - k + 1))])
    return [
        F.expr(f"if(size(__w) < {window}, cast(array() as array<bigint>), slice(transform(__w, (x, i) -> xxhash64({gram})), 1, size(__w) - {k - 1}))").alias("__h"),
        F.expr(f"if(size(__h) = 0, __h, slice(transform(__h, (x, i) -> least({mins})), 1, size(__h) - {window - k}))").alias("__m"),
    ]


def item_windows(items: DataFrame, id_col: str, text_col: str, k: int, window: int) -> DataFrame:
    """(win, len, fp, set, items): each different window of the items, its fingerprint, and the items that have it.

    set: a hash of these items, the same for windows of the same ones.
    """
    h, m = _least_hashes(k, window)
    w = items.select(F.col(id_col).alias("__item"), words(text_col).alias("__w")).where("size(__w) > 0")
    w = w.select("*", h).select("*", m)
    # outer: else the optimizer repeats all of __m's making in a filter on its size
    long = w.where(f"size(__w) >= {window}").select("__item", "__w", F.posexplode_outer("__m").alias("__j", "fp")).where("fp is not null")
    long = long.select("__item", "fp", F.expr(f"array_join({_part('__w', '__j', str(window))}, ' ')").alias("win"), F.lit(window).alias("len"))
    short = w.where(f"size(__w) < {window}").select(
        "__item", F.expr("array_join(__w, ' ')").alias("win"), F.size("__w").alias("len")
    ).withColumn("fp", F.xxhash64("len", "win")).select("__item", "fp", "win", "len")
    wins = long.union(short).groupBy("win", "len", "fp").agg(F.sort_array(F.collect_set("__item")).alias("items"))
    return wins.withColumn("set", F.xxhash64(F.lit("items"), "items"))


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    window: int = 10,
) -> DataFrame:
    """(__id, __key, spans, items) for each document with a hit.

    spans: the sorted (start, end) word ranges of the matching windows; items: the ids of the
    items whose windows occur. __key is a hash of the text: (id, key) names a document even
    where ids repeat.
    """
    wins = cut(item_windows(items, item_id_col, item_text_col, k, window))
    held = wins.agg(F.sum(F.octet_length("win") + 48)).first()[0] or 0

    def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        if held <= MAX_BROADCAST_BYTES:
            return left.join(F.broadcast(right), on, how)
        salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = left.withColumn("__salt", F.pmod(F.xxhash64("__id", "__key", "j"), F.lit(SALTS)).cast("int"))
        return dealt.join(salted, [*on, "__salt"], how).drop("__salt")

    short = [r[0] for r in wins.where(F.col("len") < window).select("len").distinct().orderBy("len").collect()]  # under `window` rows
    h, m = _least_hashes(k, window)
    d = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(text_or_empty(text_col)).alias("__key"), words(text_col).alias("__w")
    ).select("*", h).select("*", m)
    # runs of windows with one least hash: (fp, first window, last window, the words they span)
    d = d.withColumn("__s", F.expr("if(size(__m) = 0, cast(array() as array<int>), filter(sequence(0, size(__m) - 1), i -> i = 0 or __m[i] != __m[i - 1]))"))
    runs = F.expr(
        "transform(__s, (s, i) -> named_struct('fp', __m[s], 'j', s, 'len', " + f"{window}"
        + f", 'ctx', {_part('__w', 's', f'coalesce(get(__s, i + 1), size(__m)) - s + {window - 1}')}))"
    )
    for n in short:
        runs = F.concat(runs, F.expr(
            f"if(size(__w) < {n}, cast(array() as array<struct<fp: bigint, j: int, len: int, ctx: array<string>>>), transform(sequence(0, size(__w) - {n}), "
            f"i -> named_struct('fp', xxhash64({n}, array_join({_part('__w', 'i', str(n))}, ' ')), 'j', i, 'len', {n}, 'ctx', {_part('__w', 'i', str(n))})))"
        ))
    d = d.select("__id", "__key", F.explode(runs).alias("__r")).select("__id", "__key", "__r.*")
    d = join(d, wins.select("fp").distinct(), ["fp"], "left_semi")
    d = d.select("__id", "__key", "j", "len", "ctx", F.explode(F.expr("sequence(0, size(ctx) - len)")).alias("__o"))
    d = d.select(
        "__id", "__key", "j", (F.col("j") + F.col("__o")).alias("start"), "len", F.expr("array_join(slice(ctx, __o + 1, len), ' ')").alias("win")
    )
    d = join(d, wins.select("win", "len", "set"), ["win", "len"])
    hits = d.groupBy("__id", "__key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"), F.collect_set("set").alias("sets")
    )
    # a row for each document and set of items, and its items once
    sets = wins.groupBy("set").agg(F.first("items").alias("items"))
    named = hits.select("__id", "__key", "spans", F.explode("sets").alias("set")).join(sets, "set")
    return named.groupBy("__id", "__key").agg(F.first("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) ranges."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"].cast("long"),
    )


def report(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: its number of words, the words inside item windows, and the items."""
    hits = find_hits(docs, items, id_col=id_col, text_col=text_col, **options).select(
        "__id", "__key", covered(F.col("spans")).alias("__hit"), "items"
    )
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_or_empty(text_col)).alias("__k"),
        F.size(words(text_col)).cast("long").alias("n_words"),
    )
    joined = d.join(hits, d["doc_id"].eqNullSafe(hits["__id"]) & (d["__k"] == hits["__key"]), "left")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n = F.coalesce("__hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(ids, F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a window of an item; the same columns."""
    hits = find_hits(docs, items, id_col=id_col, text_col=text_col, **options).select("__id", "__key")
    hits = cut(hits)
    hits = F.broadcast(hits) if hits.count() <= MAX_BROADCAST_HITS else hits
    key = F.xxhash64(text_or_empty(docs[text_col]))
    return docs.join(hits, docs[id_col].eqNullSafe(hits["__id"]) & (key == hits["__key"]), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS l FROM iw WHERE len(w) > 0),
ip AS (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS p FROM il),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[p + 1 : p + l], ' ') AS t FROM ip),
ls AS (SELECT DISTINCT l FROM win),
dp AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS p FROM dw, ls WHERE len(w) >= l),
dt AS (SELECT doc_id, l, p, array_to_string(w[p + 1 : p + l], ' ') AS t FROM dp),
hit AS (SELECT doc_id, p, dt.l AS l, item_id FROM dt JOIN win ON dt.t = win.t AND dt.l = win.l),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
