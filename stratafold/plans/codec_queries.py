"""Further queries over codecs, records and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.arrow import append
from stratafold.operators import codecs as C
from stratafold.operators import records as R
from stratafold.operators import samples as M
from stratafold.operators import transforms as T
from stratafold.plans.queries import _REC, _files, _records, _round_trip, query
from stratafold.sources import catalog as K

_BACK_SQL = f"WITH {_REC} SELECT block, upper(string_agg(printf('%02x', octet), '' ORDER BY pos)) AS data, true AS changed FROM o GROUP BY block"


def _trip(spark, d, chain: str) -> DataFrame:
    x = _round_trip(_records(spark, d), "data", chain)
    return x.select("block", F.hex("back").alias("data"), "changed")


@query(_BACK_SQL)
def table_roundtrip(spark, d):
    """Blocks of records through the search for tables and back."""
    return _trip(spark, d, "table")


@query(_BACK_SQL)
def signal_roundtrip(spark, d):
    return _trip(spark, d, "mm")


@query(_BACK_SQL)
def record_roundtrip(spark, d):
    return _trip(spark, d, "rec+tor")


@query(f"""WITH {_REC}, s AS (SELECT block, k, sign(v - before) AS s FROM r WHERE k > 0), z AS (SELECT block, k, s, lag(s) OVER (PARTITION BY block ORDER BY k) AS before FROM s WHERE s <> 0),
t AS (SELECT block, CAST(1 + count(*) FILTER (WHERE s <> before) AS BIGINT) AS runs FROM z GROUP BY block)
SELECT DISTINCT r.block, CASE WHEN t.runs IS NOT NULL THEN t.runs WHEN n.n > 1 THEN 1 ELSE 0 END AS runs FROM r LEFT JOIN t ON r.block = t.block JOIN (SELECT block, count(*) AS n FROM r GROUP BY block) n ON r.block = n.block""")
def monotone_runs(spark, d):
    """Runs of one direction among a block's records."""

    def runs(data):
        run = R.monotone_runs(M.words(data, 4))
        return (int(run[-1]) + 1 if len(run) else 0,)

    return append(_records(spark, d), ["data"], [("runs", "long")], runs).select("block", "runs")


@query()
def model_costs(spark, d):
    """The model that costs least on each text's sample."""
    sample = F.substring(F.col("text").cast("binary"), 1, M.sample_size(1 << 30, True))
    x = K.load(spark, d, "documents").select("doc_id", sample.alias("x"))
    return append(x, ["x"], [("model", "string")], lambda x: [(m,) for m in M.cheapest_each(b or b"" for b in x)], together=True).drop("x")


_PLAN = {"$text": "dict+lzma", "$compressed": "storing", "default": "rep+lzma"}


@query("""WITH x AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 5 = 0 THEN '$compressed' WHEN doc_id % 2 = 0 THEN '$text' ELSE 'default' END AS type, CASE WHEN lang = 'en' THEN '$text' ELSE '$exe' END AS grp FROM documents)
SELECT file_id, CASE type WHEN '$compressed' THEN 'storing' WHEN '$text' THEN 'dict+lzma' ELSE 'rep+lzma' END AS by_content, CASE grp WHEN '$text' THEN 'dict+lzma' ELSE 'rep+lzma' END AS by_group FROM x""")
def codec_plan(spark, d):
    """Chains by the content's type, and by the group file where detection is off."""
    f = K.load(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    kind = F.when(F.col("file_id") % 5 == 0, "$compressed").when(F.col("file_id") % 2 == 0, "$text").otherwise("default")
    x = f.select("file_id", kind.alias("type"), F.when(F.col("lang") == "en", "$text").otherwise("$exe").alias("group"))
    on = C.plan(x, _PLAN).withColumnRenamed("chain", "by_content")
    return C.plan(on, _PLAN, detect=False, fast=False).select("file_id", "by_content", F.col("chain").alias("by_group"))


@query("""WITH w AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase, CAST(k AS BIGINT) AS words FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
c AS (SELECT phrase, words, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY phrase, words HAVING count(*) > 50),
j AS (SELECT c.*, q.n AS parent FROM c LEFT JOIN c q ON c.words > 1 AND q.phrase = regexp_replace(c.phrase, ' [^ ]*$', ''))
SELECT phrase, words, n, parent FROM j WHERE n > 2048 OR (parent IS NULL AND n > 50) OR (n > 100 AND n * 4 > parent)""")
def dict_phrases(spark, d):
    """Words and phrases that a dictionary takes."""
    return T.promoted(T.phrases(K.load(spark, d, "documents")))


@query("""WITH f AS (SELECT doc_id AS file_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents)
SELECT file_id, CAST(least(size, greatest(65536, least(size, 1048576) // 2)) AS BIGINT) AS slow, CAST(least(size, 65536) AS BIGINT) AS fast FROM f""")
def sample_sizes(spark, d):
    """Octets that detection looks at."""
    return append(_files(spark, d).select("file_id", "size"), ["size"], [("slow", "long"), ("fast", "long")], lambda n: (M.sample_size(n), M.sample_size(n, True))).drop("size")
