"""Every query of the engine over the tables, with the SQL that must give the same rows."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions import scalars as S
from stratafold.functions.running import running_before
from stratafold.functions import script as L
from stratafold.functions.arrow import append
from stratafold.operators import archive as A
from stratafold.operators import codecs as C
from stratafold.operators import dictionary as D
from stratafold.operators import profile as P
from stratafold.operators import records as R
from stratafold.operators import samples as M
from stratafold.operators import secrets as E
from stratafold.operators import transforms as T
from stratafold.sources import catalog as K
from stratafold.sources import text_sources as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: SQL of the catalog, of its solid blocks and of their packed sizes.
_F = """f AS (SELECT doc_id AS file_id, concat_ws('/', lang, source) AS dir, doc_id || '.txt' AS name,
  CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, coalesce(lang, '') AS grp, source FROM documents)"""
_B = _F + """, b AS (SELECT *, CAST(floor((CAST(sum(size) OVER (PARTITION BY grp ORDER BY file_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size) / 65536) AS BIGINT) AS block FROM f)"""
_K = _B + """, k AS (SELECT grp, block, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size) AS BIGINT) AS orig_size,
  CAST(floor(sum(size) / 3) + 16 AS BIGINT) AS packed_size FROM b GROUP BY grp, block)"""
_P = _K + """, p AS (SELECT b.*, CASE WHEN file_id = min(file_id) OVER (PARTITION BY grp, block) THEN packed_size ELSE 0 END AS packed
  FROM b JOIN k USING (grp, block) WHERE source <> 'src3')"""


def _day():
    """Ranges of the events' order, by which a hot user is split."""
    return F.col("ts").cast("date")


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]


def _line_range():
    """Ranges of the lines' order, by which a hot supplier is split."""
    return F.floor(F.col("l_orderkey") / 65536)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(spark, d) -> DataFrame:
    return K.files(K.load(spark, d, "documents"))


def _blocks(spark, d) -> DataFrame:
    return K.solid_blocks(_files(spark, d))


# --- listings --------------------------------------------------------------------------------


@query(f"WITH {_P} SELECT dir || '/' || name AS path, size, packed, block FROM p")
def list_verbose(spark, d):
    """The listing without one source: a block's packed size goes to its first listed file."""
    b = _blocks(spark, d)
    listed = A.attribute_packed(b.where("source <> 'src3'"), A.packed_blocks(b).select("grp", "block", "packed_size"))
    return A.full_path(listed).select("path", "size", "packed", "block")


@query(f"WITH {_P} SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS size, CAST(sum(packed) AS BIGINT) AS packed FROM p")
def list_totals(spark, d):
    return list_verbose(spark, d).agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("packed").alias("packed"))


@query(f"WITH {_F} SELECT name, size FROM f")
def list_short(spark, d):
    return _files(spark, d).select("name", "size")


@query(f"WITH {_K} SELECT CAST((SELECT count(DISTINCT dir) FROM f) AS BIGINT) AS dirs, CAST(sum(n_files) AS BIGINT) AS files, CAST(sum(orig_size) AS BIGINT) AS size, CAST(sum(packed_size) AS BIGINT) AS packed, CAST(count(*) AS BIGINT) AS solid_blocks, CAST(floor(sum(orig_size) / count(*)) AS BIGINT) AS mean_block FROM k")
def archive_info(spark, d):
    b = _blocks(spark, d)
    k = A.packed_blocks(b).agg(
        F.sum("n_files").alias("files"), F.sum("orig_size").alias("size"), F.sum("packed_size").alias("packed"), F.count("*").alias("solid_blocks")
    )
    dirs = b.select("dir").distinct().agg(F.count("*").alias("dirs"))
    return dirs.join(F.broadcast(k)).select("dirs", "files", "size", "packed", "solid_blocks", F.floor(F.col("size") / F.col("solid_blocks")).alias("mean_block"))


@query(f"WITH {_F} SELECT DISTINCT regexp_extract(dir || '/' || name, '[^:/\\\\]*$') AS name FROM f")
def extract_flat_names(spark, d):
    return A.full_path(_files(spark, d)).select(S.base_name(F.col("path")).alias("name")).distinct()


@query(f"WITH {_B}, m AS (SELECT grp, block, max(file_id) AS last FROM b WHERE file_id % 7 = 0 GROUP BY grp, block) SELECT file_id, block, file_id % 7 = 0 AS accepted FROM b JOIN m USING (grp, block) WHERE file_id <= last")
def extract_until(spark, d):
    return A.extract_until(_blocks(spark, d), F.col("file_id") % 7 == 0).select("file_id", "block", "accepted")


@query(f"WITH {_K} SELECT grp, block, n_files > 1 AS solid FROM k")
def solid_flag(spark, d):
    return A.packed_blocks(_blocks(spark, d)).select("grp", "block", (F.col("n_files") > 1).alias("solid"))


@query("SELECT event_type, max(ts) AS latest FROM events GROUP BY event_type")
def latest_time(spark, d):
    return K.load(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("latest"))


@query(f"WITH {_B} SELECT grp, block, min(file_id) AS first_file, max(file_id) AS last_file, CAST(sum(count(*)) OVER (PARTITION BY grp ORDER BY block ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM b GROUP BY grp, block")
def block_bounds(spark, d):
    """A block's files and the running number of files: block b owns [previous, upto)."""
    return A.block_bounds(_blocks(spark, d)).select("grp", "block", "first_file", "last_file", "upto")


@query(f"WITH {_F} SELECT file_id, d.dir_id, f.dir FROM f JOIN (SELECT dir, CAST(row_number() OVER (ORDER BY dir) AS BIGINT) AS dir_id FROM (SELECT DISTINCT dir FROM f)) d USING (dir)")
def dir_lookup(spark, d):
    """Files with the number of their directory in the dictionary of directories."""
    f = _files(spark, d)
    dirs = f.select("dir").distinct()
    # ranges of the dictionary by its first letters
    numbered = running_before(dirs, F.lit(1).cast("long"), [], ["dir"], F.substring("dir", 1, 4), "dir_id")
    return f.join(numbered, "dir").select("file_id", (F.col("dir_id") + 1).alias("dir_id"), "dir")


@query(f"WITH {_F} SELECT CAST(count(*) FILTER (WHERE size = 0) AS BIGINT) AS empty, CAST(count(*) FILTER (WHERE size > 0) AS BIGINT) AS stored FROM f")
def zero_size_split(spark, d):
    return _files(spark, d).agg(F.count_if(F.col("size") == 0).alias("empty"), F.count_if(F.col("size") > 0).alias("stored"))


# --- predicates ------------------------------------------------------------------------------


@query("SELECT page_id, url FROM pages WHERE url GLOB '*.html' OR url GLOB '*/en/??'")
def mask_include(spark, d):
    return K.load(spark, d, "pages").where(S.matches(F.col("url"), ["*.html", "*/en/??"])).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE NOT (url GLOB '*.html' OR url GLOB '*[#]top')")
def mask_exclude(spark, d):
    return K.load(spark, d, "pages").where(~S.matches(F.col("url"), ["*.html", "*#top"])).select("page_id", "url")


@query(f"WITH {_F} SELECT file_id, size FROM f WHERE size BETWEEN 1024 AND 10240")
def size_range(spark, d):
    return _files(spark, d).where(F.col("size").between(1024, 10240)).select("file_id", "size")


@query(f"WITH {_F} SELECT file_id, name FROM f WHERE name IN (SELECT item_id || '.txt' FROM benchmark)")
def name_semi(spark, d):
    """Files whose base name is one of a table of names."""
    names = K.load(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("wanted"))
    f = _files(spark, d)
    return f.join(names, S.base_name(f["name"]) == names["wanted"], "left_semi").select("file_id", "name")


@query(f"WITH {_F} SELECT file_id FROM f WHERE NOT (name GLOB '1*')")
def invert_select(spark, d):
    return _files(spark, d).where(~S.matches(F.col("name"), ["1*"])).select("file_id")


_CHAINS = ("lzma:64mb:normal:32", "dict:p+lzp:64m:65:d1m:s16:h20:90+ppmd:8:192m", "aes-256/ctr:n1000:r0", "rep:96mb+lzma+aes-128", "delta+tor:5+serpent-192", "storing")


def _chains(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in _CHAINS], "chain string")


_CHAIN_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in _CHAINS) + ") AS v(chain)"


@query(f"SELECT chain, regexp_matches(chain, '(^|[+])(aes|blowfish|serpent|twofish)([-:+]|$)') AS exact, regexp_matches(chain, '[+](aes|blowfish|serpent|twofish)-') AS quick FROM {_CHAIN_SQL}")
def encrypted_flags(spark, d):
    return _chains(spark).select("chain", S.is_encrypted(F.col("chain")).alias("exact"), S.encrypted_by_substring(F.col("chain")).alias("quick"))


# --- set operations --------------------------------------------------------------------------

_OLD = "o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey AS BIGINT) AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "n AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey + o_orderkey % 5 - 2 AS BIGINT) AS mtime, CAST(floor(o_totalprice) + 1 AS BIGINT) AS size FROM orders WHERE o_orderkey % 4 <> 0)"


def _old_new(spark, d) -> tuple[DataFrame, DataFrame]:
    o = K.load(spark, d, "orders")
    path, size = F.col("o_orderkey").cast("string").alias("path"), F.floor("o_totalprice").cast("long")
    old = o.where("o_orderkey % 3 <> 0").select(path, F.col("o_custkey").cast("long").alias("mtime"), size.alias("size"))
    new = o.where("o_orderkey % 4 <> 0").select(path, (F.col("o_custkey") + F.col("o_orderkey") % 5 - 2).cast("long").alias("mtime"), (size + 1).alias("size"))
    return old, new


def _update_sql(keep: str, take: str) -> str:
    return f"""WITH {_OLD}, {_NEW}, j AS (SELECT coalesce(o.path, n.path) AS path, o.mtime AS om, n.mtime AS nm, o.size AS os, n.size AS ns FROM o FULL JOIN n ON o.path = n.path),
t AS (SELECT *, {take} AS take FROM j WHERE {keep})
SELECT path, CASE WHEN take THEN nm ELSE om END AS mtime, CASE WHEN take THEN ns ELSE os END AS size,
  CASE WHEN take AND om IS NOT NULL THEN 'updated' WHEN take THEN 'added' ELSE 'kept' END AS action FROM t"""


@query(_update_sql("true", "nm IS NOT NULL"))
def update_replace(spark, d):
    return A.update(*_old_new(spark, d), "replace")


@query(_update_sql("true", "nm IS NOT NULL AND (om IS NULL OR nm > om)"))
def update_newer(spark, d):
    return A.update(*_old_new(spark, d), "newer")


@query(_update_sql("om IS NOT NULL", "nm IS NOT NULL AND nm > om"))
def freshen(spark, d):
    return A.update(*_old_new(spark, d), "freshen")


@query(_update_sql("nm IS NOT NULL", "om IS NULL OR nm > om"))
def sync(spark, d):
    return A.update(*_old_new(spark, d), "sync")


@query(f"WITH {_OLD}, {_NEW}, u AS (SELECT *, 0 AS archive FROM o UNION ALL SELECT *, 1 FROM n) SELECT path, mtime, size, archive FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY archive DESC) = 1")
def join_archives(spark, d):
    return A.join_archives(list(_old_new(spark, d))).select("path", "mtime", "size", "archive")


@query(f"WITH {_OLD}, {_NEW} SELECT path, size FROM o WHERE path NOT IN (SELECT path FROM n)")
def delete_anti(spark, d):
    old, new = _old_new(spark, d)
    return old.join(new, "path", "left_anti").select("path", "size")


@query("SELECT DISTINCT url FROM pages UNION SELECT source FROM documents")
def filelist_dedup(spark, d):
    return K.load(spark, d, "pages").select("url").union(K.load(spark, d, "documents").select("source")).distinct()


@query(f"WITH {_F} SELECT file_id, coalesce(source, '') NOT IN ('src1', 'src3') AS applied FROM f")
def lock_guard(spark, d):
    """Changes to the sources' archives, of which two are locked."""
    f = _files(spark, d).withColumn("archive", F.coalesce("source", F.lit("")))
    archives = f.select("archive").distinct().withColumn("locked", F.col("archive").isin("src1", "src3"))
    return A.guard(f, archives).select("file_id", "applied")


@query(f"WITH {_OLD}, {_NEW} SELECT o.path, CASE WHEN n.path IS NULL THEN 'create' WHEN o.mtime > n.mtime THEN 'replace' ELSE 'keep' END AS action FROM o LEFT JOIN n ON o.path = n.path")
def extract_update(spark, d):
    """What an extraction that updates older files does to each path."""
    return A.extract_plan(*_old_new(spark, d), "update").select("path", "action")


@query(f"WITH {_OLD} SELECT path, size FROM o WHERE mtime > 500")
def backup_differential(spark, d):
    return A.backup(_old_new(spark, d)[0], "differential", F.lit(500), F.lit(900)).select("path", "size")


@query(f"WITH {_B} SELECT grp, block, CASE WHEN bool_or(file_id % 50 = 0) THEN 'repack' ELSE 'copy' END AS action FROM b GROUP BY grp, block")
def recompress_smart(spark, d):
    b = _blocks(spark, d)
    return A.recompress(b, A.packed_blocks(b), F.col("file_id") % 50 == 0, "smart").select("grp", "block", "action")


@query(f"WITH {_P} SELECT lpad(CAST(size AS VARCHAR), 12, ' ') || lpad(CAST(packed AS VARCHAR), 12, ' ') || ' ' || dir || '/' || name AS line FROM p")
def listing_text(spark, d):
    return list_verbose(spark, d).select(A.listing_line(F.col("size"), F.col("packed"), F.col("path")).alias("line"))


@query("SELECT event_type || '-' || strftime(ts, '%Y%m%d') || '.arc' AS archive, CAST(count(*) AS BIGINT) AS files FROM events GROUP BY 1")
def archive_by_date(spark, d):
    """Separate archives, their names with the date of what they hold."""
    name = F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyyMMdd"), F.lit(".arc"))
    return K.load(spark, d, "events").groupBy(name.alias("archive")).agg(F.count("*").alias("files"))


# --- orders and blocks -----------------------------------------------------------------------


@query(f"WITH {_F} SELECT file_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY grp, regexp_extract(name, '[.]([^.:/\\\\]*)$', 1), name, file_id) AS BIGINT) AS pos FROM f")
def sort_gen(spark, d):
    return A.ranked(_files(spark, d), "gen").select("file_id", "pos")


@query(f"WITH {_F} SELECT file_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY grp, regexp_extract(name, '[.]([^.:/\\\\]*)$', 1), size, file_id) AS BIGINT) AS pos FROM f")
def sort_ges(spark, d):
    return A.ranked(_files(spark, d), "ges").select("file_id", "pos")


@query(f"WITH {_B} SELECT file_id, grp, block FROM b")
def solid_by_bytes(spark, d):
    return _blocks(spark, d).select("file_id", "grp", "block")


@query(f"WITH {_F} SELECT file_id, grp, CAST(floor((row_number() OVER (PARTITION BY grp ORDER BY file_id) - 1) / 10) AS BIGINT) AS block FROM f")
def solid_by_count(spark, d):
    return K.blocks_of(_files(spark, d), 10).select("file_id", "grp", "block")


@query("SELECT CASE WHEN regexp_extract(url, '[.]([a-z]+)$', 1) = '' THEN 'none' ELSE regexp_extract(url, '[.]([a-z]+)$', 1) END AS ext, CAST(count(*) AS BIGINT) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS size FROM pages GROUP BY 1")
def solid_by_ext(spark, d):
    e = F.regexp_extract("url", r"\.([a-z]+)$", 1)
    p = K.load(spark, d, "pages").select(F.when(e == "", "none").otherwise(e).alias("ext"), F.octet_length("html").cast("long").alias("size"))
    return p.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


_GROUPS = ["; comment", "$html", "*.html", "*/e?/*", "$ref", "*ref=x*", "$anchor", "*#*", "$default"]


@query("SELECT page_id, CASE WHEN lower(url) GLOB '*.html' OR lower(url) GLOB '*/e?/*' THEN '$html' WHEN contains(lower(url), 'ref=x') THEN '$ref' WHEN contains(url, '#') THEN '$anchor' ELSE '$default' END AS type FROM pages")
def group_assign(spark, d):
    return A.first_matching_mask(K.load(spark, d, "pages"), X.parse_group_lines(_GROUPS), "url").select("page_id", "type")


# --- profiles --------------------------------------------------------------------------------


@query("SELECT doc_id, byte, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, CAST(('0x' || h[2 * i + 1 : 2 * i + 2]) AS BIGINT) AS byte FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, unnest(range(octet_length(encode(coalesce(text, ''))))) AS i FROM documents)) GROUP BY ALL")
def byte_histogram(spark, d):
    return P.byte_histogram(K.load(spark, d, "documents"))


_H = """h AS (SELECT doc_id, byte, count(*) AS n FROM (SELECT doc_id, h[2 * i + 1 : 2 * i + 2] AS byte FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, unnest(range(octet_length(encode(coalesce(text, ''))))) AS i FROM documents)) GROUP BY ALL),
ht AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM h)"""


@query(f"WITH {_H} SELECT doc_id, CAST(max(total) AS BIGINT) AS total, round(sum(n * log2(floor(total / n))) / 8, 3) AS order0 FROM ht GROUP BY doc_id")
def order0_entropy(spark, d):
    return P.order0(P.byte_histogram(K.load(spark, d, "documents")))


@query(f"WITH {_H}, r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS rest, sum(n) OVER w AS acc, row_number() OVER w AS k FROM ht WHERE 5 * n <= total WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, byte ROWS UNBOUNDED PRECEDING)), m AS (SELECT doc_id, min(k) AS k FROM r WHERE 10 * acc > 9 * rest GROUP BY doc_id) SELECT doc_id, CAST(coalesce(k, 256) AS BIGINT) AS normal_chars FROM documents LEFT JOIN m USING (doc_id)")
def normal_chars(spark, d):
    docs = K.load(spark, d, "documents")
    n = P.normal_chars(P.byte_histogram(docs))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("normal_chars", F.lit(256)).cast("long").alias("normal_chars"))


@query()
def datatype_detect(spark, d):
    return P.types(K.load(spark, d, "documents"))


@query("WITH v AS (SELECT CAST(l_orderkey AS BIGINT) - coalesce(lag(CAST(l_orderkey AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate), 0) AS x FROM lineitem), z AS (SELECT CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS z FROM v) SELECT CAST(CASE WHEN z < 256 THEN 0 WHEN z < 65536 THEN 1 WHEN z < 16777216 THEN 2 ELSE 3 END AS BIGINT) AS slot, CAST(count(*) AS BIGINT) AS n, CAST(8 * slot * count(*) AS BIGINT) AS extra_bits FROM z GROUP BY 1")
def slot_histogram(spark, d):
    li = K.load(spark, d, "lineitem").withColumn("v", F.col("l_orderkey").cast("long"))
    return P.slot_histogram(T.diff(li, "v", ["l_suppkey"], _LINE_ORDER, within=_line_range()), "diff")


@query("""WITH a AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, embedding FROM embeddings),
c AS (SELECT vec_id, lag_n, CAST(floor((embedding[i] - CASE WHEN i > lag_n THEN embedding[i - lag_n] ELSE 0 END) * 16) AS BIGINT) AS q FROM a, (VALUES (1), (2), (4)) v(lag_n)),
s AS (SELECT vec_id, lag_n, sum(abs(q)) AS cost FROM c GROUP BY ALL)
SELECT vec_id, CAST(lag_n AS BIGINT) AS channels FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cost, lag_n) = 1""")
def mm_grid_best(spark, d):
    """Of 1, 2 or 4 interleaved channels the one whose quantised differences are least."""
    e = K.load(spark, d, "embeddings")

    def cost(k: int):
        v = F.col("embedding")
        step = F.transform(v, lambda x, i: F.abs(F.floor((x - F.when(i >= k, F.get(v, i - k)).otherwise(F.lit(0.0).cast("float"))) * 16)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    best = F.array_min(F.array(*[F.struct(cost(k).alias("c"), F.lit(k).cast("long").alias("k")) for k in (1, 2, 4)]))
    return e.select("vec_id", best["k"].alias("channels"))


# --- transforms ------------------------------------------------------------------------------


@query("WITH c AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?s).{1,64}')) AS x FROM documents) SELECT md5(x) AS digest, CAST(count(*) AS BIGINT) AS copies, CAST(max(length(x)) AS BIGINT) AS length, min(doc_id) AS first_id FROM c GROUP BY 1 HAVING count(*) > 1")
def chunk_dedup(spark, d):
    return T.dedup_chunks(T.chunks(K.load(spark, d, "documents"), 64))


@query("SELECT md5(coalesce(text, '')) AS digest, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, d):
    g = K.load(spark, d, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return g.where("copies > 1")


@query("SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS diff FROM events")
def delta_events(spark, d):
    return T.diff(K.load(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], within=_day()).select("event_id", F.round("diff", 6).alias("diff"))


@query("SELECT event_id, round(value, 6) AS value FROM events")
def undelta_events(spark, d):
    e = T.diff(K.load(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], within=_day()).drop("value")
    return T.undiff(e, "diff", ["user_id"], ["ts", "event_id"], within=_day()).select("event_id", F.round("value", 6).alias("value"))


@query("WITH x AS (SELECT lag(l_linenumber) OVER w <> l_linenumber AS a, lag(l_returnflag) OVER w <> l_returnflag AS b, lag(l_linestatus) OVER w <> l_linestatus AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate)), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c FROM x) SELECT v.name AS \"column\", CAST(v.k AS BIGINT) AS changes, CAST(n AS BIGINT) AS rows, v.k * 4 < n AS immutable FROM s, LATERAL (VALUES ('l_linenumber', s.a), ('l_returnflag', s.b), ('l_linestatus', s.c)) v(name, k)")
def column_immutable(spark, d):
    return T.immutable_columns(K.load(spark, d, "lineitem"), ["l_linenumber", "l_returnflag", "l_linestatus"], _LINE_ORDER, ["l_suppkey"], within=_line_range())


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(CAST(embedding[i] AS DOUBLE) - CASE WHEN i > 1 THEN CAST(embedding[i - 1] AS DOUBLE) ELSE 0 END, 6) AS diff FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)")
def embedding_diff(spark, d):
    e = K.load(spark, d, "embeddings").select("vec_id", F.posexplode(T.array_diff(F.col("embedding").cast("array<double>"))).alias("i", "diff"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.round("diff", 6).alias("diff"))


@query("SELECT item_id, coalesce(planes, '') AS planes FROM benchmark LEFT JOIN (SELECT item_id, upper(string_agg(h[2 * i + 1 : 2 * i + 2], '' ORDER BY i % 4, i)) AS planes FROM (SELECT item_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM benchmark) GROUP BY item_id) USING (item_id)")
def byte_transpose(spark, d):
    """The octets of a text by their place modulo 4."""
    octets = F.regexp_extract_all(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lit(".."), F.lit(0))

    def plane(k: int):
        return F.array_join(F.filter(octets, lambda x, i: i % 4 == k), "")

    planes = F.concat(*[plane(k) for k in range(4)])
    return K.load(spark, d, "benchmark").select("item_id", planes.alias("planes"))


@query("SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 50 ORDER BY n DESC, word LIMIT 250")
def dict_topk(spark, d):
    return T.top_words(K.load(spark, d, "documents"), 250, 50)


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents), t AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 50 ORDER BY count(*) DESC, word LIMIT 250) SELECT doc_id, CAST(sum(CASE WHEN t.word IS NULL THEN octet_length(encode(w.word)) + 1 ELSE 2 END) AS BIGINT) AS encoded FROM w LEFT JOIN t ON w.word = t.word GROUP BY doc_id")
def dict_encode_size(spark, d):
    """Octets of a text's words if those of the dictionary take two and others their own and a space."""
    docs = K.load(spark, d, "documents")
    top = T.top_words(docs, 250, 50).select(F.col("word").alias("known"))
    split = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    w = docs.select("doc_id", F.explode(split).alias("word")).join(F.broadcast(top), F.col("word") == F.col("known"), "left")
    return w.groupBy("doc_id").agg(F.sum(F.when(F.col("known").isNull(), F.octet_length("word") + 1).otherwise(2)).cast("long").alias("encoded"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(((l_partkey - coalesce(lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate), 0)) % 65536 + 65536) % 65536 AS BIGINT) AS diff FROM lineitem")
def wrapped_diff16(spark, d):
    x = T.wrapped_diff(K.load(spark, d, "lineitem"), "l_partkey", ["l_suppkey"], _LINE_ORDER, 16, within=_line_range())
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "diff")


@query("""WITH o AS (SELECT item_id AS doc_id, i AS pos, CAST(('0x' || h[2 * i - 1 : 2 * i]) AS BIGINT) >> 4 AS k FROM (SELECT item_id, h, unnest(generate_series(1, length(h) // 2)) AS i FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark))),
g AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(pos - lag(pos) OVER (PARTITION BY doc_id, k ORDER BY pos) AS BIGINT) AS far FROM o)
SELECT doc_id, pos, CASE WHEN far <= 30 THEN far END AS distance FROM g""")
def repeat_distance(spark, d):
    """How far back, up to 30 octets, an octet of the same high half last stood."""
    octets = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))
    b = K.load(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(octets).alias("p", "o"))
    far = F.col("p") - F.lag("p").over(Window.partitionBy("doc_id", F.substring("o", 1, 1)).orderBy("p"))
    return b.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), far.cast("long").alias("far")).select("doc_id", "pos", F.when(F.col("far") <= 30, F.col("far")).alias("distance"))


# --- scalars ---------------------------------------------------------------------------------

_MEM = ("64mb", "512", "24", "8k", "=1g", "20^", "x", "", "100b", "3kb")
_MEM_SQL = "(VALUES " + ", ".join(f"('{m}')" for m in _MEM) + ") AS v(t)"


@query(f"SELECT t, CAST(CASE WHEN NOT regexp_matches(t, '^=?[0-9]+([bkmg^]|$)') THEN NULL WHEN u = 'b' THEN n WHEN u = 'k' THEN n * 1024 WHEN u = 'm' THEN n * 1048576 WHEN u = 'g' THEN n * 1073741824 WHEN n < 63 THEN pow(2, n) END AS BIGINT) AS octets FROM (SELECT t, TRY_CAST(regexp_extract(t, '^=?([0-9]+)', 1) AS BIGINT) AS n, regexp_extract(t, '^=?[0-9]+([bkmg^]?)', 1) AS u FROM {_MEM_SQL})")
def parse_mem(spark, d):
    return spark.createDataFrame([(m,) for m in _MEM], "t string").select("t", S.parse_mem(F.col("t")).alias("octets"))


@query("SELECT x, CASE WHEN x % 1073741824 = 0 THEN x // 1073741824 || 'gb' WHEN x % 1048576 = 0 THEN x // 1048576 || 'mb' WHEN x % 1024 = 0 THEN x // 1024 || 'kb' ELSE x || 'b' END AS shown FROM (SELECT CAST(ps_size AS BIGINT) * 512 AS x FROM (SELECT DISTINCT p_size AS ps_size FROM part UNION SELECT 0 UNION SELECT 4194304))")
def show_mem(spark, d):
    p = K.load(spark, d, "part").select("p_size").union(spark.createDataFrame([(0,), (4194304,)], "p_size int")).distinct()
    return p.select((F.col("p_size").cast("long") * 512).alias("x")).select("x", S.show_mem(F.col("x")).alias("shown"))


@query(f"SELECT chain, CAST(k - 1 AS BIGINT) AS k, split_part(m, ':', 1) AS name, CAST(len(string_split(m, ':')) - 1 AS BIGINT) AS params FROM (SELECT chain, string_split(chain, '+')[k] AS m, k FROM (SELECT chain, unnest(generate_series(1, len(string_split(chain, '+')))) AS k FROM {_CHAIN_SQL}))")
def method_parse(spark, d):
    m = _chains(spark).select("chain", F.posexplode(S.methods(F.col("chain"))).alias("k", "m"))
    return m.select("chain", F.col("k").cast("long").alias("k"), "m.name", F.size("m.params").cast("long").alias("params"))


@query("""WITH t AS (SELECT p_partkey, ['lzma', 'rep', 'lzp', 'ppmd', 'storing'][1 + p_partkey % 5] AS name, CAST(p_size AS BIGINT) * 1048576 AS m, 10 + p_size % 10 AS hash_bits FROM part)
SELECT p_partkey, name, CAST(CASE name WHEN 'lzma' THEN m * 9 + 1048576 WHEN 'rep' THEN m + 4 * pow(2, hash_bits) WHEN 'lzp' THEN 2 * m + 8 * pow(2, hash_bits) WHEN 'ppmd' THEN m ELSE 0 END AS BIGINT) AS encode,
  CAST(CASE name WHEN 'lzma' THEN m + 1048576 WHEN 'rep' THEN m WHEN 'lzp' THEN 2 * m + 8 * pow(2, hash_bits) WHEN 'ppmd' THEN m ELSE 0 END AS BIGINT) AS decode, CAST(least(m, 33554432) AS BIGINT) AS limited FROM t""")
def codec_memory(spark, d):
    """Memory of methods, and their dictionary when limited to 32 MB."""
    name = F.element_at(F.array(*map(F.lit, ("lzma", "rep", "lzp", "ppmd", "storing"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    t = K.load(spark, d, "part").select("p_partkey", name.alias("name"), (F.col("p_size").cast("long") * 1048576).alias("m"), (10 + F.col("p_size") % 10).alias("bits"))
    encode, decode = S.method_memory(F.col("name"), F.col("m"), F.col("bits"))
    return t.select("p_partkey", "name", encode.alias("encode"), decode.alias("decode"), F.least("m", F.lit(33554432).cast("long")).alias("limited"))


_MACROS = {"#x": "rep:#mb+ccm", "ccm": "lzma:#", "best": "dict+5x", "b#": "grzip:#"}


@query("SELECT * FROM (VALUES ('3x', 'rep:3mb+lzma:#'), ('best', 'dict+rep:5mb+lzma:#'), ('b8+storing', 'grzip:8+storing'), ('tor', 'tor')) AS v(name, chain)")
def alias_resolve(spark, d):
    return spark.createDataFrame([(n, X.resolve_macro(n, _MACROS)) for n in ("3x", "best", "b8+storing", "tor")], "name string, chain string")


@query("SELECT p_partkey, upper(p_name) AS up, reverse(p_name) AS rev, CAST(octet_length(encode(p_name)) AS BIGINT) AS len, substr(p_name, length(p_name) - 2) AS tail, repeat(substr(p_name, 1, 2), 3) AS rep, CAST(ascii(p_name) AS BIGINT) AS byte, CAST(strpos(p_name, 'a') AS BIGINT) AS find, regexp_replace(p_name, '[aeiou]', '_', 'g') AS gsub FROM part")
def lua_string_fns(spark, d):
    n = F.col("p_name")
    return K.load(spark, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.reverse(n).alias("rev"), F.octet_length(n).cast("long").alias("len"), F.substr(n, F.length(n) - 2).alias("tail"),
        F.repeat(F.substr(n, F.lit(1), F.lit(2)), F.lit(3)).alias("rep"), F.ascii(n).cast("long").alias("byte"), F.instr(n, "a").cast("long").alias("find"), F.regexp_replace(n, "[aeiou]", "_").alias("gsub"),
    )


@query("SELECT event_id, round(abs(value), 6) AS a, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c, round(sqrt(abs(value)), 6) AS s, round(value - floor(value / 7) * 7, 6) AS m, round(degrees(value), 6) AS deg, round(sin(value), 6) AS sn, greatest(value, 10.0::DOUBLE) AS mx FROM events")
def lua_math_fns(spark, d):
    v = F.col("value")
    return K.load(spark, d, "events").select(
        "event_id", F.round(F.abs(v), 6).alias("a"), F.floor(v).alias("f"), F.ceil(v).alias("c"), F.round(F.sqrt(F.abs(v)), 6).alias("s"),
        F.round(S.floored_mod(v, F.lit(7)), 6).alias("m"), F.round(F.degrees(v), 6).alias("deg"), F.round(F.sin(v), 6).alias("sn"), F.greatest(v, F.lit(10.0)).alias("mx"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def format_time(spark, d):
    return K.load(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"))


# --- integrity -------------------------------------------------------------------------------


#: CRC-32 of the list of octets x: a table of 256 values, then one look-up an octet.
_CRC_TABLE = "[list_reduce([CAST(v AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) for v in range(256)]"


def _crc_sql(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295)"


_OCTETS = "list_transform(range(octet_length(encode({0}))), lambda i: CAST(('0x' || hex(encode({0}))[2 * i + 1 : 2 * i + 2]) AS BIGINT))"


@query(f"""WITH c AS MATERIALIZED (SELECT {_CRC_TABLE} AS t), d AS (SELECT doc_id AS file_id, coalesce(text, '') AS x FROM documents WHERE doc_id % 100 = 7)
SELECT file_id, CAST({_crc_sql(_OCTETS.format("x"))} AS BIGINT) AS crc, CAST({_crc_sql(_OCTETS.format("(x || '!')"))} AS BIGINT) AS now FROM d, c""")
def integrity_test(spark, d):
    """Files whose content no longer has its CRC: here every 100th was altered."""
    f = K.load(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("x"))
    read = F.when(F.col("file_id") % 100 == 7, F.concat("x", F.lit("!"))).otherwise(F.col("x"))
    f = f.select("file_id", F.crc32(F.col("x").cast("binary")).alias("crc"), F.crc32(read.cast("binary")).alias("now"))
    return f.where("now <> crc")


@query("SELECT o_orderstatus, bit_xor(o_orderkey) AS parity, CAST(count(*) AS BIGINT) AS members FROM orders GROUP BY 1")
def xor_parity(spark, d):
    return T.xor_parity(K.load(spark, d, "orders"), ["o_orderstatus"], "o_orderkey")


@query("SELECT g, o_custkey FROM (SELECT o_orderkey // 8 AS g, o_custkey, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def parity_rebuild(spark, d):
    """The first value of every group of keys, rebuilt from the parity and the others."""
    o = K.load(spark, d, "orders").withColumn("g", F.expr("o_orderkey div 8"))
    first = F.row_number().over(Window.partitionBy("g").orderBy("o_orderkey")) == 1
    left = o.withColumn("lost", first).where("not lost")
    return T.rebuild(T.xor_parity(o, ["g"], "o_custkey"), left, ["g"], "o_custkey")


@query("SELECT doc_id, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5 FROM documents")
def hash_digests(spark, d):
    t = F.coalesce("text", F.lit("")).cast("binary")
    return K.load(spark, d, "documents").select("doc_id", F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"))


@query("SELECT item_id, md5(text) AS md5, CAST(octet_length(encode(text)) + 28 AS BIGINT) AS sealed FROM benchmark")
def encrypt_roundtrip(spark, d):
    """Texts through AES-GCM and back; sealed, they are longer by a nonce and a tag."""
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    b = K.load(spark, d, "benchmark").withColumn("sealed", F.aes_encrypt("text", key, F.lit("GCM")))
    back = F.aes_decrypt("sealed", key, F.lit("GCM"))
    return b.select("item_id", F.md5(back).alias("md5"), F.octet_length("sealed").cast("long").alias("sealed"))


# --- codecs ----------------------------------------------------------------------------------


@query()
def codec_ratio(spark, d):
    """One scan: each text goes through all chains in its task."""
    docs = K.load(spark, d, "documents").select(F.col("text").cast("binary").alias("x"))
    chains = ("storing", "tor", "delta+tor", "grzip")

    def sizes(x):
        out = [len(x or b"")]
        for c in chains:
            y = x or b""
            for m in c.split("+"):
                y = C.CODECS[m].encode(y)
            out.append(min(len(y), out[0]))
        return tuple(out)

    names = ["orig", *(f"c{i}" for i in range(len(chains)))]
    total = append(docs, ["x"], [(n, "long") for n in names], sizes).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(c).alias("chain"), F.col("orig").alias("orig_size"), F.col(f"c{i}").alias("comp_size")) for i, c in enumerate(chains)])
    return total.select(F.explode(rows).alias("r")).select("r.*")


def _round_trip(df: DataFrame, data: str, chain: str) -> DataFrame:
    """df with what the chain makes of its data, in place of them: ``data`` anew, ``packed`` octets and ``changed``."""
    codecs = [C.CODECS[m.split(":")[0]] for m in chain.split("+")]

    def there_and_back(x):
        y = x = x or b""
        for c in codecs:
            y = c.encode(y)
        n, changed = len(y), y != x
        for c in reversed(codecs):
            y = c.decode(y)
        return y, n, changed

    return append(df.withColumn(data, F.col(data).cast("binary")), [data], [("back", "binary"), ("packed", "long"), ("changed", "boolean")], there_and_back)


_TRIP_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS md5, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS octets, true AS changed FROM documents"


@query(_TRIP_SQL)
def chain_roundtrip(spark, d):
    """Every whole text through a chain, which alters it, and back."""
    x = _round_trip(K.load(spark, d, "documents").select("doc_id", "text"), "text", "delta+lzma")
    return x.select("doc_id", F.md5("back").alias("md5"), F.octet_length("back").cast("long").alias("octets"), "changed")


@query(_TRIP_SQL)
def rep_roundtrip(spark, d):
    """Every whole text through the coder of long repeats and back."""
    x = _round_trip(K.load(spark, d, "documents").select("doc_id", "text"), "text", "rep+grzip")
    return x.select("doc_id", F.md5("back").alias("md5"), F.octet_length("back").cast("long").alias("octets"), "changed")


#: The nine chains of a stress test, each packing files by themselves and in solid blocks.
STRESS = ("storing", "delta", "lzp", "rep", "tor", "grzip", "lzma", "exe", "delta+tor")


@query(f"WITH {_B}, c AS (SELECT unnest([{', '.join(repr(c) for c in STRESS)}]) AS chain) SELECT chain, solid, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS octets, CAST(0 AS BIGINT) AS damaged, CAST(CASE WHEN solid THEN count(DISTINCT (grp, block)) ELSE count(*) END AS BIGINT) AS streams FROM b, c, (VALUES (true), (false)) v(solid) GROUP BY chain, solid")
def codec_stress(spark, d):
    """Nine chains over all files, solid or not: every file is cut from its unpacked stream and its CRC tested."""
    files = _blocks(spark, d).join(K.load(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")), "file_id")
    one = F.struct("file_id", "crc", "data")
    # a solid block is bounded by its octets
    solid = files.groupBy("grp", "block").agg(F.sort_array(F.collect_list(one)).alias("files")).select(F.lit(True).alias("solid"), "files")
    streams = solid.union(files.select(F.lit(False), F.array(one)))

    def test(members):
        x = b"".join(m["data"] for m in members)
        bad = []
        for chain in STRESS:
            y = x
            for m in chain.split("+"):
                y = C.CODECS[m].encode(y)
            for m in reversed(chain.split("+")):
                y = C.CODECS[m].decode(y)
            at = n = 0
            for m in members:
                n += zlib.crc32(y[at : at + len(m["data"])]) != m["crc"]
                at += len(m["data"])
            bad.append(n + (at != len(y)))
        return bad, len(members), len(x)

    done = append(streams, ["files"], [("bad", "array<long>"), ("n", "long"), ("octets", "long")], test)
    each = done.select("solid", "n", "octets", F.posexplode("bad").alias("i", "damaged"))
    out = each.groupBy("solid", "i").agg(F.sum("n").alias("files"), F.sum("octets").alias("octets"), F.sum("damaged").alias("damaged"), F.count("*").alias("streams"))
    return out.select(F.element_at(F.array(*map(F.lit, STRESS)), F.col("i") + 1).alias("chain"), "solid", "files", "octets", "damaged", "streams")


# --- byte records ----------------------------------------------------------------------------

#: Blocks of 64 order keys; a block's records are its lines' part keys, four octets each.
_REC = """r AS (SELECT l_orderkey // 64 AS block, CAST(l_partkey AS BIGINT) AS v, row_number() OVER w - 1 AS k, CAST(lag(l_partkey) OVER w AS BIGINT) AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey // 64 ORDER BY l_orderkey, l_linenumber, l_partkey)),
o AS (SELECT block, 4 * k + j AS pos, (v >> (8 * j)) & 255 AS octet FROM r, (VALUES (0), (1), (2), (3)) x(j))"""


def _records(spark, d) -> DataFrame:
    """(block, data): at most some hundred lines a block."""
    rows = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    h = F.transform(rows, lambda r: F.lpad(F.hex(r["l_partkey"].cast("long")), 8, "0"))
    little = F.transform(h, lambda x: F.concat(*[F.substring(x, p, 2) for p in (7, 5, 3, 1)]))
    return K.load(spark, d, "lineitem").groupBy(F.expr("l_orderkey div 64").alias("block")).agg(F.unhex(F.array_join(little, "")).alias("data"))


@query(f"""WITH {_REC}, t AS (SELECT block, 4 * count(*) AS n, sum(v) AS total, min(v) AS least, count(*) AS m,
  sum(CASE WHEN v >= coalesce(before, 0) THEN 2 * (v - coalesce(before, 0)) ELSE 2 * (before - v) - 1 END) AS steps FROM r GROUP BY block),
e AS (SELECT block, p, sum(-c * log10(1.0 * p * c / n)) AS cost FROM (SELECT block, p, pos % p AS phase, octet, count(*) AS c FROM o, (VALUES (1), (2), (4)) q(p) GROUP BY ALL) JOIN t USING (block) GROUP BY block, p),
s AS (SELECT block, max(cost) FILTER (WHERE p = 1) AS e1, max(cost) FILTER (WHERE p = 2) AS e2, max(cost) FILTER (WHERE p = 4) AS e4 FROM e GROUP BY block)
SELECT block, CAST(CASE WHEN e4 < CASE WHEN e2 < 0.93 * e1 THEN 0.95 * e2 ELSE 0.93 * e1 END THEN CASE WHEN total - least * m > steps + steps // 16 THEN 4 ELSE 2 END
  WHEN e2 < 0.93 * e1 THEN 1 ELSE 0 END AS BIGINT) AS kind FROM s JOIN t USING (block)""")
def record_kind(spark, d):
    return R.over(_records(spark, d), "block", "data", R.record_kind, "kind", "long")


@query(f"WITH {_REC} SELECT block, upper(string_agg(CASE WHEN x < 0 THEN printf('%08x', x + 4294967296) ELSE printf('%08x', x) END, '' ORDER BY k)) AS diff FROM (SELECT block, k, v - coalesce(before, 0) AS x FROM r) GROUP BY block")
def table_diff(spark, d):
    """Differences of the records with carry between their octets, shown with the high octet first."""
    x = R.over(_records(spark, d), "block", "data", lambda b: R.table_diff(b, 4, [True] * 4), "diff", "binary")
    numbers = F.transform(F.regexp_extract_all(F.hex("diff"), F.lit("........"), F.lit(0)), lambda h: F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]))
    return x.select("block", F.array_join(numbers, "").alias("diff"))


_TURNS = "t AS (SELECT item_id, i, h, n, (h || h)[2 * i + 1 : 2 * i + 2 * n] AS turn FROM (SELECT item_id, h, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS i FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)))"


@query(f"WITH {_TURNS} SELECT item_id, coalesce(sorted, '') AS sorted FROM benchmark LEFT JOIN (SELECT item_id, upper(string_agg(turn[-2:], '' ORDER BY turn, i)) AS sorted FROM t GROUP BY item_id) USING (item_id)")
def bwt_items(spark, d):
    x = R.over(K.load(spark, d, "benchmark"), "item_id", "text", R.sorted_by_context, "sorted", "binary")
    return x.select("item_id", F.hex("sorted").alias("sorted"))


@query(f"WITH {_TURNS} SELECT item_id, coalesce(sorted, '') AS sorted FROM benchmark LEFT JOIN (SELECT item_id, upper(string_agg(turn[-2:], '' ORDER BY turn[1:8], i)) AS sorted FROM t GROUP BY item_id) USING (item_id)")
def context4_items(spark, d):
    x = R.over(K.load(spark, d, "benchmark"), "item_id", "text", lambda b: R.sorted_by_context(b, 4), "sorted", "binary")
    return x.select("item_id", F.hex("sorted").alias("sorted"))


@query()
def block_bounds_adaptive(spark, d):
    """Ends of the blocks into which a whole text's changing statistics cut it."""
    return R.over(K.load(spark, d, "documents"), "doc_id", "text", R.block_bounds, "ends", "array<long>")


# --- chains, streams, scripts ----------------------------------------------------------------


@query("SELECT * FROM (VALUES ('lzma:64mb:normal:32', 67108864::BIGINT, 'lzma:32mb:normal:32'), ('rep:96mb+lzma:8mb+storing', 109051904::BIGINT, 'rep:32mb+lzma:8mb+storing'), ('delta', 0::BIGINT, 'delta')) v(chain, memory, limited)")
def chain_limits(spark, d):
    t = spark.createDataFrame([("lzma:64mb:normal:32",), ("rep:96mb+lzma:8mb+storing",), ("delta",)], "chain string")
    return t.select("chain", S.chain_memory(F.col("chain")).alias("memory"), S.limit_memory(F.col("chain"), 32 << 20).alias("limited"))


@query("SELECT o_orderkey, CAST(ceil(CAST(o_orderkey AS DECIMAL(18,0)) * 0.5 / 100) AS BIGINT) AS half_percent, CAST(65536 AS BIGINT) AS fixed FROM orders")
def recovery_sizes(spark, d):
    size = F.col("o_orderkey").cast("decimal(18,0)")
    return K.load(spark, d, "orders").select("o_orderkey", S.recovery_size(F.lit("0.5%"), size).alias("half_percent"), S.recovery_size(F.lit("64kb"), size).alias("fixed"))


@query("SELECT item_id, 'tor:5' AS method, md5(text) AS payload FROM benchmark")
def stream_roundtrip(spark, d):
    b = K.load(spark, d, "benchmark").withColumn("s", S.to_stream(F.lit("tor:5"), F.encode("text", "UTF-8")))
    return b.select("item_id", S.stream_method(F.col("s")).alias("method"), F.md5(S.stream_payload(F.col("s"))).alias("payload"))


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z0-9]+)://([^/]+)', 2) AS host, regexp_replace(url, '([A-Za-z]+)([0-9])', '\\2\\1', 'g') AS swapped, regexp_extract_all(url, '[0-9]+') AS numbers, substr(url, 2, length(url) - 2) AS inner_part FROM pages")
def script_patterns(spark, d):
    u = F.col("url")
    p = K.load(spark, d, "pages")
    return p.select("page_id", F.coalesce(L.match(u, "^%w+://([^/]+)"), F.lit("")).alias("host"), L.gsub(u, "(%a+)(%d)", "%2%1").alias("swapped"), L.gmatch(u, "%d+").alias("numbers"), L.sub(u, 2, -2).alias("inner_part"))


@query("SELECT event_id, trunc(value) AS whole, round(value - trunc(value), 6) AS rest, round(value, 6) AS back, CAST(TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS DOUBLE) AS number FROM events")
def script_numbers(spark, d):
    v = F.col("value")
    return K.load(spark, d, "events").select(
        "event_id", L.modf(v)["whole"].alias("whole"), F.round(L.modf(v)["rest"], 6).alias("rest"),
        F.round(L.ldexp(L.frexp(v)["m"], L.frexp(v)["e"]), 6).alias("back"), L.tonumber(L.match(F.col("props"), "%d+")).alias("number"),
    )


# --- signals, dictionaries, passwords --------------------------------------------------------


@query()
def mm_detect(spark, d):
    """[channels, bits, offset] of each block of records that looks like a sampled signal."""
    return R.over(_records(spark, d), "block", "data", M.detect, "signal", "array<long>")


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, true AS smaller FROM documents")
def dict_roundtrip(spark, d):
    """Every whole text through a dictionary of 250 words and back."""
    docs = K.load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    known = D.learn(docs, 250, 50, "t")
    x = D.decode_column(D.encode_column(docs, "t", known, "e"), "e", known, "back")
    return x.select("doc_id", F.md5(F.col("back").cast("binary")).alias("md5"), (F.length("e") <= F.length("t")).alias("smaller"))


@query("SELECT item_id, md5(text) AS md5, CAST(octet_length(encode(text)) + 28 AS BIGINT) AS sealed, true AS wrong_fails FROM benchmark")
def password_roundtrip(spark, d):
    """Texts under keys from a password, opened with it and with another."""
    b = K.load(spark, d, "benchmark").withColumn("salt", F.sha2(F.col("item_id").cast("string"), 256))
    key, other = E.derive_keys(b, "item_id", "salt", "open"), E.derive_keys(b, "item_id", "salt", "shut").withColumnRenamed("key", "other")
    x = b.join(key, "item_id").join(other, "item_id").withColumn("sealed", E.seal(F.col("text"), F.col("key")))
    return x.select("item_id", F.md5(E.unseal(F.col("sealed"), F.col("key"))).alias("md5"), F.octet_length("sealed").cast("long").alias("sealed"), E.unseal(F.col("sealed"), F.col("other")).isNull().alias("wrong_fails"))


@query("SELECT page_id, md5(coalesce(html, '')) AS md5, CAST(greatest(1, ceil(octet_length(encode(coalesce(html, ''))) / 4096)) AS BIGINT) AS blocks FROM pages")
def block_parallel_roundtrip(spark, d):
    """Every whole page in blocks of 4 kB, each packed by itself, and together again."""
    packed = C.encode_blocks(K.load(spark, d, "pages"), "page_id", "html", "lzp+tor", 4096)
    return C.decode_blocks(packed, "page_id").select("page_id", F.md5("data").alias("md5"), "blocks")
