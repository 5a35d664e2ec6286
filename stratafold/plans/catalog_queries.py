"""Further queries over catalogs: listings, reports, orders, selections, and changes of archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions import scalars as S
from stratafold.operators import archive as A
from stratafold.operators import secrets as E
from stratafold.plans.queries import _B, _F, _K, _NEW, _OLD, _P, _blocks, _files, _old_new, list_verbose, query
from stratafold.sources import catalog as K
from stratafold.sources import text_sources as X
from stratafold.streaming.tail import windowed_totals

_CHAIN = "dict:p+lzma:8mb+aes-256"


# --- listings --------------------------------------------------------------------------------


@query(f"WITH {_K} SELECT dir || '/' || name AS path, 'txt' AS ext, size, block, n_files > 1 AS solid, CASE WHEN size = 0 THEN 'storing' ELSE '{_CHAIN}' END AS method, size > 0 AS encrypted FROM b JOIN k USING (grp, block)")
def list_technical(spark, d):
    b = _blocks(spark, d)
    chain = F.when(F.col("size") == 0, "storing").otherwise(_CHAIN)
    return A.technical(b, A.packed_blocks(b), chain)


@query(f"""WITH {_K}, a AS (SELECT grp, count(DISTINCT dir) AS dirs, count(*) AS files, sum(size) AS size FROM b GROUP BY grp), p AS (SELECT grp, count(*) AS n, sum(packed_size) AS packed FROM k GROUP BY grp)
SELECT grp, CAST(dirs AS BIGINT) AS dirs, CAST(files AS BIGINT) AS files, CAST(size AS BIGINT) AS size, CAST(packed AS BIGINT) AS packed, round(CAST(packed AS DOUBLE) * 100 / CAST(size AS DOUBLE), 2) AS ratio,
  CAST(1 AS BIGINT) AS directory_blocks, CAST(n AS BIGINT) AS solid_blocks, CAST(floor(size / n) AS BIGINT) AS mean_block, CAST(75497472 AS BIGINT) AS compress_memory, CAST(8388608 AS BIGINT) AS memory, CAST(8388608 AS BIGINT) AS dictionary,
  grp = 'en' AS locked, '1%' AS recovery, 'files in ' || grp AS comment, CAST(0 AS BIGINT) AS sfx_size, true AS headers_encrypted, 'aes-256' AS ciphers FROM a JOIN p USING (grp)""")
def archive_report(spark, d):
    """The whole report, an archive for each language."""
    b = _blocks(spark, d)
    named = b.withColumn("archive_locked", F.col("grp") == "en").withColumn("archive_comment", F.concat(F.lit("files in "), "grp")).withColumn("archive_recovery", F.lit("1%"))
    return A.info(named, A.packed_blocks(b), _CHAIN, ["grp"])


@query(f"WITH {_P} SELECT CAST(1 AS BIGINT) AS part, lpad(CAST(size AS VARCHAR), 12, ' ') || lpad(CAST(packed AS VARCHAR), 12, ' ') || ' ' || dir || '/' || name AS line FROM p UNION ALL SELECT 2, count(*) || ' files, ' || CAST(sum(size) AS BIGINT) || ' octets, ' || CAST(sum(packed) AS BIGINT) || ' packed' FROM p")
def listing_report(spark, d):
    """The text listing with its footer."""
    v = list_verbose(spark, d)
    lines = v.select(F.lit(1).cast("long").alias("part"), A.listing_line(F.col("size"), F.col("packed"), F.col("path")).alias("line"))
    total = v.agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.sum("packed").alias("p"))
    return lines.union(total.select(F.lit(2).cast("long"), F.format_string("%d files, %d octets, %d packed", "n", "s", "p")))


# --- orders ----------------------------------------------------------------------------------


@query(f"WITH {_F} SELECT file_id, CAST(row_number() OVER (ORDER BY regexp_extract(name, '[.]([^.:/\\\\]*)$', 1), name, file_id) AS BIGINT) AS pos FROM f")
def sort_en(spark, d):
    """Places in the whole catalog, by extension and name."""
    return A.ranked(_files(spark, d), "en", whole=True).select("file_id", "pos")


@query(f"WITH {_F} SELECT file_id, CAST(row_number() OVER (ORDER BY regexp_extract(name, '[.]([^.:/\\\\]*)$', 1), size, file_id) AS BIGINT) AS pos FROM f")
def sort_es(spark, d):
    return A.ranked(_files(spark, d), "es", whole=True).select("file_id", "pos")


@query(f"WITH {_F} SELECT file_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY grp, regexp_extract(name, '[.]([^.:/\\\\]*)$', 1), dir, name, file_id) AS BIGINT) AS pos FROM f")
def sort_gepn(spark, d):
    return A.ranked(_files(spark, d), "gepn").select("file_id", "pos")


#: A group file: the order of its masks is the order in which a solid archive takes files.
_ORDER = ["; pages first", "$page", "*.html", "$anchor", "*#*", "$ref", "*ref=?", "$default", "$other", "*.pdf"]


@query("""WITH m AS (SELECT page_id, url, CASE WHEN lower(url) GLOB '*.html' THEN 0 WHEN contains(url, '#') THEN 1 WHEN lower(url) GLOB '*ref=?' THEN 2 ELSE 3 END AS rank FROM pages)
SELECT page_id, ['$page', '$anchor', '$ref', '$default'][rank + 1] AS type, CAST(row_number() OVER (ORDER BY rank, url, page_id) AS BIGINT) AS pos FROM m""")
def sort_by_group_file(spark, d):
    """The first matching mask gives a file its type and its place among the types; ``$default`` stands where the file puts it."""
    masks = X.parse_group_lines(_ORDER)
    p = A.first_matching_mask(K.load(spark, d, "pages"), masks, "url")
    rank = F.coalesce(*[F.when(F.col("type") == kind, F.lit(i)) for i, (_, kind, _) in enumerate(masks)])
    p = p.withColumn("rank", rank).withColumn("within", F.struct("rank", F.substring("url", 1, 12)))
    placed = A.running_before(p, F.lit(1).cast("long"), [], ["rank", "url", "page_id"], F.col("within"), "pos")
    return placed.select("page_id", "type", (F.col("pos") + 1).alias("pos"))


@query(f"WITH {_F} SELECT name, size FROM f ORDER BY size DESC, name LIMIT 20")
def largest_files(spark, d):
    """A report: the listing sorted by a column, its first rows."""
    return _files(spark, d).select("name", "size").orderBy(F.desc("size"), "name").limit(20)


# --- predicates and joins --------------------------------------------------------------------


@query(f"WITH {_B} SELECT file_id, grp, block FROM b")
def block_range_join(spark, d):
    """Files find their block by the range of places that it owns."""
    b = _blocks(spark, d)
    placed = A.running_before(b, F.lit(1).cast("long"), ["grp"], ["file_id"], K.id_range("file_id"), "pos").select("grp", "file_id", "pos")
    return A.in_blocks(placed, A.block_bounds(b).select("grp", "block", "start", "upto")).select("file_id", "grp", "block")


@query(f"WITH {_F} SELECT file_id, 'at once' AS branch, CAST(0 AS BIGINT) AS octets FROM f WHERE size = 0 UNION ALL SELECT file_id, 'unpacked', size FROM f WHERE size > 0")
def zero_size_branches(spark, d):
    """Empty files are written at once, and only the others are read."""
    f = _files(spark, d)
    empty = f.where("size = 0").select("file_id", F.lit("at once").alias("branch"), F.lit(0).cast("long").alias("octets"))
    return empty.union(f.where("size > 0").select("file_id", F.lit("unpacked"), "size"))


#: Descriptors of an archive for each order status, some of which cannot be right.
_D = "d AS (SELECT o_orderstatus AS archive, o_orderkey % 7 AS type, o_orderkey * 10 AS pos, o_custkey % 50 AS origsize, o_custkey AS compsize FROM orders)"


def _descriptors(spark, d) -> DataFrame:
    o = K.load(spark, d, "orders")
    return o.select(F.col("o_orderstatus").alias("archive"), (F.col("o_orderkey") % 7).alias("type"), (F.col("o_orderkey") * 10).alias("pos"), (F.col("o_custkey") % 50).alias("origsize"), F.col("o_custkey").alias("compsize"))


@query(f"WITH {_D} SELECT archive, pos, compsize FROM d WHERE type = 3")
def directory_blocks(spark, d):
    """Only directories are read of an archive's blocks."""
    return _descriptors(spark, d).where("type = 3").select("archive", "pos", "compsize")


@query(f"WITH {_D} SELECT archive, bool_or(type = 5) AS recovery FROM d GROUP BY archive")
def recovery_present(spark, d):
    return _descriptors(spark, d).groupBy("archive").agg(F.max(F.col("type") == 5).alias("recovery"))


@query(f"WITH {_D} SELECT archive, pos, unnest(list_filter([CASE WHEN type > 5 THEN 'unknown type' END, CASE WHEN origsize <= 0 THEN 'nothing in it' END, CASE WHEN compsize <= 0 THEN 'no data' END, CASE WHEN compsize > pos THEN 'begins before the archive' END], lambda x: x IS NOT NULL)) AS problem FROM d")
def descriptor_violations(spark, d):
    return A.violations(_descriptors(spark, d))


@query("SELECT page_id, CASE WHEN strpos(left(html, 400), '<article') > 0 THEN CAST(strpos(left(html, 400), '<article') - 1 AS BIGINT) END AS at FROM pages")
def signature_sniff(spark, d):
    return K.load(spark, d, "pages").select("page_id", S.signature_at(F.col("html"), "<article", 400).alias("at"))


@query("SELECT page_id, CASE WHEN octet_length(encode(html)) <= 2000 THEN md5(html) END AS md5, CAST(CASE WHEN octet_length(encode(html)) <= 2000 THEN 0 ELSE -5 END AS BIGINT) AS code FROM pages")
def bounded_copies(spark, d):
    """Copies into buffers of 2,000 octets; what does not fit has an error's code."""
    p = K.load(spark, d, "pages").select("page_id", S.bounded_copy(F.col("html").cast("binary"), 2000).alias("c"))
    return p.select("page_id", F.md5("c.data").alias("md5"), F.col("c.code").alias("code"))


# --- changes ---------------------------------------------------------------------------------


def _extract_sql(replace: str) -> str:
    return f"WITH {_OLD}, {_NEW} SELECT o.path, CASE WHEN n.path IS NULL THEN 'create' WHEN {replace} THEN 'replace' ELSE 'keep' END AS action FROM o LEFT JOIN n ON o.path = n.path"


@query(_extract_sql("true"))
def extract_overwrite(spark, d):
    return A.extract_plan(*_old_new(spark, d), "overwrite").select("path", "action")


@query(_extract_sql("false"))
def extract_skip(spark, d):
    return A.extract_plan(*_old_new(spark, d), "skip").select("path", "action")


@query(f"WITH {_OLD} SELECT path, size FROM o")
def backup_full(spark, d):
    return A.backup(_old_new(spark, d)[0], "full", F.lit(500), F.lit(900)).select("path", "size")


@query(f"WITH {_OLD} SELECT path, size FROM o WHERE mtime > 900")
def backup_incremental(spark, d):
    return A.backup(_old_new(spark, d)[0], "incremental", F.lit(500), F.lit(900)).select("path", "size")


@query(f"WITH {_OLD}, {_NEW}, u AS (SELECT *, 0 AS archive FROM o UNION ALL SELECT *, 1 FROM n), j AS (SELECT path, size FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY archive DESC) = 1) SELECT 'archive' AS place, path, size FROM j")
def move_files(spark, d):
    """Where files are after they were moved into an archive: none is left on disk."""
    archived, left = A.move(*_old_new(spark, d))
    return archived.select(F.lit("archive").alias("place"), "path", "size").union(left.select(F.lit("disk"), "path", "size"))


@query("SELECT DISTINCT coalesce(source, '') AS archive, coalesce(source, '') IN ('src1', 'src3') AS locked, CASE WHEN coalesce(source, '') IN ('src1', 'src3') THEN 'old' ELSE 'new ' || coalesce(source, '') END AS comment FROM documents")
def archive_comments(spark, d):
    """New comments, which locked archives do not take."""
    a = K.load(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("archive")).distinct()
    a = a.withColumn("locked", F.col("archive").isin("src1", "src3")).withColumn("comment", F.lit("old"))
    return A.annotate(a, a.select("archive", F.concat(F.lit("new "), "archive").alias("new_comment")))


@query(f"""WITH {_B}, h AS (SELECT grp, block, bool_or(file_id % 50 = 0) AS hit FROM b GROUP BY grp, block)
SELECT mode, grp, block, CASE mode WHEN 'append' THEN CASE WHEN hit THEN 'copy and add' ELSE 'copy' END WHEN 'smart' THEN CASE WHEN hit THEN 'repack' ELSE 'copy' END WHEN 'all' THEN 'repack' WHEN 'info' THEN 'omit' WHEN 'info_crc' THEN 'read and omit' ELSE 'repack without catalog' END AS action
FROM h, (SELECT unnest(['append', 'smart', 'all', 'info', 'info_crc', 'no_headers']) AS mode)""")
def recompress_modes(spark, d):
    b = _blocks(spark, d)
    blocks = A.packed_blocks(b)
    parts = [A.recompress(b, blocks, F.col("file_id") % 50 == 0, m).select(F.lit(m).alias("mode"), "grp", "block", "action") for m in A.RECOMPRESS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT DISTINCT o_orderpriority AS share_of, CASE WHEN o_orderpriority LIKE '1%' THEN '0*4kb' WHEN o_orderpriority LIKE '2%' THEN '0*64kb' ELSE '1%' END AS setting FROM orders")
def recovery_settings(spark, d):
    share = F.when(F.col("o_orderpriority").startswith("1"), "0.1%").when(F.col("o_orderpriority").startswith("2"), "0.01%").otherwise("1%")
    return K.load(spark, d, "orders").select(F.col("o_orderpriority").alias("share_of"), S.recovery_setting(share).alias("setting")).distinct()


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_totals(spark, d):
    """What the stream of events gives, day by day, over the whole table at once."""
    t = windowed_totals(K.load(spark, d, "events"))
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'wrong password' ELSE 'open' END AS outcome FROM benchmark")
def password_outcomes(spark, d):
    """Texts sealed with one password, every third opened with another."""
    b = K.load(spark, d, "benchmark").withColumn("salt", F.sha2(F.col("item_id").cast("string"), 256))
    key, other = E.derive_keys(b, "item_id", "salt", "open"), E.derive_keys(b, "item_id", "salt", "shut").withColumnRenamed("key", "other")
    x = b.join(key, "item_id").join(other, "item_id").withColumn("sealed", E.seal(F.col("text"), F.col("key")))
    return x.select("item_id", E.outcome(F.col("sealed"), F.when(F.col("item_id") % 3 == 0, F.col("other")).otherwise(F.col("key"))).alias("outcome"))
