"""Further queries over scalar functions: the scripting language's library and the engine's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafold.functions import scalars as S
from stratafold.functions import script as L
from stratafold.functions.arrow import append
from stratafold.plans.queries import query
from stratafold.sources import catalog as K
from stratafold.sources import text_sources as X


@query("SELECT p_partkey, printf('%5d|%-8s|%08.2f|%x', p_partkey, p_brand, p_retailprice, p_partkey) AS line, '\"' || p_name || '\"' AS quoted FROM part")
def script_format(spark, d):
    p = K.load(spark, d, "part")
    return p.select(
        "p_partkey", L.format_("%5d|%-8s|%08.2f|%x", F.col("p_partkey"), F.col("p_brand"), F.col("p_retailprice"), F.col("p_partkey")).alias("line"), L.format_("%q", F.col("p_name")).alias("quoted")
    )


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, CAST(len(v) AS BIGINT) AS n, array_to_string(v[2:5], ',') AS part, list_sort(v) AS up, list_reverse_sort(v) AS down, list_transform(v, lambda x, i: x * i) AS by_place, v[1:2] || [-1] || v[3:] AS put, v[1:1] || v[3:] AS taken FROM v""")
def script_tables(spark, d):
    v = F.col("v")
    e = K.load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("v"))
    return e.select(
        "vec_id", L.getn(v).alias("n"), L.concat(v, ",", 2, 5).alias("part"), L.sort(v).alias("up"), L.sort(v, lambda a, b: a > b).alias("down"),
        L.foreachi(v, lambda i, x: x * i).alias("by_place"), L.insert(v, 3, F.lit(-1).cast("long")).alias("put"), L.remove(v, 2).alias("taken"),
    )


_ONES = ("acos", "asin", "atan", "cos", "cosh", "exp", "sinh", "sin", "tan", "tanh")


@query("SELECT event_id, " + ", ".join(f"round({f}({'sin(value)' if f in ('acos', 'asin') else 'value / 100'}), 6) + 0 AS {f}" for f in _ONES) + """, round(atan2(value, 3), 6) + 0 AS atan2, round(ln(abs(value) + 1), 6) AS log, round(log10(abs(value) + 1), 6) AS log10,
  round(radians(value), 6) + 0 AS rad, round(pow(abs(value), 0.5), 6) AS pow, least(value, 5.0::DOUBLE) AS least, round(value - trunc(value / 7) * 7, 6) + 0 AS fmod FROM events""")
def script_math(spark, d):
    v, m = F.col("value"), L.MATH
    six = lambda c, name: (F.round(c, 6) + 0).alias(name)
    return K.load(spark, d, "events").select(
        "event_id", *[six(m[f](F.sin(v) if f in ("acos", "asin") else v / 100), f) for f in _ONES], six(m["atan2"](v, F.lit(3.0)), "atan2"), six(m["log"](F.abs(v) + 1), "log"),
        six(m["log10"](F.abs(v) + 1), "log10"), six(m["rad"](v), "rad"), six(m["pow"](F.abs(v), F.lit(0.5)), "pow"), m["min"](v, F.lit(5.0)).alias("least"), six(m["fmod"](v, F.lit(7)), "fmod"),
    )


@query("SELECT event_id, CAST(date_diff('second', TIMESTAMP '2020-01-01', ts) AS DOUBLE) AS since, CAST(year(ts) AS BIGINT) AS year, CAST(dayofyear(ts) AS BIGINT) AS yday, strftime(ts, '%d.%m.%y') AS day FROM events")
def script_dates(spark, d):
    ts = F.col("ts")
    whole = F.date_trunc("second", ts).cast("timestamp_ntz")
    return K.load(spark, d, "events").select(
        "event_id", L.difftime(whole, F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))).alias("since"), F.year(ts).cast("long").alias("year"), F.dayofyear(ts).cast("long").alias("yday"),
        F.date_format(ts, "dd.MM.yy").alias("day"),
    )


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS shown, CASE WHEN p_size > 25 THEN [p_brand, p_type] ELSE [p_type] END AS rest, CAST(ascii(p_name[2]) AS BIGINT) AS second, CAST(strpos(p_name, 'o') AS BIGINT) AS at FROM part")
def script_base(spark, d):
    n = F.col("p_name")
    return K.load(spark, d, "part").select(
        "p_partkey", F.col("p_size").cast("string").alias("shown"), F.when(F.col("p_size") > 25, L.select(2, n, F.col("p_brand"), F.col("p_type"))).otherwise(L.select(-1, n, F.col("p_brand"), F.col("p_type"))).alias("rest"),
        L.byte(n, 2).alias("second"), F.coalesce(L.find(n, "o", plain=True), F.lit(0).cast("long")).alias("at"),
    )


@query("""SELECT p_partkey, replace(p_name, 'e', 'ee') AS replaced, CASE WHEN len(string_split(p_name, 'e')) > 2 THEN array_to_string(string_split(p_name, 'e')[1:2], 'e') || '#' || array_to_string(string_split(p_name, 'e')[3:], 'e') ELSE p_name END AS second,
  trim(p_name) AS trimmed, left(p_name, 3) AS cut, starts_with(lower(p_type), 'pro') AS starts, ends_with(lower(p_type), 'el') AS ends, CAST(ceil(p_partkey / 16) * 16 AS BIGINT) AS up, CASE WHEN p_partkey > 0 THEN CAST(floor(log2(p_partkey)) AS BIGINT) END AS lb,
  CAST(p_size AS BIGINT) AS parsed FROM part""")
def engine_scalars(spark, d):
    n, k = F.col("p_name"), F.col("p_partkey")
    return K.load(spark, d, "part").select(
        "p_partkey", F.replace(n, F.lit("e"), F.lit("ee")).alias("replaced"), S.replace_nth(n, "e", "#", 2).alias("second"), F.trim(n).alias("trimmed"), F.left(n, F.lit(3)).alias("cut"),
        S.starts(F.col("p_type"), "PRO").alias("starts"), S.ends(F.col("p_type"), "EL").alias("ends"), S.round_up(k, 16).alias("up"), S.log_floor(k).alias("lb"),
        S.parse_int(F.concat(F.lit("="), F.col("p_size").cast("string"))).alias("parsed"),
    )


_UNITS = "CASE p_size % 6 WHEN 0 THEN 'b' WHEN 1 THEN 'k' WHEN 2 THEN 'm' WHEN 3 THEN 'g' WHEN 4 THEN '^' ELSE '' END"


@query(f"SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN CAST(p_size AS BIGINT) * 1048576 WHEN 3 THEN CAST(p_size AS BIGINT) * 1073741824 ELSE CASE WHEN p_size < 63 THEN pow(2, p_size) END END AS BIGINT) AS octets FROM part")
def parse_mem_table(spark, d):
    """Amounts of memory written from a table's numbers and units."""
    text = F.concat(F.col("p_size").cast("string"), F.expr(_UNITS))
    return K.load(spark, d, "part").select("p_partkey", S.parse_mem(text).alias("octets"))


@query("""WITH x AS (SELECT o_orderkey, 'rep:' || (o_custkey % 90 + 10) || 'mb+lzma:' || (o_custkey % 60 + 4) || 'mb' || CASE o_orderstatus WHEN 'O' THEN '+aes-256' ELSE '' END AS chain, o_custkey, o_orderstatus FROM orders)
SELECT o_orderkey, chain, CAST((o_custkey % 90 + 10 + o_custkey % 60 + 4) * 1048576 AS BIGINT) AS memory, 'rep:' || least(o_custkey % 90 + 10, 32) || 'mb+lzma:' || least(o_custkey % 60 + 4, 32) || 'mb' || CASE o_orderstatus WHEN 'O' THEN '+aes-256' ELSE '' END AS limited,
  o_orderstatus = 'O' AS encrypted, CAST(CASE o_orderstatus WHEN 'O' THEN 3 ELSE 2 END AS BIGINT) AS methods FROM x""")
def chain_table(spark, d):
    """Chains written from a table, their memory, and what a limit of 32 MB leaves of them."""
    k = F.col("o_custkey")
    chain = F.concat(F.lit("rep:"), (k % 90 + 10).cast("string"), F.lit("mb+lzma:"), (k % 60 + 4).cast("string"), F.lit("mb"), F.when(F.col("o_orderstatus") == "O", "+aes-256").otherwise(""))
    o = K.load(spark, d, "orders").select("o_orderkey", chain.alias("chain"))
    c = F.col("chain")
    return o.select("o_orderkey", "chain", S.chain_memory(c).alias("memory"), S.limit_memory(c, 32 << 20).alias("limited"), S.is_encrypted(c).alias("encrypted"), F.size(S.methods(c)).cast("long").alias("methods"))


_KEY = b"a key of the tests"
_PADS = [bytes(k ^ p for k in _KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]


@query(f"SELECT item_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(text)))) AS hmac FROM benchmark")
def hmac_digests(spark, d):
    return K.load(spark, d, "benchmark").select("item_id", S.hmac(F.col("text"), _KEY, 256).alias("hmac"))


@query("WITH h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark) SELECT item_id, CAST(CASE WHEN length(h) >= 4 THEN CAST(('0x' || h[3:4] || h[1:2]) AS BIGINT) END AS DECIMAL(20, 0)) AS two, CAST(CASE WHEN length(h) >= 8 THEN CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) END AS DECIMAL(20, 0)) AS four FROM h")
def little_endian_values(spark, d):
    data = F.encode("text", "UTF-8")
    return K.load(spark, d, "benchmark").select("item_id", S.little_endian(data, 2).alias("two"), S.little_endian(data, 4).alias("four"))


@query("SELECT item_id, md5(text) AS there_and_back, CAST(2 * length(text) AS BIGINT) AS octets FROM benchmark")
def wide_texts(spark, d):
    """Texts in two octets a character and back."""
    b = K.load(spark, d, "benchmark").withColumn("w", F.encode("text", "UTF-16LE"))
    return b.select("item_id", F.md5(F.decode("w", "UTF-16LE").cast("binary")).alias("there_and_back"), F.octet_length("w").cast("long").alias("octets"))


_METHOD = "CASE o_custkey % 6 WHEN 0 THEN 'aes-' || (128 + 64 * (o_custkey % 3)) || '/ctr:n' || (o_custkey % 100 + 1) WHEN 1 THEN 'blowfish' WHEN 2 THEN 'twofish-192' WHEN 3 THEN 'tor:' || (o_custkey % 12 + 1) WHEN 4 THEN 'storing' ELSE 'lzma:8mb' END"


@query(f"""WITH m AS (SELECT o_orderkey, o_custkey AS k, {_METHOD} AS method FROM orders)
SELECT o_orderkey, method, CAST(k % 6 < 3 AS BIGINT) AS encryption, CAST(CASE k % 6 WHEN 0 THEN (128 + 64 * (k % 3)) // 8 WHEN 1 THEN 56 WHEN 2 THEN 24 ELSE 0 END AS BIGINT) AS key_size, CAST(CASE k % 6 WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 0 END AS BIGINT) AS iv_size,
  CAST(CASE k % 6 WHEN 0 THEN k % 100 + 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000 ELSE 0 END AS BIGINT) AS iterations, CAST(CASE k % 6 WHEN 3 THEN CASE WHEN k % 12 + 1 <= 4 THEN 1 ELSE 0 END WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS very_fast FROM m""")
def method_services(spark, d):
    """What methods answer to the questions of whoever runs them."""
    o = K.load(spark, d, "orders").select("o_orderkey", F.expr(_METHOD).alias("method"))
    m = F.col("method")
    asked = {"encryption": "encryption?", "key_size": "keySize", "iv_size": "ivSize", "iterations": "numIterations", "very_fast": "VeryFast?"}
    return o.select("o_orderkey", "method", *[S.service(m, q).alias(n) for n, q in asked.items()])


@query("SELECT page_id, CASE WHEN length(p) > 1 AND ends_with(p, '/') THEN left(p, length(p) - 1) ELSE p END AS path FROM (SELECT page_id, regexp_replace(replace(url, '.', '/'), '/+', '/', 'g') AS p FROM pages)")
def normal_paths(spark, d):
    """Paths with one kind of separator, here made from addresses whose dots stand for the other kind."""
    return K.load(spark, d, "pages").select("page_id", S.normal_path(F.translate("url", ".", "\\")).alias("path"))


_MACROS = {"#x": "rep:#mb+ccm", "ccm": "lzma:#", "best": "dict+5x", "b#": "grzip:#"}


@query("SELECT p_partkey, name, CASE WHEN p_size % 3 = 0 THEN 'rep:' || p_size % 10 || 'mb+lzma:#' WHEN p_size % 3 = 1 THEN 'grzip:' || p_size % 10 || '+storing' ELSE 'dict+rep:5mb+lzma:#' END AS chain FROM (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN p_size % 10 || 'x' WHEN 1 THEN 'b' || p_size % 10 || '+storing' ELSE 'best' END AS name FROM part)")
def macro_table(spark, d):
    """Names of a table replaced by their macros' chains: each different name is resolved once."""
    digit = (F.col("p_size") % 10).cast("string")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(digit, F.lit("x"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("b"), digit, F.lit("+storing"))).otherwise("best")
    p = K.load(spark, d, "part").select("p_partkey", name.alias("name"))
    return append(p, ["name"], [("chain", "string")], lambda n: (X.resolve_macro(n, _MACROS),))
