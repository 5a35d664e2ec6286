import hashlib
import hmac
import http.server
import os
import re
import threading
import urllib.error
import zlib
from typing import ClassVar

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafold.functions import scalars as S
from stratafold.functions import script as L
from stratafold.operators import archive as A
from stratafold.operators import codecs as C
from stratafold.operators import dictionary as D
from stratafold.operators import profile as P
from stratafold.operators import records as R
from stratafold.operators import samples as M
from stratafold.sources import archive_file, files


def test_files_without_a_time_are_there(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", 5, 1), ("c", None, 1)], "path string, mtime long, size long")
    new = spark.createDataFrame([("a", 3, 2), ("b", None, 2), ("d", None, 2)], "path string, mtime long, size long")
    got = {m: {r.path: r.action for r in A.update(old, new, m).collect()} for m in ("replace", "newer", "freshen", "sync")}
    assert got["replace"] == {"a": "updated", "b": "updated", "c": "kept", "d": "added"}
    assert got["newer"] == {"a": "updated", "b": "kept", "c": "kept", "d": "added"}
    assert got["freshen"] == {"a": "updated", "b": "kept", "c": "kept"}
    assert got["sync"] == {"a": "updated", "b": "kept", "d": "added"}
    assert {r.path: r.action for r in A.extract_plan(new, old, "update").collect()} == {"a": "replace", "b": "keep", "d": "create"}


def test_blocks_keep_any_id(spark):
    rows = [(-3, bytearray(b"x" * 250)), (1 << 44, bytearray(b"y" * 101)), (None, bytearray(b"z"))]
    packed = C.encode_blocks(spark.createDataFrame(rows, "id long, data binary"), "id", "data", "tor", 100)
    assert {(r.id, r.block_no) for r in packed.collect()} == {(-3, 0), (-3, 1), (-3, 2), (1 << 44, 0), (1 << 44, 1), (None, 0)}
    assert {r.id: (bytes(r.data), r.blocks) for r in C.decode_blocks(packed, "id").collect()} == {-3: (b"x" * 250, 3), 1 << 44: (b"y" * 101, 2), None: (b"z", 1)}


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet=list("ab \n\uE000\uE001\uF8FE\uF8FFé"), max_size=40))
def test_dictionary_round_trips(text):
    words = ["aa", "ab", "é"]
    codes = {w: chr(0xE000 + i) for i, w in enumerate(words)}
    assert D.decode_text(D.encode_text(text, codes), words) == text


@settings(deadline=None, max_examples=100)
@given(st.one_of(st.binary(max_size=600), st.lists(st.integers(0, 2**32 - 1), max_size=200).map(lambda v: np.cumsum(np.asarray(v, np.uint32) % 9, dtype=np.uint32).tobytes())))
def test_filters_round_trip(data):
    for name in ("table", "mm", "rec"):
        c = C.CODECS[name]
        assert c.decode(c.encode(data)) == data


def test_tables_are_found_and_pay():
    r = np.random.default_rng(3)
    t = np.zeros((500, 7), np.uint8)
    t[:, 0] = 5
    c = np.cumsum(r.integers(1, 9, 500))
    t[:, 2], t[:, 3], t[:, 5] = c & 255, c >> 8, r.integers(0, 256, 500)
    data = r.bytes(300) + t.tobytes() + r.bytes(200)
    found = R.find_tables(data)
    assert len(found) == 1 and found[0][1] == 7 and found[0][2] >= 495
    assert len(zlib.compress(R.tables_encode(data))) < 0.75 * len(zlib.compress(data))
    assert R.find_tables(r.bytes(3000)) == [] and R.find_tables(b"abc" * 900) == []


def test_runs():
    assert R.monotone_runs(np.array([1, 2, 2, 5, 4, 4, 3, 9, 9])).tolist() == [0, 0, 0, 1, 1, 1, 2, 2]
    assert R.monotone_runs(np.array([7])).tolist() == [] and R.monotone_runs(np.array([3, 3, 3])).tolist() == [0, 0]


def test_models():
    r = np.random.default_rng(1)
    wave = (np.stack([2000 * np.sin(np.arange(6000) / 40), 9000 + 500 * np.cos(np.arange(6000) / 30)], 1) + r.integers(-3, 4, (6000, 2))).astype("<i2").tobytes()
    assert M.detect(wave)[:2] == [2, 16] and M.cheapest(wave) == "diffed"
    assert len(zlib.compress(M.mm_encode(wave))) < 0.8 * len(zlib.compress(wave))
    assert M.cheapest(b"") == "order0" and M.cheapest(r.bytes(4000)) == "order0" and M.cheapest(b"the same words again " * 80) in ("lz77", "rolz")


def test_extract_find_and_remove(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [("a/b", "x.txt", 1000, bytearray(b"one")), ("", "y.bin", 2000, None), (None, "z.txt", None, bytearray(b"two"))]
    df = spark.createDataFrame(rows, "dir string, name string, mtime long, content binary")
    assert {tuple(r) for r in files.extract(df, root).collect()} == {("a/b/x.txt", 3, True), ("y.bin", 0, True), ("z.txt", 3, True)}
    assert (tmp_path / "out/a/b/x.txt").read_bytes() == b"one" and os.stat(tmp_path / "out/a/b/x.txt").st_mtime == 1000
    found = {r.path.split("/out/")[1]: r.size for r in files.find(spark, root).collect()}
    assert found == {"a/b/x.txt": 3, "y.bin": 0, "z.txt": 3}
    assert [r.path.split("/")[-1] for r in files.find(spark, root, masks=["*.bin"]).collect()] == ["y.bin"]
    newer = spark.createDataFrame([("a/b", "x.txt", 999, bytearray(b"old")), ("", "y.bin", 3000, bytearray(b"new"))], "dir string, name string, mtime long, content binary")
    assert {r.path: r.written for r in files.extract(newer, root, policy="update").collect()} == {"a/b/x.txt": False, "y.bin": True}
    assert {r.written for r in files.extract(newer, root, policy="skip").collect()} == {False}
    files.extract(df, root + "/flat", flat=True).collect()
    assert sorted(os.listdir(root + "/flat")) == ["x.txt", "y.bin", "z.txt"]
    assert {r.path: r.removed for r in files.remove(spark.createDataFrame([("a/b/x.txt",), ("none",)], "path string"), root).collect()} == {"a/b/x.txt": True, "none": False}
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError, match="leads out"):
            files._inside(root, bad)


def test_archives_in_a_store(spark, tmp_path):
    data = archive_file.pack([("tor", [("d", "a.txt", 5, b"alpha"), ("d", "b.txt", 6, b"beta")]), ("storing", [("", "c", 7, b"gamma")])], comment="hi")
    (tmp_path / "one.arc").write_bytes(data)
    (tmp_path / "bad.arc").write_bytes(b"nothing here")
    got = archive_file.from_store(spark, str(tmp_path / "one.arc"), "contents").collect()
    assert {(r.dir, r.name): (bytes(r.content), r.intact) for r in got} == {("d", "a.txt"): (b"alpha", True), ("d", "b.txt"): (b"beta", True), ("", "c"): (b"gamma", True)}
    assert archive_file.from_store(spark, str(tmp_path / "one.arc"), "files").count() == 3
    archives = archive_file.from_store(spark, str(tmp_path), "archives", strict=False).collect()
    assert {(r.archive.split("/")[-1], r.comment, r.error) for r in archives} == {("one.arc", "hi", None), ("bad.arc", None, "no_footer")}


def test_digests_and_scalars(spark):
    df = spark.createDataFrame([("abc",), ("",), ("é" * 200,)], "t string")
    got = df.select("t", S.hmac(F.col("t"), b"key", 256).alias("a"), S.hmac(F.col("t"), b"k" * 200, 512).alias("b"), F.sha2("t", 512).alias("c")).collect()
    for r in got:
        t = r.t.encode()
        assert (r.a, r.b, r.c) == (hmac.new(b"key", t, "sha256").hexdigest(), hmac.new(b"k" * 200, t, "sha512").hexdigest(), hashlib.sha512(t).hexdigest())
    one = df.limit(1).select(
        S.replace_nth(F.lit("a.b.c"), ".", "#", 2).alias("n"), S.replace_nth(F.lit("a.b"), ".", "#", 2).alias("few"), S.log_floor(F.lit(0)).alias("zero"), S.round_up(F.lit(17), 16).alias("up"),
        S.little_endian(F.lit(b"\1\2\3\4\5\6\7\xff"), 8).alias("le"), L.maxn(F.array(F.lit(1), F.lit(None), F.lit(3), F.lit(None))).alias("maxn"), L.fmod(F.lit(-7.5), F.lit(2.0)).alias("fmod"),
        L.concat(F.array(*map(F.lit, "abcd")), "-", 2, 3).alias("cat"), L.random(F.lit(5), 1, 6).alias("die"), F.array_join(L.select(-2, *map(F.lit, "xyz")), "").alias("sel"),
    ).first()
    assert one[:3] == ("a.b#c", "a.b", None) and one.up == 32 and int(one.le) == int.from_bytes(b"\1\2\3\4\5\6\7\xff", "little")
    assert (one.maxn, one.fmod, one.cat, one.sel) == (3, -1.5, "b-c", "yz") and 1 <= one.die <= 6


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"list_technical", "script_format", "table_roundtrip", "codec_stress"} <= names
    assert set(entry.oracle_sql()) <= names


def test_hooks_around_queries(spark):
    from stratafold.plans.hooks import EVENTS, Hooks, run

    hooks, seen = Hooks(), []
    for e in EVENTS:
        hooks.on(e, lambda p, e=e: seen.append((e, p.get("command"))))
    got = run(hooks, spark, ["zero_size_split", "recovery_present"], "/root/testdata/sf0.001")
    assert got == {"zero_size_split": 1, "recovery_present": 3}
    assert [e for e, _ in seen] == ["program_start", *["command_start", "archive_start", "archive_done", "command_done"] * 2, "program_done"]
    seen.clear()
    with pytest.raises(KeyError):
        run(hooks, spark, ["no such query"], "/root/testdata/sf0.001")
    assert [e for e, _ in seen] == ["program_start", "command_start", "archive_start", "error", "program_done"]


def plain_near(t):
    """The matches place by place."""
    last, recent, at, covered, found, again = {}, [], 0, 0, 0, 0
    while at + 4 <= len(t):
        p = last.get(t[at : at + 4], -256)
        last[t[at : at + 4]] = at
        if at - p >= 256:
            at += 1
            continue
        n, d = 4, at - p
        while at + n < len(t) and t[p + n] == t[at + n]:
            n += 1
        found, covered, at = found + 1, covered + n, at + n
        again += d in recent
        recent = [d, *[x for x in recent if x != d][:3]]
    return covered, found, again


@settings(deadline=None, max_examples=150)
@given(st.one_of(st.binary(max_size=400), st.text(alphabet="ab ", max_size=900).map(str.encode), st.lists(st.sampled_from([b"word ", b"other ", b"x" * 7, bytes(300)]), max_size=60).map(b"".join)))
def test_near_matches_are_those_of_the_plain_loop(t):
    assert P.near_of(t) == plain_near(t)


def test_types_are_those_of_the_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, "\x00" * 3000)], "doc_id long, text string")
    docs = docs.union(odd)
    h = P.byte_histogram(docs)
    want = {r.doc_id: r.type for r in P.datatype(P.order0(h), P.normal_chars(h), P.near_matches(docs)).collect()}
    assert {r.doc_id: r.type for r in P.types(docs).collect()} == want


class _Server(http.server.BaseHTTPRequestHandler):
    """/r serves ranges, and breaks its first answers off half-way; /w is served whole."""

    data = bytes(range(256)) * 40
    broken: ClassVar[list[int]] = [2]

    def do_GET(self):
        part, status = self.data, 200
        if self.path == "/r" and (m := re.match(r"bytes=([0-9]+)-([0-9]+)", self.headers.get("Range", ""))):
            a, b = int(m[1]), int(m[2])
            part, status = self.data[a : b + 1], 206
            if len(part) > 100 and self.broken[0]:
                self.broken[0] -= 1
                part = part[: len(part) // 2]
        elif self.path not in ("/r", "/w"):
            self.send_error(404)
            return
        self.send_response(status)
        if status == 206:
            self.send_header("Content-Range", f"bytes {a}-{b}/{len(self.data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


def test_ranges_behind_a_server(spark):
    from stratafold.sources import http as web

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://127.0.0.1:{server.server_port}"
        f = web.RangeFile(f"{root}/r", {"bypass": "127.0.0.1"})
        assert f.size == 10240 and f.ranges and f.seek(-6, 2) == 10234 and f.read() == _Server.data[-6:]
        f.seek(1000)
        assert f.read(500) == _Server.data[1000:1500] and f.tell() == 1500
        web.register(spark)
        rows = spark.read.format("http_ranges").option("url", f"{root}/r {root}/w").option("block", 3000).option("bypass", "127.0.0.1").load().collect()
        ranged = sorted((r.start, bytes(r.data)) for r in rows if r.url.endswith("/r"))
        assert [a for a, _ in ranged] == [0, 3000, 6000, 9000] and b"".join(x for _, x in ranged) == _Server.data
        assert [(r.start, r.size, bytes(r.data)) for r in rows if r.url.endswith("/w")] == [(0, 10240, _Server.data)]
        with pytest.raises(urllib.error.HTTPError):
            web.RangeFile(f"{root}/none", {"bypass": "127.0.0.1"})
    finally:
        server.shutdown()


def test_cursor_and_hints(spark, tmp_path):
    data = archive_file.pack([("tor", [("d", f"{i}.txt", i, b"x" * i) for i in range(5)])])
    (tmp_path / "one.arc").write_bytes(data)
    cursor = archive_file.items(spark, str(tmp_path / "one.arc"))
    assert next(cursor).name == "0.txt" and [r.name for r in cursor] == [f"{i}.txt" for i in range(1, 5)]
    C.register("upper", bytes.upper, bytes.lower, memory=1 << 20, threads=2)
    try:
        assert C.chain_hints("upper+tor") == (1 << 20, 2)
    finally:
        del C.CODECS["upper"]
    with pytest.raises(ValueError, match="no service"):
        S.service(F.lit("aes"), "colour?")
