import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.functions import scalars as S
from stratafold.operators import archive as A
from stratafold.operators import codecs as C
from stratafold.operators import transforms as T
from stratafold.plans.hooks import Hooks
from stratafold.sources import text_sources as X


def test_packed_size_moves_to_the_first_accepted_file(spark):
    f = spark.createDataFrame([("a", 0, i, 10, f"d{i % 2}") for i in range(4)] + [("a", 1, 9, 5, "d0")], "grp string, block long, file_id long, size long, dir string")
    k = spark.createDataFrame([("a", 0, 100), ("a", 1, 50)], "grp string, block long, packed_size long")
    whole = {r.file_id: r.packed for r in A.attribute_packed(f, k).collect()}
    assert whole == {0: 100, 1: 0, 2: 0, 3: 0, 9: 50}
    part = {r.file_id: r.packed for r in A.attribute_packed(f.where("file_id > 0 and file_id < 9"), k).collect()}
    assert part == {1: 100, 2: 0, 3: 0}


@pytest.mark.parametrize(
    "mode,want",
    [
        ("replace", {"same": (5, "updated"), "newer": (9, "updated"), "older": (1, "updated"), "added": (3, "added"), "gone": (4, "kept")}),
        ("newer", {"same": (5, "kept"), "newer": (9, "updated"), "older": (6, "kept"), "added": (3, "added"), "gone": (4, "kept")}),
        ("freshen", {"same": (5, "kept"), "newer": (9, "updated"), "older": (6, "kept"), "gone": (4, "kept")}),
        ("sync", {"same": (5, "kept"), "newer": (9, "updated"), "older": (6, "kept"), "added": (3, "added")}),
    ],
)
def test_update_modes(spark, mode, want):
    old = spark.createDataFrame([("same", 5, 1), ("newer", 2, 1), ("older", 6, 1), ("gone", 4, 1)], "path string, mtime long, size long")
    new = spark.createDataFrame([("same", 5, 2), ("newer", 9, 2), ("older", 1, 2), ("added", 3, 2)], "path string, mtime long, size long")
    assert {r.path: (r.mtime, r.action) for r in A.update(old, new, mode).collect()} == want


def test_unknown_sort_letter(spark):
    with pytest.raises(ValueError, match="sort letters"):
        A.ranked(spark.range(1), "gr")


def test_scalars(spark):
    df = spark.createDataFrame([(x,) for x in ("64mb", "512", "24", "8k", "=1g", "20^", "x", "")], "t string")
    got = [r[0] for r in df.select(S.parse_mem(df.t)).collect()]
    assert got == [67108864, None, 1 << 24, 8192, 1 << 30, 1 << 20, None, None]
    from pyspark.sql import functions as F

    n = spark.createDataFrame([(0,), (5,), (2048,), (3 << 20,), (1 << 30,)], "n long")
    assert [r[0] for r in n.select(S.show_mem(F.col("n"))).collect()] == ["0gb", "5b", "2kb", "3mb", "1gb"]
    p = spark.createDataFrame([("a/b:c\\d.txt",), ("x",)], "p string")
    assert [r[0] for r in p.select(S.base_name(F.col("p"))).collect()] == ["d.txt", "x"]


def test_group_file_and_ini():
    lines = ["; c", "$text", "*.txt ; why", "readme?", "$default", "$z", "*.zip"]
    assert X.parse_group_lines(lines) == [(0, "$text", "*.txt"), (1, "$text", "readme?"), (2, "$default", "*"), (3, "$z", "*.zip")]
    ini = X.parse_ini("[A]\nx = 1 ; c\n\n[B]\ny=z=2\n")
    assert ini == {"A": [("x", "1")], "B": [("y", "z=2")]}
    with pytest.raises(ValueError, match="itself"):
        X.resolve_macro("a", {"a": "b", "b": "a"})


@settings(deadline=None, max_examples=50)
@given(st.binary(max_size=300), st.sampled_from(["storing", "delta", "lzp", "rep", "tor", "grzip", "lzma", "exe"]))
def test_codecs_round_trip(data, name):
    c = C.CODECS[name]
    assert c.decode(c.encode(data)) == data


def test_chain_and_fallback(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 500)), (2, bytearray(b"q")), (3, None)], "id long, data binary")
    packed = C.encode(df, "id", "data", "delta+tor:5")
    by = {r.id: r for r in packed.collect()}
    assert by[1].method == "delta+tor:5" and by[1].comp_size < by[1].orig_size and by[2].method == by[3].method == "storing"
    back = {r.id: bytes(r.data) for r in C.decode(packed, "id").collect()}
    assert back == {1: b"abc" * 500, 2: b"q", 3: b""}
    with pytest.raises(ValueError, match="unknown"):
        C.encode(df, "id", "data", "nosuch")


def test_blocks_and_external_programs(spark):
    rows = [(5, bytearray(bytes(range(250)) * 9)), (6, bytearray()), (7, None)]
    df = spark.createDataFrame(rows, "id long, data binary")
    packed = C.encode_blocks(df, "id", "data", "tor", 100)
    assert packed.where("id = 5").count() == 23
    assert {r.id: bytes(r.data) for r in C.decode_blocks(packed, "id").collect()} == {5: bytes(range(250)) * 9, 6: b"", 7: b""}
    copy = C.external(["cp", "{in}", "{out}"], ["cp", "{in}", "{out}"])
    assert copy.decode(copy.encode(b"some octets")) == b"some octets"
    with pytest.raises(subprocess.CalledProcessError):
        C.external(["false"], ["false"]).encode(b"x")


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_ranges_do_not_change_running_sums(spark, span):
    from pyspark.sql import functions as F

    from stratafold.functions.running import running_before, value_before

    rows = [(None if g == 2 else g, i, (i * 7919 + g) % 100) for g in range(3) for i in range(0, 60, g + 1)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    x = running_before(df, F.col("v"), ["g"], ["i"], F.floor(F.col("i") / span), "sum")
    x = value_before(x, "v", ["g"], ["i"], F.floor(F.col("i") / span), "last")
    want = {(g, i): (sum(v for a, b, v in rows if a == g and b < i), next((v for a, b, v in reversed(rows) if a == g and b < i), None)) for g, i, _ in rows}
    assert {(r.g, r.i): (r.sum, r.last) for r in x.collect()} == want


def test_diff_and_back(spark):
    rows = [(g, i, (i * 7919 + g) % 1000 - 500) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    back = T.undiff(T.diff(df, "v", ["g"], ["i"]).drop("v"), "diff", ["g"], ["i"])
    assert sorted((r.g, r.i, r.value) for r in back.collect()) == sorted(rows)


def test_hooks():
    hooks, seen = Hooks(), []
    hooks.on("command_done", lambda p: seen.append(p["command"]))
    hooks.on("error", lambda p: seen.append(p["message"]))
    with hooks.command("list"):
        pass
    with pytest.raises(RuntimeError), hooks.command("test"):
        raise RuntimeError("bad")
    assert seen == ["list", "bad"]


def test_near_matches_and_types(spark):
    import os

    from stratafold.operators import profile as P

    df = spark.createDataFrame([(1, bytearray(os.urandom(8000))), (2, bytearray(b"\0" * 4000)), (3, None)], "doc_id long, text binary")
    near = {r.doc_id: r for r in P.near_matches(df).collect()}
    assert near[2].match_bytes >= 3990 and near[3].match_bytes == 0
    h = P.byte_histogram(df)
    kinds = {r.doc_id: r.type for r in P.datatype(P.order0(h), P.normal_chars(h), P.near_matches(df)).collect()}
    assert kinds[1] == "$compressed" and kinds[2] == "default" and kinds[3] == "default"


def test_streaming_totals(spark, tmp_path):
    from stratafold.streaming.tail import windowed_totals

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("totals").agg({"n": "sum"}).first()[0] == src.count()


def test_every_query_has_rows(spark):
    from stratafold.plans.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    for name in ("list_verbose", "archive_info", "order0_entropy", "chunk_dedup", "parity_rebuild"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_the_entry_imports_without_a_session():
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
