import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.functions import script as L
from stratafold.operators import records as R

BYTES = st.binary(max_size=400)


@settings(deadline=None)
@given(BYTES, st.integers(0, 4), st.integers(1, 30), st.data())
def test_round_trips(data, kind, width, draw):
    assert R.from_planes(R.to_planes(data, kind), kind) == data
    roles = draw.draw(st.lists(st.booleans(), min_size=width, max_size=width))
    assert R.table_undiff(R.table_diff(data, width, roles), width, roles) == data
    roles, packed = R.table_encode(data, width)
    assert R.table_decode(roles, packed, width) == data
    assert R.rep_decode(R.rep_encode(data * 3 + b"x" + data, 8)) == data * 3 + b"x" + data


@settings(deadline=None)
@given(st.binary(min_size=1, max_size=60) | st.text("ab", min_size=1, max_size=40).map(str.encode))
def test_sorts_against_brute_force(data):
    turns = sorted(range(len(data)), key=lambda i: (data[i:] + data[:i], i))
    assert R.sorted_by_context(data) == bytes(data[i - 1] for i in turns)
    four = sorted(range(len(data)), key=lambda i: ((data[i:] + data * 4)[:4], i))
    if len(data) >= 4:
        assert R.sorted_by_context(data, 4) == bytes(data[i - 1] for i in four)
    if len(set(data[i:] + data[:i] for i in range(len(data)))) == len(data):
        assert R.unsorted(R.sorted_by_context(data), turns.index(0)) == data


def test_record_kinds():
    assert R.record_kind(b"") == 0 and R.record_kind(os.urandom(5000)) == 0
    assert R.record_kind(b"".join((1000 * 1000 + 3 * i).to_bytes(4, "little") for i in range(2000))) == 4
    # a slow walk gains from differences, noise within a narrow range only from planes
    walk = np.cumsum(np.random.default_rng(1).integers(-3, 4, 20000)) + 30000
    assert R.record_kind(walk.astype("<u2").tobytes()) == 3
    noise = np.random.default_rng(2).integers(30000, 30060, 20000)
    assert R.record_kind(noise.astype("<u2").tobytes()) == 1


def test_difference_carries_between_columns():
    rows = b"".join(v.to_bytes(2, "little") for v in (250, 260, 5))
    assert R.table_diff(rows, 2, [True, True]) == b"".join((v % 65536).to_bytes(2, "little") for v in (250, 10, 5 - 260))


def test_blocks_end_where_the_bytes_change():
    ends = R.block_bounds(os.urandom(60000) + b"ab" * 30000)
    # a window that holds the change can pass whole
    assert ends[-1] == 120000 and any(abs(e - 60000) < R.FIRST_BLOCK // 2 for e in ends)
    assert R.block_bounds(b"") == [] and R.block_bounds(b"abc") == [3]


def test_long_repeats_are_found():
    a = os.urandom(5000)
    assert len(R.rep_encode(a + b"?" + a)) < 5100


def test_wav_header():
    fmt = b"fmt " + (16).to_bytes(4, "little") + bytes([1, 0, 2, 0]) + bytes(8) + bytes([4, 0, 16, 0])
    wav = b"RIFF\0\0\0\0WAVE" + b"LIST\3\0\0\0abc\0" + fmt + b"data\4\0\0\0abcd"
    assert R.wav_header(wav) == [2, 16, len(wav) - 4]
    assert R.wav_header(b"RIFF") is None and R.wav_header(b"") is None


def test_script_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("key = value-1 (x)",), ("",)], "s string")
    s = F.col("s")
    got = df.select(L.match(s, "^(%w+)%s*="), L.gsub(s, "(%a+)-(%d)", "%2:%1"), L.find(s, "%("), L.gmatch(s, "%a+"), L.sub(s, -3, -2), L.match(s, "= (.-)%-"), L.byte(s)).collect()
    assert tuple(got[0]) == ("key", "key = 1:value (x)", 15, ["key", "value", "x"], "(x", "value", 107)
    assert tuple(got[1]) == (None, "", None, [], "", None, None)
    with pytest.raises(ValueError, match="%b"):
        L.pattern("%b()")
    n = spark.createDataFrame([(-3.75,), (0.0,), (8.0,)], "x double")
    x = F.col("x")
    rows = n.select(L.modf(x), L.frexp(x), L.ldexp(L.frexp(x)["m"], L.frexp(x)["e"])).collect()
    assert [(tuple(r[0]), tuple(r[1]), r[2]) for r in rows] == [((-3.0, -0.75), (-0.9375, 2), -3.75), ((0.0, 0.0), (0.0, 0), 0.0), ((8.0, 0.0), (0.5, 4), 8.0)]
    t = spark.createDataFrame([("0x10",), (" 1e2 ",), ("z",), ("7f",)], "t string")
    assert [tuple(r) for r in t.select(L.tonumber(F.col("t")), L.tonumber(F.col("t"), 16)).collect()] == [(16.0, None), (100.0, 482.0), (None, None), (None, 127.0)]
