import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafold.operators import dictionary as D
from stratafold.operators import records as R
from stratafold.operators import samples as M
from stratafold.operators import secrets as E


def test_a_stereo_signal_is_found():
    t = np.arange(8000)
    both = np.stack([12000 * np.sin(t / 40) + 15000, 9000 * np.cos(t / 25) + 40000 * (t / 8000)], axis=1).astype("<u2")
    assert M.detect(both.tobytes())[1] == 16 and M.difference_cost(both.tobytes(), 2, 2) < M.difference_cost(both.tobytes(), 1, 2)
    assert M.detect(np.random.default_rng(0).bytes(8000)) == [] and M.detect(b"") == [] and M.detect(b"plain words " * 100) == []


@settings(deadline=None)
@given(st.binary(max_size=200), st.integers(1, 4), st.integers(1, 4))
def test_channels_round_trip(data, channels, width):
    assert M.join_channels(M.split_channels(data, channels, width), channels, width) == data


@settings(deadline=None)
@given(st.text("ab\u00b5", max_size=60) | st.text(max_size=30))
def test_lzp_round_trip(text):
    data = text.encode() * 3
    assert R.lzp_decode(R.lzp_encode(data)) == data


def test_dictionary_round_trip(spark):
    from pyspark.sql import functions as F

    rows = [(1, "the cat  the\nthe \ue000 cat \uf8ff\uf8ff the"), (2, ""), (3, "the"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = D.learn(df, 10, 2)
    assert words == ["the", "cat"]
    for known in (words, []):
        x = df.select("doc_id", "text", D.encode(F.col("text"), known).alias("e"))
        assert all(r.text == r.back for r in x.select("text", D.decode(F.col("e"), known).alias("back")).collect())


def test_keys(spark):
    df = spark.createDataFrame([(1, "salt"), (2, None)], "id long, salt string")
    got = {r.id: bytes(r.key) for r in E.derive_keys(df, "id", "salt", "pw", 10).collect()}
    assert got == {1: hashlib.pbkdf2_hmac("sha512", b"pw", b"salt", 10, 32), 2: hashlib.pbkdf2_hmac("sha512", b"pw", b"", 10, 32)}


def _plain_costs(data):
    """The costs of ``lzp``, ``rolz`` and ``lz77`` octet by octet, as they are defined."""

    def entropy(octets):
        n = np.bincount(np.frombuffer(bytes(octets), np.uint8), minlength=256)
        n = n[n > 0]
        return float(-(n * np.log2(n / len(octets))).sum()) / 8 if len(octets) else 0.0

    after, hits, rest = {}, 0, bytearray(data[:4])
    for i in range(4, len(data)):
        hit = after.get(data[i - 4 : i]) == data[i]
        hits += hit
        rest += b"" if hit else data[i : i + 1]
        after[data[i - 4 : i]] = data[i]
    n = len(data) - 4
    lzp = entropy(rest) - sum(k * np.log2(k / n) for k in (hits, n - hits) if k) / 8 if n > 0 else float(len(data))

    def length(p, at, most):
        return next((n for n in range(min(most, len(data) - at)) if data[p + n] != data[at + n]), min(most, len(data) - at))

    places, literals, at, rolz = {}, bytearray(), 0, 0.0
    while at < len(data):
        own = places.get(data[at - 2 : at], [])[::-1][:16] if at >= 2 else []
        sizes = [length(p, at, 255) for p in own]
        best = max(sizes, default=0)
        step = best if best >= 3 else 1
        if best >= 3:
            rolz += (np.log2(sizes.index(best) + 1) + 1 + 2 * np.log2(best)) / 8
        else:
            literals.append(data[at])
        for k in range(max(at, 2), at + step):
            places.setdefault(data[k - 2 : k], []).append(k)
        at += step
    rolz += entropy(literals)
    last, literals, at, lz77 = {}, bytearray(), 0, 0.0
    while at < len(data):
        key = data[at : at + 4]
        p, step = last.get(key, -1), 1
        last[key] = at
        if len(key) == 4 and p >= 0:
            step = length(p, at, len(data))
            lz77 += (np.log2(at - p + 1) + 2 * np.log2(step)) / 8
        else:
            literals.append(data[at])
        at += step
    return lzp, rolz, lz77 + entropy(literals)


_ODD = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde", b"abcab", b"a" * 700, b"ab" * 500, bytes(300), b"the same words again " * 40, bytes(range(256)) * 3]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.text("ab\u00b5 ", max_size=40), st.integers(1, 30)) | st.tuples(st.text(max_size=60), st.integers(1, 2)), max_size=6))
def test_costs_are_those_of_the_definitions(parts):
    texts = [(t * n).encode() for t, n in parts] + _ODD
    for together in (texts, [b"".join(texts)]):
        x = M._Texts(together)
        repeats = M._repeats(x)
        got = zip(M._predicted(x, repeats), M._offsets(x), M._matched(x, repeats), strict=True)
        for data, costs in zip(together, got, strict=True):
            assert np.allclose(costs, _plain_costs(data), rtol=1e-12, atol=1e-9)
            assert costs == (M.predicted_cost(data), M.offset_cost(data), M.matched_cost(data))


def test_models_of_texts_together(spark, tmp_path):
    """Texts of three octets failed; each text's model is the one it has alone, beside others and over the bounds of a group."""
    from stratafold.plans.registry import QUERIES

    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = [None, *docs, "abc", *[t.decode("latin-1") for t in _ODD], "x" * 70_000 + "y" * 9, "word " * 30_000, *docs[:5]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.model for r in QUERIES["model_costs"](spark, str(tmp_path)).collect()}
    octets = [(t or "").encode() for t in texts]
    assert got == {i: M.cheapest(b) for i, b in enumerate(octets)}
    assert M.cheapest_each([]) == []
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert QUERIES["model_costs"](spark, str(tmp_path / "none")).collect() == []
    assert M.cheapest_each(octets * 30) == [got[i] for i in range(len(octets))] * 30
    for i, b in enumerate(octets):
        if b and len(b) < 3000 and not M.detect(b):
            order0 = M._entropy(np.frombuffer(b, np.uint8)) / 8
            assert got[i] == min(zip((order0, *_plain_costs(b)), ("order0", "lzp", "rolz", "lz77"), strict=True))[1]
