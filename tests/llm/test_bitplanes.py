import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratafold.llm import bitplanes
from stratafold.llm._common import scratch

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 2]), st.sampled_from([1, 7, 64]))
def test_round_trip(ids, mode, block):
    assert bitplanes.decode_planes(bitplanes.encode_planes(np.asarray(ids, np.uint32), mode, block)).tolist() == ids


def test_broken_payloads():
    payload = bitplanes.encode_planes(np.arange(100, dtype=np.uint32))
    with pytest.raises(ValueError):
        bitplanes.decode_planes(payload[:-1])
    with pytest.raises(ValueError):
        bitplanes.decode_planes(b"XXXX" + payload[4:])


ODD = [None, "", "   ", "á b", "It's we'll DON'T", "x<|endoftext|>y <|startoftext|>", "日本　語 🙂", "a b c\x1fd", "ΟΔΟΣ ΟΔΟΣ.", "́ combining first", "1234567890 12.5%", "q" * 50_000, "İstanbul ǅ ŉ", "H\u0331. h\u0331, A\u0301.", "<|ENDOFTEXT|>, <|endoftext|>.", "a., .a a.. 1. 2, é. É, x's. X'S, '. ,. U.S.A.", "\u00a0a.\u2003B,"]


@pytest.mark.parametrize("mode", [1, 2])
def test_files_hold_the_tokenizers_ids(spark, mode):
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = real + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_001, "")]  # an id that repeats
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, start long").repartition(3)
    path = scratch(spark, "t")
    bitplanes.write_tokens(docs, path, VOCABULARY, mode=mode, block=100, chunk_ids=5000, shards=5)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want, start = [], 0
    for name, text in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((name, start, ids))
        start += len(ids)
    got = [(r.doc_id, r.start, r.ids) for r in bitplanes.read_tokens(spark, path).collect()]
    assert sorted(got) == want
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in bitplanes.read_digests(spark, path).collect()}
    for name, at, ids in want:
        assert digests[name, at] == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))


def test_a_small_cache_changes_nothing():
    texts = pa.array([f"w{i % 7} W{i}. tail, {i}" for i in range(500)], pa.large_string())
    small, large = bitplanes.WordEncoder(VOCABULARY, 50), bitplanes.WordEncoder(VOCABULARY)
    for i in range(0, 500, 20):
        a, b = small.encode(texts.slice(i, 20)), large.encode(texts.slice(i, 20))
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert len(small.at) < 200


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bitplanes.tokenised(docs).collect() == []


def brute(rows, vocabulary=VOCABULARY):
    """(id, start, n, crc) of rows in their order."""
    tokenizer, out, start = Tokenizer.from_file(vocabulary), [], 0
    for name, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((name, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_another_vocabulary_encodes_whole_texts(spark):
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert not bitplanes.WordEncoder(other).by_word and bitplanes.WordEncoder(VOCABULARY).by_word
    rows = [(i, t) for i, t in enumerate([*ODD, "two  blanks", " lead", "x <|endoftext|> y"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, bitplanes.tokenised(docs, other).collect())) == brute(rows, other)


def test_an_id_that_repeats_is_spread_over_shards(spark):
    rows = [(7, f"text number {i}") for i in range(300)] + [(i, f"other {i}") for i in range(100)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = scratch(spark, "t")
    bitplanes.write_tokens(docs, path, VOCABULARY, shards=8)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    assert sum(7 in c.doc_ids for c in chunks) >= 4
    got = sorted(map(tuple, bitplanes.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, *range(7), *[7] * 301, *range(8, 100)]
    want = brute(rows)
    assert sorted((str(a), c, d) for a, _, c, d in got) == sorted((str(a), c, d) for a, _, c, d in want)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0


def test_the_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    assert sorted(map(tuple, bitplanes.op4_token_planes(spark, "/root/testdata/sf0.001").collect())) == brute(rows)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet=list("aZé É'sS.,%#-_<|>1 9ßİΣς́  \x1c\t\nñ×ªendoftxt"), max_size=30), min_size=1, max_size=6))
def test_words_and_tails_are_the_tokenizers(texts):
    tokenizer = ENCODER.tokenizer
    ids, sizes = ENCODER.encode(pa.array(texts, pa.large_string()))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


ENCODER = bitplanes.WordEncoder(VOCABULARY)


def test_bounds_on_memory_change_no_result(spark):
    """The same files with a small cache, small pieces and tokenizers given back."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    small = bitplanes.tokenised(docs, cache_words=500, piece_bytes=10_000, release=True).collect()
    assert sorted(map(tuple, small)) == brute(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_workers_give_back_what_they_held(spark):
    """In the worker's own module: the encoders after release, and the powers that a long text called for."""
    from stratafold.llm import _bytesnp as B

    def run(batches):
        for batch in batches:
            bitplanes.word_encoder(VOCABULARY).encode(pa.array(["some words"], pa.large_string()))
            B.span_hashes(np.zeros(3 * B.SLICE, np.uint8), np.array([0]), np.array([5]))
            assert B.held_powers() > 3 * B.SLICE and bitplanes.held_encoders() == 1
            bitplanes.forget_encoders()
            B.give_back()
            yield pa.RecordBatch.from_pydict({"n": [bitplanes.held_encoders()], "p": [B.held_powers()]})

    assert [tuple(r) for r in spark.range(1).coalesce(1).mapInArrow(run, "n long, p long").collect()] == [(0, 1)]
