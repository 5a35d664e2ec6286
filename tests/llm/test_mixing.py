import hashlib
import math
import re
from collections import Counter

import pytest

from stratafold.llm import mixing


def level(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share, cut at the caps, share the rest again, until nothing is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * w[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 50, None: 9}, {"z": 0, "a": 3}, {f"s{i}": (i * 37) % 101 + 1 for i in range(40)}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(level(sizes))


def test_whole_mix(spark):
    rows = [(i, "w " * (1 + i % 9), "s%d" % (i % 3), "x") for i in range(3000)] + [(9000, None, None, "y"), (9001, "", "s0", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    first, again = sorted(out.collect()), sorted(mixing.mix_documents(docs.repartition(7)).collect())
    assert first == again
    taken, size = {}, {}
    for r in first:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len((r[1] or "").split())
    want = level(size)
    for s in ("s0", "s1", "s2"):
        assert taken[s] == pytest.approx(want[s], rel=0.05)
    per = {}
    for r in first:
        per[r.doc_id] = per.get(r.doc_id, 0) + 1
    assert max(per.values()) <= 2


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 3, "s%d" % (i % 5) if i % 7 else None) for i in range(400)], "doc_id long, text string, source string")
    one = sorted(mixing.mix_documents(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "MAX_BROADCAST_BYTES", 0)
    assert sorted(mixing.mix_documents(docs).collect(), key=str) == one


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs).collect() == []


def brute(rows):
    """How often each (id, text, source) row is taken: targets by resharing, copies by the id's draw."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = level(sizes)
    out = Counter()
    for row in rows:
        rate = target[row[2]] / sizes[row[2]] if sizes[row[2]] else 0.0
        draw = int(hashlib.md5(f"mix:{'null' if row[0] is None else row[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[row] += math.floor(rate) + (draw < rate - math.floor(rate))
    return +out


def test_copies_against_brute_force(spark):
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [*real, (9001, None, None), (9002, "a b", None), (None, "c d e", "src0"), (9003, "x", "zz"), (9003, "x", "zz"), real[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix_documents(docs).collect())
    assert got == brute(rows)
