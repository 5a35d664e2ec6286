import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratafold.llm import _bytesnp as B
from stratafold.llm import langid

ODD = [None, "", "123 --- 456", " \n", "Ä", "日本語", "x" * 400_000, "🙂"]


def brute_bins(text):
    """The bins of each order, one n-gram at a time."""
    _, kind = langid._tables()
    k = [0] + [int(kind[min(ord(c), langid._TOP)]) for c in text] + [0] * 4
    out = [set(), set(), set()]
    m = (1 << 32) - 1
    for i in range(len(text) + 2):
        a, b, c = k[i], k[i + 1], k[i + 2]
        h2 = (((a * 0x85EBCA6B) & m) ^ (b >> 3)) * 0xC2B2AE35 & m
        h3 = ((h2 ^ (c >> 7)) * 0x27D4EB2F) & m
        for s, h, n in zip(out, ((a * 0x9E3779B1) & m, h2, h3), langid.BINS, strict=True):
            s.add(h >> (32 - n.bit_length() + 1))
    return out


def test_collapsed_scores_are_the_nystrom_scores():
    texts = ["the cat sat", "of the and in", "der die das", "und ist nicht", "le la les", "une est pas"]
    y = ["en", "en", "de", "de", "fr", "fr"]
    col = B.strings(pa.array(texts))
    x = np.concatenate([langid.presence(p) for p in langid._pieces(col)]).astype(np.uint8)
    for row, text in zip(x, texts, strict=True):
        got = [set(np.flatnonzero(row[at : at + n])) for at, n in zip(langid.STARTS, langid.BINS, strict=True)]
        assert got == brute_bins(text)
    model = langid.fit(x, y, landmarks=6)
    marks = x[np.concatenate([np.flatnonzero(np.asarray(y) == c) for c in model.languages])]
    k = langid._kernel(marks, marks)
    values, vectors = np.linalg.eigh(k)
    root = (vectors / np.sqrt(values)) @ vectors.T
    phi = langid._kernel(x, marks) @ root
    target = np.where(np.asarray(y)[:, None] == np.asarray(model.languages), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + langid.RIDGE * np.eye(len(root)), phi.T @ target)
    assert np.allclose(phi @ w, model.scores(x.astype(np.float32)), atol=1e-3)


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(90_000 + i, t, "xx" if t is None else None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    model = langid.train(both, ~langid.held_out())
    got = {r.doc_id: r for r in langid.predict(both, model, carry=["doc_id"]).collect()}
    truth = [r for r in docs.select("doc_id", "lang", "text", langid.held_out().alias("h")).collect() if r.h and len(r.text) > 60]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in truth) >= 0.97 * len(truth)
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (0, 1, 2, 3, 7):
        assert got[90_000 + i].lang_pred == "und" and got[90_000 + i].score == 0
    for i in (4, 5, 6):
        assert got[90_000 + i].lang_pred in model.languages
    kept = langid.keep_identified(both.withColumn("score", both.doc_id))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.lang_pred != "und"}


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(3, "abc", "en")]])
def test_nothing_or_little_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out())
    got = langid.predict(docs, model, carry=["doc_id", "lang"], lang_name="p").collect()
    assert [r.p for r in got] == [r[2] or "und" for r in rows]


def test_the_query_against_the_long_form(spark):
    """Landmarks, their kernel's root and the ridge weights one by one, on the presence rows of every document."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64(F.lit("train"), "doc_id").alias("h")).orderBy("h").collect()
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    pieces = list(langid._pieces(B.strings(pa.array([r.text for r in docs]))))
    x = np.concatenate([langid.presence(p) for p in pieces]).astype(np.uint8)
    letter = np.concatenate([p.has_letter for p in pieces])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs])
    learn = np.array([not h and r.lang is not None and bool(ok) for r, h, ok in zip(docs, held, letter, strict=True)])
    y = np.array([r.lang for r in docs], object)
    share = langid.TRAIN_ROWS // len(set(y[learn]))
    assert max(np.sum(y[learn] == c) for c in set(y[learn])) <= share  # all are learnt from here
    languages = sorted(set(y[learn]))
    rows = np.flatnonzero(learn)
    marks = x[np.concatenate([rows[y[rows] == c][: langid.LANDMARKS // len(languages)] for c in languages])]
    values, vectors = np.linalg.eigh(langid._kernel(marks, marks))
    keep = values > 1e-6 * values.max()
    root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    phi = langid._kernel(x, marks) @ root
    weight = np.array([len(rows) / (len(languages) * np.sum(y[rows] == c)) for c in y[rows]])[:, None]
    target = np.where(y[rows][:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi[rows].T @ (phi[rows] * weight) + langid.RIDGE * np.eye(len(root)), phi[rows].T @ (target * weight))
    scores = phi @ w
    for i, r in enumerate(docs):
        q = got[r.doc_id]
        assert q.held_out == held[i]
        if not letter[i]:
            assert (q.lang_pred, q.score) == ("und", 0)
            continue
        best = np.sort(scores[i])[::-1]
        if len(best) < 2 or best[0] - best[1] > 2e-2:
            assert q.lang_pred == languages[int(np.argmax(scores[i]))]
        assert q.score == pytest.approx(np.clip((best[0] + 1) / 2, 0, 1), abs=1e-2)


def test_very_long_texts_are_read_whole(spark):
    """A language that only the end of a long text shows is what its n-grams say, as those of the text in any order."""
    model = langid.fit(np.concatenate([langid.presence(p) for p in langid._pieces(B.strings(pa.array(["abc abd abe", "xyz xyw xyv"])))]).astype(np.uint8), ["a", "x"], landmarks=2)
    filler = "1 " * 700_000
    docs = spark.createDataFrame([(1, filler + "xyz xyw xyv"), (2, "xyz xyw xyv")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.predict(docs, model, carry=["doc_id"]).collect()}
    assert got[1][0] == got[2][0] == "x"
