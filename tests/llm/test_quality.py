import re
from collections import Counter

import pyarrow as pa
import pytest

from stratafold.llm import _bytesnp as B
from stratafold.llm import quality

SF = "/root/testdata/sf0.001"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


ODD = [None, "", " \n\t ", "one", "\n\n", "a b c d e a b c d e", "x " * 50, "é ü\r\nß\x0bq\x0c", "l\nl\n l\nl", "#*$%&|<>", "ends\n", "word\x1fnot split", "a" * 3_000_000, "日本 語 🙂", "p q\n" * 4000]


def test_features_match_brute_force(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = real + [(-i, t) for i, t in enumerate(ODD, 1)] * 2  # repeated rows
    docs = spark.createDataFrame([(a, b, "n") for a, b in rows], "doc_id long, text string, n_words string")
    got = quality.verdicts(docs, features=FEATURES, carry=["doc_id"]).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert tuple(r[x] for x in FEATURES) == brute(texts[r.doc_id]), r.doc_id


def test_order_changes_no_verdict_and_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.default_rules()
    one = {(r.doc_id, r.rejected_by is None) for r in quality.verdicts(docs, rules, carry=["doc_id"]).collect()}
    two = {(r.doc_id, r.rejected_by is None) for r in quality.verdicts(docs, rules[::-1], carry=["doc_id"], sample_rows=1).collect()}
    assert one == two
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, ok in one if ok}
    ranked = quality.ordered_rules(docs, rules)
    assert {r.name for r in ranked} == {r.name for r in rules}


def test_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.verdicts(docs, features=["n_words"], carry=["doc_id"]).join(labels, "doc_id").collect()
    good = [r.rejected_by is None or r.n_words < 10 or r.rejected_by == "repeated_windows" for r in got if r.quality == 1]
    assert sum(good) == len(good)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.verdicts(docs, features=FEATURES, carry=["doc_id"]).collect()
    assert [r.rejected_by for r in got] == ["few_words"] * len(rows)


def rejected(text):
    """The default rules one by one, in Python."""
    n, chars, symbols, dup, repeat = brute(text)
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return {
        "few_words": n < 10, "repeated_windows": 100 * repeat > 20 * n, "long_words": chars > 25 * n, "symbols": 10 * symbols > 3 * n,
        "capitals": upper > lower + 20, "repeated_lines": 2 * dup > len(lines), "stutter": 10 * stutter > 3 * n,
    }


def test_the_query_against_brute_force(spark, tmp_path):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = ["w" * 40 + f"{i} " for i in range(30)]
    rows = real + [(-i, t) for i, t in enumerate([*ODD, "".join(long), "AB CD " * 30, " ".join(f"a{i} a{i}" for i in range(30))], 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.op9_quality_cascade(spark, str(tmp_path)).collect()
    by = {r.doc_id: r.rejected_by for r in quality.verdicts(spark.read.parquet(str(tmp_path / "documents.parquet")), carry=["doc_id"]).collect()}
    assert len(got) == len(rows)
    texts, seen = dict(rows), set()
    for r in got:
        want = brute(texts[r.doc_id])
        bad = rejected(texts[r.doc_id])
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert (*(r[x] for x in FEATURES), r.base_failed, r.kept) == (*want, failed, not any(bad.values())), r.doc_id
        assert by[r.doc_id] is None if r.kept else bad[by[r.doc_id]]
        seen |= {k for k, v in bad.items() if v}
    assert seen == {r.name for r in quality.default_rules()}


def test_the_cascade_saves_evaluations():
    texts = ["too short"] * 60 + [f"a line of some length with the number {i} in it and more words" for i in range(40)]
    count = Counter()
    f = quality.Features(next(B.slices(B.strings(pa.array(texts)))), count)
    for x in FEATURES:  # what a caller wants of every text
        getattr(f, x)
    by = quality.cascade(f, quality.default_rules())
    assert (by == 0).sum() == 60 and (by == -1).sum() == 40
    assert all(count[x] == 100 for x in FEATURES)  # once
    assert all(count[x] == 40 for x in ("n_upper", "n_lower", "n_stutter"))  # of those that are left
    alone = Counter()
    quality.cascade(quality.Features(f.s, alone), quality.default_rules())
    assert alone["n_words"] == 100 and alone["n_repeat_words"] == alone["n_symbols"] == alone["n_dup_lines"] == 40
