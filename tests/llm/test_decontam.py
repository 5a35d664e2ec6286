import hashlib
import random
import re

import pytest

from stratafold.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(decontam.UPPER, decontam.LOWER)


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wins = []
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        wins += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    out = []
    for name, text in docs:
        w, hit, found = split(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
        out.append((name, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed, short):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "é", "7"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(10, 14))) for i in range(6)] + [(90, None), (91, " ., "), (7, "a " * 15)]
    items += [(100 + n, text(n)) for n in short]
    docs = [(i, text(r.randint(0, 60))) for i in range(30)] + [(50, None), (51, ""), (52, "a " * 300)]
    docs += [(60 + i, text(5) + ",;" + items[i][1].upper().replace("É", "é") + "!" + text(9)) for i in range(5)]
    docs += [(70 + i, text(4) + " " + items[i][1] + "\n" + items[i + 1][1]) for i in range(5)]
    return docs + docs[:8] + [(None, items[0][1])], items + items[:1]


@pytest.mark.parametrize("seed,short", [(1, []), (2, [1, 4]), (3, [9]), (4, [])])
@pytest.mark.parametrize("shuffled", [False, True])
def test_report_matches_brute_force(spark, monkeypatch, seed, short, shuffled):
    if shuffled:
        monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", 0)
    docs, items = cases(seed, short)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontam.report(d, i).collect()), key=str) == brute(docs, items)
    kept = decontam.decontaminate(d, i)
    assert kept.columns == d.columns
    clean = [x[0] for x in brute(docs, items) if not x[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.report(d, i).collect() == []
    assert [r.n_hit for r in decontam.report(one, i).collect()] == [0]
