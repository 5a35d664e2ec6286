import random

import corpus_pipeline
import numpy as np
import pytest

from stratafold.llm import jaccard


def shingle_set(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(id, class, links, copies) by comparing all pairs."""
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    up = {s: s for s in distinct}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    links = dict.fromkeys(distinct, 0)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least, copies = {}, {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s:
            least[root(s)] = min(least.get(root(s), d), d)
            copies[s] = copies.get(s, 0) + 1
    return sorted((d, least[root(s)] if s else d, links[s] if s else 0, copies[s] if s else 1) for (d, _), s in zip(rows, sets, strict=True))


def planted(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.choice([6, 20, 60, 150]))) for _ in range(n)]
    rows = list(base)
    for t in base[: n // 2]:
        for _ in range(r.randint(0, 4)):
            w = t.split()
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(r.choice([" ", "  ", "\n"]).join(w))
    w = base[0].split() * 3
    for _ in range(90):  # one large group of near copies
        x = list(w)
        x[r.randrange(len(x))] = r.choice(vocabulary)
        rows.append(" ".join(x))
    rows += [None, "", " \n", "a", "a", "a b", "a b c d", "a b c d", "e " * 40, "e " * 60] + base[:3]
    r.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed,block,limit", [(1, 128, 10**6), (2, 16, 10**6), (3, 7, 0)])
def test_matches_brute_force(spark, monkeypatch, seed, block, limit):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_BYTES", limit)
    rows = planted(seed)
    docs = spark.createDataFrame([(a, b, b"x") for a, b in rows], "doc_id long, text string, set_id binary")
    assert sorted(map(tuple, jaccard.jaccard_join(docs, block=block).collect())) == brute(rows)


def test_repeated_ids(spark):
    rows = planted(4, 20) + [(100, "another text under the first id altogether"), (100, "another text under the first id altogether")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, class_id int")
    assert sorted(map(tuple, jaccard.jaccard_join(docs).collect())) == brute(rows)


def classes(rows):
    """Lists of (id, text) rows of one class, by comparing all pairs; rows without words by themselves."""
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                up[root(i)] = root(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(root(i), []).append(r)
    return list(out.values())


@pytest.mark.parametrize("seed", [5, 6])
def test_one_document_of_each_class_stays(spark, seed):
    """Ids repeat, across classes and within them; also the four rows of two texts and ids."""
    r = random.Random(seed)
    rows = [(r.choice([None, *range(12)]), t) for _, t in planted(seed, 16)]
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows += [(101, a), (105, a), (105, b), (105, c)]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, class_id int")
    kept = [(x.doc_id, x.text) for x in jaccard.keep_heads(docs).collect()]
    for members in classes(rows):
        if shingle_set(members[0][1]):
            inside = [k for k in kept if k in members]
            least = min((i is None, i or 0) for i, _ in members)
            assert len(inside) == 1 and (inside[0][0] is None, inside[0][0] or 0) == least
    assert {(101, a), (105, b), (105, c)} <= set(kept) and (105, a) not in kept
    words = [k for k in kept if shingle_set(k[1])]
    assert len(words) == sum(bool(shingle_set(m[0][1])) for m in classes(rows))
    assert sorted(map(str, (k for k in kept if not shingle_set(k[1])))) == sorted(str(x) for x in rows if not shingle_set(x[1]))


def test_details(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    near = a.rsplit(" ", 1)[0] + " z"
    rows = [(1, a), (2, a.replace(" ", "\n")), (3, a), (4, near), (5, b), (5, a + " " + b), (6, None)]
    got = {(r.doc_id, r.n_text_links, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), details=True).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 0, 0), (6, 0, 0)}
    keys = [r.class_key for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), details=True).where("doc_id = 5").collect()]
    assert len(set(keys)) == 2 and None not in keys  # two classes that share an id


def test_chains_are_compared_where_they_share_bands(spark):
    """A long chain of texts, each near the next and far from most: few units, no link lost."""
    r = random.Random(8)
    words = [f"v{r.randrange(10**6)}" for _ in range(4000)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_join(docs, block=16).collect())) == brute(rows)
    feats, _ = jaccard._classes(docs, "doc_id", "text", 0.8, 4)
    sets = feats.selectExpr("set_id", "doc_id as rep", "key as rep_key", "1L as n_copies", "1L as n_texts", "node", "bands", "octets")
    keys = sets.selectExpr("node", "explode(bands) as band")
    ties = keys.join(keys.groupBy("band").agg({"node": "min"}).withColumnRenamed("min(node)", "b"), "band").selectExpr("node as a", "b")
    members = jaccard._members(sets, jaccard.components(ties), 4).collect()
    blocks = max(m.blk for m in members) + 1
    assert sum(len(m.others) for m in members) < 0.6 * len(members) * blocks


@pytest.mark.parametrize("limit", [2, 10**6])
def test_hot_keys_are_dealt_over_salts(spark, monkeypatch, limit):
    monkeypatch.setattr("stratafold.llm._common.HOT_ROWS", limit)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = planted(11, 20)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, jaccard.jaccard_join(docs, block=16).collect())) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard.op7_jaccard_join(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == brute(rows)


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, jaccard.jaccard_join(docs).collect())) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "x"), (2, "x")]])
def test_small(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_join(docs).collect())) == brute(rows)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_posterior_bound():
    """Against the Beta posterior integrated numerically."""
    x = np.linspace(0, 1, 200_001)
    for n, m in jaccard.least_matches(0.8):
        for k in (m - 1, m):
            density = x**k * (1 - x) ** (n - k)
            p = density[x >= 0.8].sum() / density.sum()
            assert (p >= jaccard.TOLERANCE) == (k >= m)


def test_classes_that_share_an_id_each_keep_a_document(spark):
    r = random.Random(9)
    text = lambda n=40: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [
        (1, a), (1, b), (1, b),  # two texts under an id, one of them twice
        (2, near(a)), (3, c), (4, near(c)), (4, d),  # 4 is head of one class and no head of another
        (None, e), (None, near(e)), (None, text()), (None, None), (3, None), (5, ""), (5, " "),
    ]
    docs = spark.createDataFrame([(x, y, {"m": i}) for i, (x, y) in enumerate(rows)], "doc_id long, text string, extra map<string,int>")
    kept = jaccard.keep_heads(docs)
    assert kept.columns == docs.columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    least = [t for i, t in got if i is None and t in (e, near(e))]
    assert len(least) == 1
    want = [(1, a), (1, b), (3, c), (4, d), (None, least[0]), rows[9], (None, None), (3, None), (5, ""), (5, " ")]
    assert sorted(got, key=str) == sorted(want, key=str)
    docs = docs.where("doc_id is null or doc_id <> 1")  # no row repeats both
    got = [(x.doc_id, x.text) for x in jaccard.keep_heads(docs).collect()]
    assert sorted(got, key=str) == sorted([(2, near(a)), *want[2:]], key=str)


def test_pipeline_keeps_texts_that_share_an_id(spark):
    rows = [(1, f"text number {i} with {i * 7} and {i * 11} in it", "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 20
