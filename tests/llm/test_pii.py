import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from stratafold.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


ODD = [
    None, "", "a@b@c.d", "a@b.c+d@e.f", "x@y", "a.b@c-d.e.f.", "é🙂 a@b.cd 🙂 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0255.00000000000000000001", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111111111", "4111  1111", "+1 (555) 555-1234", "+1 (5", "++44 20 7946 0958.", "+12345678 +123456789",
    "+1 555-123-4567+1 555-123-4568", "1" * 3000, "a" * 3000 + "@", "a@" * 20_000, "1." * 20_000, "1 " * 20_000, "+" * 5000, "@@@.", "mail (at) host (dot) org", "٣.٣.٣.٣ ４１１１",
]


def random_texts(n):
    r = random.Random(5)
    alphabet = ["a", "B", "7", "0", "41", ".", "@", "-", " ", "+", "(", ")", "é", "4111111111111111", "1.2.3.4", "x@y.zz", "+1 555 123 4567", "\n", "%"]
    return ["".join(r.choices(alphabet, k=r.randint(1, 30))) for _ in range(n)]


def as_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2])))


def test_base_spans_match_brute_force(spark, tmp_path):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = list(enumerate(real + ODD + random_texts(400)))
    rows += rows[-5:] + [(0, "other 1.2.3.4")]
    spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op8_pii_boosted(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((d, *(sum(s[0] == k for s in brute(t)) for k in pii.KINDS), hashlib.sha256(as_text(brute(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted(tuple(r)[:6] for r in got) == want
    texts = {d: t for d, t in rows if d}
    for r in got:
        if r.doc_id:
            base = {f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id])}
            assert base <= set(filter(None, r.spans.split(",")))


def test_local_numbers_are_learnt_from_international_ones(spark):
    r = random.Random(1)
    number = lambda: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    rows = [(i, f"call me at +1 {number()} now") for i in range(400)] + [(1000, f"or {number()} there"), (1001, "years 1999 2004 and 12 of 34"), (1002, "4111 1111 1111 1112 no card")]
    got = {x.doc_id: x for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("id", "doc_id").collect()}
    assert got[1000].kind == "phone" and (got[1000].start, got[1000].end, got[1000].base) == (3, 17, False)
    assert 1001 not in got and 1002 not in got
    out = {x.doc_id: x.text for x in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000] == "or [phone] there" and out[0] == "call me at [phone] now" and out[1001] == rows[401][1]


def test_long_runs_take_linear_time(spark):
    """The plain patterns would look at these some 10^11 times."""
    rows = [(0, "a" * 500_000 + "@"), (1, "7" * 500_000), (2, "1." * 100_000), (3, "x" * 500_000 + " b@c.de")]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("id <> 2").collect()
    assert [(r.id, r.kind, r.start, r.end) for r in got] == [(3, "email", 500_001, 500_007)]


def test_trees_and_calibration():
    cells = [((a, b), 10.0, 10.0 if a and b else 0.0) for a in (0, 1) for b in (0, 1)]
    trees = pii.boost(cells)
    scores = {x: sum(pii._walk(t, x) for t in trees) for x, _, _ in cells}
    assert scores[1, 1] > 0 > max(v for k, v in scores.items() if k != (1, 1))
    assert pii.calibrate(trees, cells, ["x"] * 4) == {"x": scores[1, 1]}
    assert pii.calibrate(trees, [((1, 1), 10.0, 1.0)], ["x"]) == {}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a@b.cd")]])
def test_small(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(pii.find_spans(docs).collect()) == sum("@" in (t or "") for _, t in rows)
    assert pii.redact(docs).count() == len(rows)


def test_many_formats_are_counted_in_coarser_bins(spark, monkeypatch):
    """More cells than MAX_CELLS: no failure, every base span, and the numbers still learnt."""
    r = random.Random(2)
    number = lambda: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    odd = ["".join(r.choice("0123456789 .-/(") for _ in range(40)) for _ in range(300)]
    rows = [(i, f"call me at +1 {number()} now") for i in range(400)] + [(1000, f"or {number()} there")] + list(enumerate(odd, 2000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cells in (100, 1):
        monkeypatch.setattr(pii, "MAX_CELLS", cells)
        got = pii.find_spans(docs).collect()
        assert sorted((x.id, x.kind, x.start, x.end) for x in got if x.base) == sorted((d, *s) for d, t in rows for s in brute(t))
        assert [(x.kind, x.start, x.end) for x in got if x.id == 1000] == [("phone", 3, 17)]


def test_scores_do_not_hang_on_a_limit_of_cells(spark, monkeypatch):
    """The bins were those of a corpus's number of cells, and so were the scores."""
    rows, _ = planted(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for cells in (50_000, 100, 1):
        monkeypatch.setattr(pii, "MAX_CELLS", cells)
        got.append(sorted((x.id, x.kind, x.start, x.end, x.base, x.score) for x in pii.find_spans(docs).collect()))
    assert got[0] == got[1] == got[2] and any(not x[4] for x in got[0])


def test_last_bins_are_fewer_than_the_limit(spark):
    values = spark.range(32).select(F.col("id").cast("int").alias("v"))
    sizes = [values.select(c).distinct().count() for c in pii.binned([F.col("v")] * len(pii.FEATURES), 2)]
    last = dict(zip(pii.FEATURES, sizes, strict=True)) | {"gen": len(pii.GENERATORS), "valid": 2, "key": 2}
    assert 2 * math.prod(last.values()) <= pii.MAX_CELLS


def planted(n=240):
    """(rows, spans that no base pattern finds, decoys that are no personal data)."""
    r = random.Random(7)
    d = lambda k: "".join(r.choices("0123456789", k=k))

    def card(ok, sep):
        while True:
            x = "4" + d(15)
            if luhn(x) == ok:
                return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    octets = lambda sep: sep.join(str(r.randint(1, 255)) for _ in range(4))
    phone = lambda: f"({r.randint(200, 999)}) 555-{d(4)}"
    base = [lambda: f"mail x{d(3)}@host{d(2)}.org", lambda: f"seen {octets('.')} there", lambda: f"paid {card(True, ' ')} today", lambda: f"reach +1 {phone()} now"]
    loose = [
        ("email", "write to {} soon", lambda: f"bob{d(3)} [at] host{d(2)} [dot] org"), ("email", "by {} or", lambda: f"ann.{d(2)} (at) site{d(1)}.com"),
        ("ip", "the server {} is up", lambda: octets(" . ")), ("card", "with {} then", lambda: card(True, ".")), ("card", "visa {} then", lambda: card(True, "/")),
        ("phone", "call {} then", phone), ("phone", "or {} there", phone),
    ]
    decoys = [lambda: f"meet bob (at) 5.{d(2)} ok", lambda: f"sum {octets(' . ').replace(' . ', ' . 9', 1)}99 end", lambda: f"no {card(False, '.')} here", lambda: f"some {r.randint(10, 99)} {d(3)} {d(3)} rows"]
    rows, want = [], []
    for i in range(n):
        rows += [(len(rows) + j, f()) for j, f in enumerate(base)]
        for kind, around, f in loose:
            x = f()
            want.append((len(rows), kind, around.index("{}"), around.index("{}") + len(x)))
            rows.append((len(rows), around.format(x)))
        rows += [(len(rows) + j, f()) for j, f in enumerate(decoys)]
    return rows, want


def test_recall_on_planted_spans_of_other_forms(spark):
    rows, want = planted()
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.id, x.kind, x.start, x.end) for x in got if x.base) == sorted((d, *s) for d, t in rows for s in brute(t))
    added = {(x.id, x.kind, x.start, x.end) for x in got if not x.base}
    for kind in pii.KINDS:
        planted_of, added_of = {w for w in want if w[1] == kind}, {a for a in added if a[1] == kind}
        print(kind, "recall", len(planted_of & added_of) / len(planted_of), "precision", len(planted_of & added_of) / max(1, len(added_of)))
        assert len(planted_of & added_of) >= 0.95 * len(planted_of)
        assert len(planted_of & added_of) >= 0.95 * len(added_of)
