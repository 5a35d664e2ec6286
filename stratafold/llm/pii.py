"""Personal data by boosted trees over proposed spans.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and international phone
numbers; each base match that passes its check (octets, Luhn, number of digits) is a span and
always stays. Looser generators propose further, overlapping spans: numbers without a country
code, written-out addresses, digits with other separators. Which of them are personal data is
decided by gradient boosted trees over features of format (digits, groups, separators, checks)
and context (the characters around, a key word in the 24 before), trained here on the corpus itself
and blind to which generator proposed a span. A
candidate is positive where a passing base span of its kind covers it; negative where its check
fails, where a span of another kind overlaps it, or where the base pattern reads its form and
yet did not pass. Forms that no base pattern reads (``loose``) are positive where form and
context speak for them (``_evidence``), and else unlabelled: these count ``UNLABELLED`` of a
negative in training and nothing in calibration. The threshold of each generator is calibrated
on a fold of documents that the trees have not seen: the lowest score at which ``PRECISION`` of
the fold's labelled candidates are positive. A generator that reaches it at no score, or has no
labelled candidate in the fold, adds nothing.

Only DataFrame expressions touch the data. Features are binned (``binned``), so all candidates
of any corpus fall into 36,864 cells at most; their counts and positives are one aggregation, the
trees are fitted on the cells, and they score candidates as one arithmetic expression. The bins
are the same for every corpus, whatever its size.

Defined results: a null text is an empty one without spans; rows that repeat an id and a text
each get the same result, rows that repeat an id alone keep their own; an empty table gives no
rows; texts of any length are scanned whole, in time proportional to their length; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm._common import cut, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PRECISION, ROUNDS, DEPTH, RATE = 0.95, 24, 3, 0.4
#: What the bins have to keep below, so that the driver can hold the cells; a bound on their design that no run looks at.
MAX_CELLS = 50_000
#: What an unlabelled candidate weighs as a negative in training.
UNLABELLED = 0.1
#: Name, kind, whether it is the base pattern, the pattern, and what a text must hold to be searched.
#: Possessive and anchored forms of the base patterns: the same matches without backtracking.
GENERATORS = (
    ("email", "email", True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "at"),
    ("ip", "ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit"),
    ("card", "card", True, r"[0-9](?:[\x20-]?[0-9]){12,}+", "digit"),
    ("phone", "phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "plus"),
    ("written_email", "email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z0-9-]++)++", "written"),
    ("spaced_ip", "ip", False, r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9.]?[0-9])", "digit"),
    ("marked_card", "card", False, r"[0-9](?:[\x20./-]?[0-9]){12,18}+(?![0-9])", "digit"),
    ("local_phone", "phone", False, r"(?<![0-9.])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", "digit"),
)
_BASE = [g[0] for g in GENERATORS if g[2]]
_KIND = {g[0]: g[1] for g in GENERATORS}
_KEYWORD = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|account|address|host|ip)\W{0,3}$"
_SMALL = r"(?:\W+(?:me|us|at|on|is|no|number))*\W{0,3}$"
#: Key words of a kind right before a candidate; e-mail addresses are told by their form.
_HINTS = {
    "ip": r"(?i)\b(?:ip|ipv4|host|server|addr|address)" + _SMALL,
    "card": r"(?i)\b(?:card|visa|mastercard|amex|account)" + _SMALL,
    "phone": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|contact)" + _SMALL,
}
_WRITTEN = r"^[^\[(]*[A-Za-z][^\[(]*[\[(].*[.)\]]\x20?(?:[a-z]{2,}|[A-Z]{2,})$"
_CARD_GROUPS = r"^[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([./])[0-9]{6}\2[0-9]{5}$"
_EVEN_IP = r"^[0-9]+(?:\x20\.\x20[0-9]+){3}$"
FEATURES = ("gen", "digits", "groups", "first", "last", "length", "seps", "valid", "before", "after", "key")


def binned(columns: Sequence[Column], level: int = 2) -> list[Column]:
    """The features, FEATURES' order, in so few bins that two folds have 36,864 cells. There is one level only, whatever the corpus."""
    if level != 2:
        raise ValueError(level)
    f = dict(zip(FEATURES, columns, strict=True))
    f["digits"] = (f["digits"] >= 9).cast("int") + (f["digits"] >= 13).cast("int")
    f["groups"] = (f["groups"] >= 2).cast("int") + (f["groups"] >= 4).cast("int")
    f |= {x: f[x] >= at for x, at in (("first", 3), ("last", 4), ("length", 3), ("seps", 4), ("before", 2), ("after", 2))}
    return [c.cast("int") for c in f.values()]


def _class(c: Column) -> Column:
    """Of a character: 0 none, 1 white space, 2 letter, 3 digit, 4 other."""
    return (
        F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)
    )


def _loose() -> Column:
    """Whether no base pattern reads the candidate's form."""
    return (
        F.when(F.col("gen") == "spaced_ip", F.contains("m", F.lit(" ")))
        .when(F.col("gen") == "marked_card", F.col("m").rlike("[./]"))
        .otherwise(F.col("gen").isin("written_email", "local_phone"))
    )


def _evidence(valid: Column) -> Column:
    """Whether form and context speak for a candidate of loose form."""
    hint = F.coalesce(*[F.when(F.col("kind") == k, F.col("left").rlike(p)) for k, p in _HINTS.items()], F.lit(False))
    form = (
        F.when(F.col("gen") == "written_email", F.lit(True))
        .when(F.col("gen") == "spaced_ip", F.col("m").rlike(_EVEN_IP))
        .when(F.col("gen") == "marked_card", F.col("m").rlike(_CARD_GROUPS))
        .otherwise(F.lit(False))
    )
    return _loose() & valid & (hint | form)


def _luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))
    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, gen, kind, start, end, base, features...) of every proposed span."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"), text_or_empty(text_col).alias("t"))
    has = {
        "at": F.contains("t", F.lit("@")),
        "plus": F.contains("t", F.lit("+")),
        "digit": F.col("t").rlike("[0-9]"),
        "written": F.col("t").rlike(r"[\[(]\x20?at\x20?[\])]"),
    }
    none = F.array().cast("array<string>")
    d = d.select("*", *[F.when(has[g[4]], F.regexp_extract_all("t", F.lit(g[3]), F.lit(0))).otherwise(none).alias(g[0]) for g in GENERATORS])
    d = d.where(F.greatest(*[F.size(g[0]) for g in GENERATORS]) > 0)
    # the text between the matches gives their places: each is searched once more where there are any
    d = d.select("*", *[F.when(F.size(g[0]) > 0, F.split("t", g[3], -1)).otherwise(none).alias(f"p_{g[0]}") for g in GENERATORS])

    def rows(g: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            before, after = F.get(f"p_{g}", i), F.get(f"p_{g}", i + 1)
            return F.struct(F.lit(g).alias("gen"), i.alias("i"), m.alias("m"), F.length(before).alias("gap"),
                            F.right(before, F.lit(24)).alias("left"), F.left(after, F.lit(1)).alias("right"))

        return F.transform(g, one)

    c = d.select("id", "key", F.explode(F.concat(*[rows(g[0]) for g in GENERATORS])).alias("c")).select("id", "key", "c.*")
    # rows that repeat an id and a text propose the same spans
    c = c.repartition("id", "key", "gen").dropDuplicates(["id", "key", "gen", "i"])
    upto = Window.partitionBy("id", "key", "gen").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    c = c.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    c = c.withColumn("kind", F.coalesce(*[F.when(F.col("gen") == g, F.lit(k)) for g, k in _KIND.items()]))
    c = c.withColumn("ds", F.regexp_replace("m", "[^0-9]+", "")).withColumn("gs", F.regexp_extract_all("m", F.lit("[0-9]+"), F.lit(0)))
    n = F.length("ds")
    # at most 255: up to three digits after leading zeros
    small = F.forall("gs", lambda g: (F.length(F.regexp_replace(g, "^0+", "")) <= 3) & (F.coalesce(F.right(g, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    valid = (
        F.when(F.col("kind") == "ip", (F.size("gs") == 4) & small)
        .when(F.col("kind") == "card", n.between(13, 19) & _luhn(F.when(n <= 19, F.col("ds")).otherwise(F.lit(""))))
        .when(F.col("gen") == "phone", n.between(9, 15))
        .when(F.col("gen") == "written_email", F.col("m").rlike(_WRITTEN))
        .otherwise(F.lit(True))
    )
    seps = sum((F.contains("m", F.lit(s)).cast("int") * (1 << i) for i, s in enumerate((" ", "-", ".", "("))), F.lit(0))
    return c.select(
        "id", "key", "gen", "kind", "start", "end", (F.col("gen").isin(*_BASE) & valid).alias("base"),
        _loose().alias("loose"), _evidence(valid).alias("evidence"),
        F.least(n, F.lit(20)).alias("digits"),
        F.least(F.size("gs"), F.lit(6)).alias("groups"),
        F.least(F.coalesce(F.length(F.get("gs", F.lit(0))), F.lit(0)), F.lit(5)).alias("first"),
        F.least(F.coalesce(F.length(F.try_element_at("gs", F.lit(-1))), F.lit(0)), F.lit(5)).alias("last"),
        F.least(F.floor(F.length("m") / 6).cast("int"), F.lit(6)).alias("length"),
        seps.alias("seps"), valid.cast("int").alias("valid"),
        _class(F.right("left", F.lit(1))).alias("before"), _class(F.col("right")).alias("after"),
        F.col("left").rlike(_KEYWORD).cast("int").alias("key_word"),
    ).withColumnRenamed("key_word", "key_before")


def labelled(c: DataFrame) -> DataFrame:
    """covered: a base span of the kind holds the candidate; touches: one overlaps it.

    foreign: a base span of another kind overlaps it, or it is a local phone number within a loose
    form of another kind that has evidence. label: 1, 0, or null where nothing tells.
    """
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    place = Window.partitionBy("id", "key", "kind").orderBy("start", F.col("base").desc(), "end", "gen")
    before = F.max(base_end).over(place.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("id", "key", "kind").orderBy(F.desc("start"), F.desc("end"), "gen")  # running, as frames to the end cost the square
    after = F.min(base_start).over(back.rowsBetween(Window.unboundedPreceding, 0))
    c = c.select(
        "*",
        F.coalesce(before >= F.col("end"), F.lit(False)).alias("covered"),
        (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))).alias("touches"),
    )
    local = F.col("gen") == "local_phone"
    strong = F.col("base") | (F.col("evidence") & ~local)
    anywhere = Window.partitionBy("id", "key").orderBy("start", strong.desc(), F.col("base").desc(), "end", "gen").rowsBetween(Window.unboundedPreceding, 0)
    anywhere_back = Window.partitionBy("id", "key").orderBy(F.desc("start"), F.desc("end"), "gen").rowsBetween(Window.unboundedPreceding, 0)

    def overlapped(by: Column) -> Column:
        left = F.max(F.when(by, F.col("end"))).over(anywhere) > F.col("start")
        right = F.min(F.when(by, F.col("start"))).over(anywhere_back) < F.col("end")
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    c = c.select("*", (~F.col("touches") & F.when(local, overlapped(strong)).otherwise(overlapped(F.col("base")))).alias("foreign"))
    label = (
        F.when(F.col("covered"), 1).when((F.col("valid") == 0) | F.col("foreign"), 0).when(F.col("touches"), None)
        .when(~F.col("loose"), 0).when(F.col("evidence"), 1)
    )
    return c.withColumn("label", label.cast("int"))


# --- boosted trees over cells -------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """value <= at goes left."""

    feature: int
    at: float
    left: Split | Leaf
    right: Split | Leaf


Cell = tuple[tuple[int, ...], float, float]  # features, candidates, positives


def _leaf(rows: Sequence[tuple[tuple[int, ...], float, float]]) -> Leaf:
    return Leaf(RATE * sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1.0))


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int) -> Split | Leaf:
    """rows: features, gradient, hessian."""
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-6, None, 0.0)
    for f in range(len(rows[0][0]) if depth else 0):
        sums: dict[int, list[float]] = {}
        for x, g, h in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        g, h = 0.0, 0.0
        for v in sorted(sums)[:-1]:
            g, h = g + sums[v][0], h + sums[v][1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, f, v)
    if best[1] is None:
        return _leaf(rows)
    _, f, v = best
    return Split(f, v, _grow([r for r in rows if r[0][f] <= v], depth - 1), _grow([r for r in rows if r[0][f] > v], depth - 1))


def _walk(tree: Split | Leaf, x: Sequence[int]) -> float:
    while isinstance(tree, Split):
        tree = tree.left if x[tree.feature] <= tree.at else tree.right
    return tree.value


def boost(cells: Sequence[Cell], rounds: int = ROUNDS, depth: int = DEPTH) -> list[Split | Leaf]:
    """Trees whose sum is the log odds that a candidate is positive."""
    trees: list[Split | Leaf] = []
    margin = [0.0] * len(cells)
    for _ in range(rounds if cells else 0):
        rows = []
        for (x, n, y), m in zip(cells, margin, strict=True):
            p = 1 / (1 + math.exp(-m))
            rows.append((x, y - n * p, n * p * (1 - p)))
        trees.append(_grow(rows, depth))
        margin = [m + _walk(trees[-1], c[0]) for m, c in zip(margin, cells, strict=True)]
    return trees


def calibrate(trees: Sequence[Split | Leaf], cells: Sequence[Cell], kinds: Sequence[str], precision: float = PRECISION) -> dict[str, float]:
    """Per kind (any name that kinds gives the cells) the lowest margin at which the cells at or above it are positive often enough."""
    out = {}
    for kind in set(kinds):
        scored = sorted(((sum(_walk(t, x) for t in trees), n, y) for (x, n, y), k in zip(cells, kinds, strict=True) if k == kind), reverse=True)
        n = y = 0.0
        for i, (m, a, b) in enumerate(scored):
            n, y = n + a, y + b
            if y >= precision * n and m > 0 and (i + 1 == len(scored) or scored[i + 1][0] < m):
                out[kind] = m
    return out


def margin(trees: Sequence[Split | Leaf], columns: Sequence[Column]) -> Column:
    def expression(tree: Split | Leaf) -> Column:
        if isinstance(tree, Leaf):
            return F.lit(tree.value)
        return F.when(columns[tree.feature] <= F.lit(tree.at), expression(tree.left)).otherwise(expression(tree.right))

    out = F.lit(0.0)
    for t in trees:
        out = out + expression(t)
    return out


# --- the operator -------------------------------------------------------------------------


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """(id, key, kind, start, end, base, score) of every span; key is the text's xxhash64."""
    c = cut(labelled(candidates(docs, id_col, text_col)))
    gens = [g[0] for g in GENERATORS]
    gen = F.coalesce(*[F.when(F.col("gen") == g, F.lit(i)) for i, g in enumerate(gens)])
    columns = binned([gen, *[F.col("key_before" if f == "key" else f) for f in FEATURES[1:]]])
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id", "key"), F.lit(4)) == 0
    cells = (
        c.groupBy(fold.alias("fold"), *[x.alias(f"x{i}") for i, x in enumerate(columns)])
        .agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("y"), F.count_if(F.col("label").isNull() & ~F.col("touches")).alias("u"))
        .orderBy("fold", *[f"x{i}" for i in range(len(columns))])
        .collect()
    )
    # trees see format and context only: which generator proposed a span is left to the calibration
    of = lambda r: tuple(r[2 : 1 + len(columns)])
    learn = [(of(r), r.n + UNLABELLED * r.u, float(r.y)) for r in cells if not r.fold and r.n + r.u]
    held = [(of(r), float(r.n), float(r.y)) for r in cells if r.fold and r.n]
    trees = boost(learn)
    limits = calibrate(trees, held, [gens[r.x0] for r in cells if r.fold and r.n], precision)
    c = c.withColumn("score", 1 / (1 + F.exp(-margin(trees, columns[1:]))))
    limit = F.lit(2.0)  # above every score
    for name, m in sorted(limits.items()):
        limit = F.when(F.col("gen") == name, F.lit(1 / (1 + math.exp(-m)) - 1e-12)).otherwise(limit)
    c = c.where(F.col("base") | (~F.col("touches") & ~F.col("foreign") & (F.col("valid") == 1) & (F.col("score") >= limit)))
    return c.select("id", "key", "kind", "start", "end", "base", "score")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]", precision: float = PRECISION) -> DataFrame:
    """docs with every span replaced by its kind's mark; the same columns.

    Overlapping spans are replaced as one, under the kind of the first.
    """
    s = find_spans(docs, id_col=id_col, text_col=text_col, precision=precision)
    s = s.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans"))
    text = text_or_empty(docs[text_col])
    joined = docs.join(s, docs[id_col].eqNullSafe(s["id"]) & (F.xxhash64(text) == s["key"]), "left")
    before, after = mark.split("{}")

    def step(a: Column, x: Column) -> Column:
        new = x["start"] >= a["at"]
        piece = F.concat(F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(before), x["kind"], F.lit(after))
        return F.struct(F.when(new, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate("__spans", zero, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    out = F.when(F.col("__spans").isNull(), docs[text_col]).otherwise(done)
    return joined.select(*[out.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op8_pii_boosted(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = find_spans(docs)
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    one = F.struct(rank.alias("k"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("s"))
    per = spans.groupBy("id", "key").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("b"),
        F.array_sort(F.collect_set(one)).alias("a"),
    )
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["s"]), ","), F.lit(""))
    d = docs.select("doc_id", F.xxhash64(text_or_empty("text")).alias("__key"))
    return d.join(per, d["doc_id"].eqNullSafe(per["id"]) & (d["__key"] == per["key"]), "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(names("b").cast("binary"), 256).alias("base_sha256"),
        names("a").alias("spans"),
    )
