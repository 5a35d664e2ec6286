"""Quality rules as a short-circuit cascade.

Each rule reads one or two features of a text and rejects it or not; a text is kept if no rule
rejects it. Rules differ in what their features cost (a byte count against the hashing of all
five-word windows) and in how many texts they reject, so the cascade runs them on a bounded
sample first, measures both, orders them by rejections per second and then evaluates each rule
only on the texts that the earlier ones let pass. As a text is kept only if every rule passes
it, the order changes the time and never the verdict.

A text's features are computed once, whoever asks for them: those that a caller wants for every
text cost the cascade nothing, and are left out of the rules' costs; what a rule needs beside them
is computed for the texts that reach it.

Defined results: texts of any length are read whole, a batch of them in slices of about a
megabyte or one longer text; a null text is an empty text; it has no words and fails ``few_words``. Every
row gets its own result, repeated or not; an empty table gives an empty one; other columns are
carried through by ``keep`` and not read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import _bytesnp as B
from stratafold.llm._common import small_batches, table

#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True


class Features:
    """The features of one slice of texts, each computed when first asked for.

    count: gets for every feature the texts it was computed for.
    """

    def __init__(self, s: B.Slice, count: Counter | None = None) -> None:
        self.s = s
        self.n = len(s.ends) - 1
        self.count = count
        self.known: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str):
        if name not in self.known:
            if self.count is not None:
                self.count[name] += self.n
            self.known[name] = getattr(type(self), f"_{name}")(self)
        return self.known[name]

    def only(self, rows: np.ndarray) -> Features:
        """Of only those texts; what is known of a text stays known."""
        out = Features(_subset(self.s, rows), self.count)
        out.known = {x: v[rows] for x, v in self.known.items() if x.startswith(("n_", "word_chars"))}
        return out

    def _spans(self):
        return B.word_spans(self.s)

    def _n_words(self):
        return np.bincount(self.spans[2], minlength=self.n).astype(np.int64)

    def _word_chars(self):
        return B.sums(B.IS_START[self.s.buf] & ~B.IS_WS[self.s.buf], self.s.ends)

    def _n_symbols(self):
        return B.sums(_SYMBOL[self.s.buf], self.s.ends)

    def _n_upper(self):
        return B.sums(_UPPER[self.s.buf], self.s.ends)

    def _n_lower(self):
        return B.sums(_LOWER[self.s.buf], self.s.ends)

    def _lines(self):
        """Hash and document of each line with a word."""
        start, end, doc = B.line_spans(self.s)
        words = np.zeros(len(self.s.buf) + 1, np.int64)
        np.cumsum(~B.IS_WS[self.s.buf], out=words[1:])
        has = words[end] > words[start]
        start, end, doc = start[has], end[has], doc[has]
        return B.span_hashes(self.s.buf, start, end), doc

    def _n_lines(self):
        return np.bincount(self.lines[1], minlength=self.n).astype(np.int64)

    def _n_dup_lines(self):
        h, doc = self.lines
        key = B.mix(h + (doc.astype(B.U64) + B.U64(1)) * B._BASE)
        first = np.unique(key, return_index=True)[1]
        return self.n_lines - np.bincount(doc[first], minlength=self.n)

    def _word_hashes(self):
        start, end, _ = self.spans
        return B.span_hashes(self.s.buf, start, end)

    def _n_stutter(self):
        """Words that equal the one before."""
        h, doc = self.word_hashes, self.spans[2]
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        return np.bincount(doc[1:][same], minlength=self.n).astype(np.int64)

    def _n_repeat_words(self):
        doc = self.spans[2]
        h, at = B.windows(self.word_hashes, doc, 5)
        key = B.mix(h + (doc[at].astype(B.U64) + B.U64(1)) * B._BASE)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(doc), bool)
        for j in range(5):
            covered[at[twice] + j] = True
        return np.bincount(doc[covered], minlength=self.n).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """rejects: from the features, an array that is true where the text is rejected."""

    name: str
    rejects: Callable[[Features], np.ndarray]


def default_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda f: f.n_words < 10),
        Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
        Rule("long_words", lambda f: f.word_chars > 25 * f.n_words),
        Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
        Rule("capitals", lambda f: f.n_upper > f.n_lower + 20),
        Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
        Rule("stutter", lambda f: 10 * f.n_stutter > 3 * f.n_words),
    ]


def _subset(s: B.Slice, rows: np.ndarray) -> B.Slice:
    """The slice of only those documents."""
    sizes = np.diff(s.ends)[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(len(s.ends) - 1, bool)
    flags[rows] = True
    return B.Slice(s.first, s.buf[np.repeat(flags, np.diff(s.ends))], ends)


def cascade(f: Features, rules: Sequence[Rule], spent: np.ndarray | None = None) -> np.ndarray:
    """Per document the index of the rule that rejects it first, or -1.

    Where fewer than half of the documents are left, later rules work on a copy of those only.
    spent: gets seconds, evaluated and rejected documents of each rule.
    """
    out = np.full(f.n, -1)
    rows = np.arange(f.n)
    alive = np.ones(f.n, bool)
    for i, rule in enumerate(rules):
        if not alive.any():
            break
        if alive.sum() * 2 < len(alive):
            f = f.only(np.flatnonzero(alive))
            rows = rows[alive]
            alive = np.ones(len(rows), bool)
        began = time.perf_counter()
        bad = np.asarray(rule.rejects(f), bool) & alive
        if spent is not None:
            spent[i] += (time.perf_counter() - began, alive.sum(), bad.sum())
        out[rows[bad]] = i
        alive &= ~bad
    return out


def estimate(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features: Sequence[str] = ()) -> list[tuple[str, float, float]]:
    """(rule, seconds per text, share rejected) of every rule alone on a sample of the texts, beside known features.

    The sample is drawn row by row in the scan, so nothing is shuffled but a row for each rule
    and task. It only decides the order of the rules, which no verdict depends on.
    """
    rules = list(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = np.zeros((len(rules), 3))
        for batch in batches:
            for s in B.slices(B.strings(batch.column(0))):
                known = Features(s)
                for x in features:
                    getattr(known, x)
                for i, rule in enumerate(rules):  # each by itself, with nothing else shared
                    f = Features(s)
                    f.known = {x: known.known[x] for x in features}
                    cascade(f, [rule], spent[i : i + 1])
        yield pa.RecordBatch.from_pydict({"i": list(range(len(rules))), "s": spent[:, 0].tolist(), "n": spent[:, 1].tolist(), "bad": spent[:, 2].tolist()})

    got = (
        docs.select(text_col).sample(min(1.0, sample_rows / max(1, docs.count())), seed=1)
        .mapInArrow(B.tidy(measure), "i long, s double, n double, bad double")
        .groupBy("i").agg(F.sum("s"), F.sum("n"), F.sum("bad")).orderBy("i").collect()
    )
    return [(rules[r[0]].name, r[1] / max(r[2], 1), r[3] / max(r[2], 1)) for r in got]


def ordered_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features: Sequence[str] = ()) -> list[Rule]:
    """The rules by rejections per second, most first; ties by name."""
    rank = {n: (-bad / max(sec, 1e-9), n) for n, sec, bad in estimate(docs, rules, text_col, sample_rows, features)}
    return sorted(rules, key=lambda r: rank.get(r.name, (0.0, r.name)))


def verdicts(
    docs: DataFrame, rules: Sequence[Rule] | None = None, *, text_col: str = "text", features: Sequence[str] = (), carry: Sequence[str] = (),
    sample_rows: int = SAMPLE_ROWS, as_name: str = "rejected_by",
) -> DataFrame:
    """carry's columns, the named features (for every text), and the rule that rejects (null: kept)."""
    rules = ordered_rules(docs, default_rules() if rules is None else rules, text_col, sample_rows, features)
    names = [r.name for r in rules]
    small_batches(docs.sparkSession)
    picked = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[str, list[np.ndarray]] = {x: [] for x in (*features, "__by")}
            for s in B.slices(B.strings(batch.column(len(carry)))):
                f = Features(s)
                for x in features:
                    got[x].append(getattr(f, x))
                got["__by"].append(cascade(f, rules))
            whole = {x: np.concatenate(v) if v else np.zeros(0, np.int64) for x, v in got.items()}
            cols = [batch.column(i) for i in range(len(carry))] + [pa.array(whole[x], pa.int64()) for x in features]
            cols.append(pa.array([None if i < 0 else names[i] for i in whole["__by"]], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*(f"__c{i}" for i in range(len(carry))), *features, as_name])

    kinds = [f"__c{i} {picked.schema[i].dataType.simpleString()}" for i in range(len(carry))]
    out = picked.mapInArrow(B.tidy(run), ", ".join([*kinds, *(f"{x} bigint" for x in features), f"{as_name} string"]))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *features, as_name)


def keep(docs: DataFrame, rules: Sequence[Rule] | None = None, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects; the same columns."""
    by = "__rejected_by"
    out = verdicts(docs, rules, text_col=text_col, carry=docs.columns, sample_rows=sample_rows, as_name=by)
    return out.where(F.col(by).isNull()).drop(by)


def op9_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """Which rule rejects a text first depends on measured times, so only whether one does is returned."""
    docs = table(spark, sf_dir, "documents")
    features = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = verdicts(docs, features=features, carry=["doc_id"])
    return out.select(
        "doc_id", *features,
        F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, i, w[i : i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, unnest(spots) AS i FROM (SELECT r, list(i) AS spots FROM x GROUP BY r, g HAVING count(*) > 1)),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) v(j) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
stutter AS (SELECT r, count(*) AS n FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d) WHERE w[i] = w[i + 1] GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, coalesce(stutter.n, 0) AS n_stutter,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r) LEFT JOIN stutter USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 25 * n_words OR 10 * n_symbols > 3 * n_words OR n_upper > n_lower + 20
       OR 2 * n_dup_lines > n_lines OR 10 * n_stutter > 3 * n_words) AS kept
FROM b
"""
