"""Language identification with a string kernel.

A text is its set of character n-grams, n from 1 to 3, each order in hashed bins. The blended
presence kernel of two texts is the mean over n of |common n-grams| / sqrt(|one| * |other|). A
stratified set of training texts serves as Nyström landmarks: with K their kernel matrix, a
text's features are its kernel values to the landmarks times K^(-1/2), and one-versus-rest
kernel ridge regression on them gives a score for each language.

Scoring is a matrix product for each batch of texts. The kernel is linear in a text's presence
vector, so landmarks, K^(-1/2) and ridge weights are multiplied into one matrix (bins by
languages) once, and a batch is (texts by bins) times that matrix, with a column of ones for
each order that counts the text's own n-grams for the norm.

Training texts are a bounded sample of the labelled rows: at most ``TRAIN_ROWS`` in all, spread
evenly over the languages and chosen by a hash of the id; of more than ``TRAIN_ROWS`` languages
the most frequent are learnt, and the others are never predicted. What is gathered of each is its
bit set (``BITS`` / 8 bytes), whatever its length.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text where there is nothing to learn from; equal scores go to the language that sorts first;
repeated rows get the same result; texts of any length are read whole; other columns are
carried through by ``keep_identified`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm import _bytesnp as B
from stratafold.llm._common import small_batches, table

UNDETERMINED = "und"
#: Bins of the n-grams of each order.
BINS = (1 << 10, 1 << 13, 1 << 14)
BITS = sum(BINS)
STARTS = (0, BINS[0], BINS[0] + BINS[1])
TRAIN_ROWS, LANDMARKS, RIDGE = 2400, 320, 1e-2
#: Characters and texts of one matrix product.
PIECE_CHARS, PIECE_TEXTS = 1 << 18, 64
#: Letters lie below this code point.
_TOP = 0x32400
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter; its class (0: no letter, else by its lower case)."""
    if not _TABLES:
        letter = np.fromiter((chr(c).isalpha() for c in range(_TOP)), bool, _TOP)
        kind = np.zeros(_TOP + 1, np.uint32)
        for c in np.flatnonzero(letter).tolist():
            kind[c] = ord(chr(c).lower()[0])
        kind = np.where(kind > 0, (kind * np.uint32(2654435761)) | np.uint32(1), np.uint32(0))
        _TABLES.extend([np.append(letter, False), kind])
    return _TABLES[0], _TABLES[1]


@dataclass
class Piece:
    """The n-gram bins of some texts: (text, bin) indices of each order."""

    texts: int
    has_letter: np.ndarray
    cells: list[np.ndarray]


def _pieces(col: pa.Array) -> Iterator[Piece]:
    letter, kind = _tables()
    for s in B.slices(col):
        raw = s.buf.tobytes()
        i = 0
        while i < len(s.ends) - 1:
            j = min(len(s.ends) - 1, i + PIECE_TEXTS)
            j = max(i + 1, min(j, int(np.searchsorted(s.ends, s.ends[i] + PIECE_CHARS, side="right")) - 1))
            texts = [raw[s.ends[x] : s.ends[x + 1]].decode("utf-8", "replace") for x in range(i, j)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            # each text between spaces, so that no n-gram spans two texts' letters
            points = np.frombuffer((" " + "  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
            points = np.minimum(points, _TOP)
            of = np.repeat(np.arange(len(texts)), sizes + 2)
            k = kind[points[: len(of) + 1]]
            own = np.bincount(of, weights=letter[points[: len(of)]], minlength=len(texts)) > 0
            none = np.zeros(2, np.uint32)
            a, b, c = k[: len(of)], np.append(k[1 : len(of)], none[:1]), np.append(k[2 : len(of)], none)
            c[np.cumsum(sizes + 2) - 1] = 0  # the space after a text sees nothing of the next one
            h2 = (a * np.uint32(0x85EBCA6B)) ^ (b >> np.uint32(3))
            h2 *= np.uint32(0xC2B2AE35)
            h3 = (h2 ^ (c >> np.uint32(7))) * np.uint32(0x27D4EB2F)
            bins = [h >> np.uint32(32 - int(n).bit_length() + 1) for h, n in zip((a * np.uint32(0x9E3779B1), h2, h3), BINS, strict=True)]
            yield Piece(len(texts), own, [of * BITS + at + x for x, at in zip(bins, STARTS, strict=True)])
            i = j


def presence(piece: Piece, room: np.ndarray | None = None) -> np.ndarray:
    """(texts, bins) with 1 where the text has an n-gram of the bin. room: zeros to use."""
    out = np.zeros((piece.texts, BITS), np.float32) if room is None else room[: piece.texts]
    flat = out.reshape(-1)
    for c in piece.cells:
        flat[c] = 1.0
    return out


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x, y: uint8 presence rows; x in slices of 256, as floats take four times the room."""
    out = np.zeros((len(x), len(y)))
    for at, n in zip(STARTS, BINS, strict=True):
        b = y[:, at : at + n].astype(np.float32)
        size = np.maximum(b.sum(1), 1)
        for i in range(0, len(x), 256):
            a = x[i : i + 256, at : at + n].astype(np.float32)
            out[i : i + 256] += (a @ b.T) / np.sqrt(np.outer(np.maximum(a.sum(1), 1), size)) / len(BINS)
    return out


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # (BITS, languages + orders), float32

    def scores(self, x: np.ndarray) -> np.ndarray:
        """x: presence rows."""
        out, n = np.zeros((len(x), len(self.languages)), np.float32), len(self.languages)
        for i, (at, bins) in enumerate(zip(STARTS, BINS, strict=True)):
            got = x[:, at : at + bins] @ self.matrix[at : at + bins]
            out += got[:, :n] / np.sqrt(np.maximum(got[:, n + i : n + i + 1], 1))
        return out


def fit(x: np.ndarray, y: Sequence[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """x: uint8 presence rows of the training texts, y: their languages."""
    languages = sorted(set(y))
    y = np.asarray(y)
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(y == c)[:each] for c in languages])
    marks = x[chosen]
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    keep = values > 1e-6 * values.max()
    root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    phi = _kernel(x, marks) @ root
    target = np.where(y[:, None] == np.asarray(languages)[None, :], 1.0, -1.0)
    # rows weigh so that every language counts the same
    weight = np.sqrt(len(y) / (len(languages) * np.asarray([np.sum(y == c) for c in y])))[:, None]
    phi_w = phi * weight
    w = np.linalg.solve(phi_w.T @ phi_w + ridge * np.eye(phi.shape[1]), phi_w.T @ (target * weight))
    alpha = root @ w
    matrix = np.zeros((BITS, len(languages) + len(BINS)), np.float32)
    for i, (at, n) in enumerate(zip(STARTS, BINS, strict=True)):
        own = marks[:, at : at + n].astype(np.float64)
        norm = np.sqrt(np.maximum(own.sum(1), 1))
        matrix[at : at + n, : len(languages)] = own.T @ (alpha / norm[:, None]) / len(BINS)
        matrix[at : at + n, len(languages) + i] = 1
    return Model(languages, matrix)


def train(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """A model from the rows where ``learn`` is true and a language is given; None without any.

    Two scans: languages are counted, then about ``rows`` texts, as many of each language as
    there are up to an even share, are sampled by a hash of their ids.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # a row for each language
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(rows).collect()}
    if not counts:
        return None
    share = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col(lang_col) == lang) & (draw < min(1.0, 1.15 * share / n)))
    picked = usable.where(wanted).select(F.xxhash64(F.lit("train"), F.col(id_col)).alias("h"), F.col(lang_col).alias("y"), F.col(text_col).alias("t"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = []
            for piece in _pieces(B.strings(batch.column(2))):
                packed = np.packbits(presence(piece).astype(np.uint8), axis=1)
                rows_ += [packed[i].tobytes() if piece.has_letter[i] else None for i in range(piece.texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows_, pa.binary())], names=["h", "y", "x"])

    got = picked.mapInArrow(B.tidy(bits), "h long, y string, x binary").where("x is not null").orderBy("h").limit(2 * rows).collect()
    taken: dict[str, int] = {}
    kept = []
    for r in got:
        if taken.setdefault(r.y, 0) < share:
            taken[r.y] += 1
            kept.append(r)
    if not kept:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(r.x for r in kept), np.uint8).reshape(len(kept), -1), axis=1)
    return fit(x, [r.y for r in kept])


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", carry: Sequence[str] = (), lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """carry's columns, the language of every text, and its score from 0 to 1."""
    small_batches(docs.sparkSession)
    picked = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.zeros((PIECE_TEXTS, BITS), np.float32)
        names = np.asarray((model.languages if model else []) + [UNDETERMINED], object)
        for batch in batches:
            langs, scores = [np.zeros(0, object)], [np.zeros(0)]
            for piece in _pieces(B.strings(batch.column(len(carry)))):
                if model is None:
                    best, value = np.full(piece.texts, -1), np.zeros(piece.texts)
                else:
                    got = model.scores(presence(piece, room))
                    room[: piece.texts] = 0
                    best = np.where(piece.has_letter, got.argmax(1), -1)
                    value = np.where(piece.has_letter, np.clip((got.max(1) + 1) / 2, 0, 1), 0.0)
                langs.append(names[best])
                scores.append(value)
            cols = [batch.column(i) for i in range(len(carry))]
            cols += [pa.array(np.concatenate(langs).tolist(), pa.string()), pa.array(np.concatenate(scores).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f"__c{i}" for i in range(len(carry))), lang_name, score_name])

    kinds = [f"__c{i} {picked.schema[i].dataType.simpleString()}" for i in range(len(carry))]
    out = picked.mapInArrow(B.tidy(run), ", ".join([*kinds, f"{lang_name} string", f"{score_name} double"]))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], lang_name, score_name)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 4 == 2


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose text has no identifiable language; the same columns."""
    model = train(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = predict(docs, model, text_col=text_col, carry=docs.columns, lang_name="__lang", score_name="__score")
    return out.where(F.col("__lang") != UNDETERMINED).drop("__lang", "__score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return predict(docs, model, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
