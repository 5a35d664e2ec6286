"""Token ids in a bit-plane binary format.

Documents are ordered by id, tokenised, and their ids written as chunks. A chunk holds whole
documents; its ids are cut into blocks of ``BLOCK`` ids, every block is transposed into bit or
byte planes (plane p holds bit or byte p of all its ids), and each plane is compressed with
zstandard by itself, so that a plane without content costs a few bytes.

A chunk's payload, all numbers little-endian:

    magic   4 bytes  b"SFP1"
    mode    u8       1 byte planes, 2 bit planes
    planes  u8       planes of each block
    -       u16      0
    block   u32      ids of a full block
    n       u64      ids in the chunk
    blocks  u32      number of blocks
    index   blocks * planes * u32   size of each compressed plane, in order
    data    the compressed planes

A file is a Parquet row per chunk: (shard, chunk, n_ids, doc_ids, doc_sizes, payload), written
and committed by Spark's own writer, so a lost executor leaves no half-written file, and any
store that Spark can reach will do. ``shards`` beside it is the chunk index's upper level: ids
in each shard and the ids before it.

Texts are encoded where they are read, and what is shuffled into the order of the documents' ids
is their token ids, two or four octets each. Shards are ranges of document ids, cut at quantiles
of a sample of the ids (which decides their balance and no result); rows that share an id may lie
in several successive shards, so that an id that repeats without bound is no single task's.

Where a vocabulary is known never to join across white space (``WORD_PATTERNS``), each different
word of a piece is encoded once and kept in a cache; other vocabularies encode whole texts. What a
worker holds is bounded in octets: a piece of ``PIECE_BYTES`` of text (or one longer text), and
``CACHE_WORDS`` words of about ``CACHE_BYTES`` in all, of which those that come again are kept.

Defined results: a null text is an empty one and has only the end id; rows that repeat an id
are written one after the other, by their ids; null ids come first; texts of any length are
encoded whole; an empty table makes an empty file; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.llm import _bytesnp as B
from stratafold.llm._common import scratch, small_batches, table

MAGIC = b"SFP1"
BYTE_PLANES, BIT_PLANES = 1, 2
#: ids of a block, ids after which a chunk is closed.
BLOCK, CHUNK_IDS = 1 << 14, 1 << 18
#: Words in a worker's cache (some 100 bytes each), and their own bytes.
CACHE_WORDS, CACHE_BYTES = 1 << 19, 16 << 20
#: Bytes of text that are tokenised at a time (or one longer text); fewer where whole texts are encoded.
PIECE_BYTES, WHOLE_BYTES = 4 << 20, 1 << 18
#: Document ids sampled for each shard's bounds.
SAMPLE_IDS = 200
_HEAD = struct.Struct("<4sBBHIQI")

# fixed values: pre-tokenizers' patterns that match no white space, each word's tokens by themselves
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Letters whose case and composition no normalizer treats in a way of its own: one pre-token in a row, for these patterns.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: ASCII marks but the apostrophe, which contractions begin with: a run of them behind a letter or digit is a pre-token.
TAIL = r"[!-&(-/:-@\[-`{-~]+$"
#: Normalizers that leave the parts between white space to themselves.
WORD_NORMALIZERS = frozenset(("NFC", "NFD", "Lowercase"))


def encode_planes(ids: np.ndarray, mode: int = BYTE_PLANES, block: int = BLOCK, level: int = 3) -> bytes:
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, (top.bit_length() + 7) // 8 if mode == BYTE_PLANES else top.bit_length())
    pack = zstandard.ZstdCompressor(level=level)
    sizes, data = [], []
    for at in range(0, len(ids), block):
        one = ids[at : at + block]
        for p in range(planes):
            if mode == BYTE_PLANES:
                plane = ((one >> np.uint32(8 * p)) & np.uint32(255)).astype(np.uint8)
            else:
                plane = np.packbits(((one >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), bitorder="little")
            data.append(pack.compress(plane.tobytes()))
            sizes.append(len(data[-1]))
    blocks = -(-len(ids) // block)
    head = _HEAD.pack(MAGIC, mode, planes, 0, block, len(ids), blocks)
    return head + np.asarray(sizes, "<u4").tobytes() + b"".join(data)


def decode_planes(payload: bytes) -> np.ndarray:
    import zstandard

    magic, mode, planes, _, block, n, blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC or mode not in (BYTE_PLANES, BIT_PLANES):
        raise ValueError("not a bit-plane payload")
    sizes = np.frombuffer(payload, "<u4", blocks * planes, _HEAD.size)
    at = _HEAD.size + sizes.nbytes
    if at + int(sizes.sum()) != len(payload):
        raise ValueError("the planes' sizes do not add up to the payload's")
    unpack = zstandard.ZstdDecompressor()
    out = np.zeros(n, "<u4")
    for b in range(blocks):
        one = out[b * block : (b + 1) * block]
        for p in range(planes):
            size = int(sizes[b * planes + p])
            raw = np.frombuffer(unpack.decompress(payload[at : at + size]), np.uint8)
            at += size
            if mode == BYTE_PLANES:
                one |= raw.astype("<u4") << np.uint32(8 * p)
            else:
                one |= np.unpackbits(raw, count=len(one), bitorder="little").astype("<u4") << np.uint32(p)
    return out


def _listed(part: dict | None, kind: str) -> list[dict]:
    return [] if part is None else part.get(kind, [part])


class WordEncoder:
    """Ids of whole texts, where possible from the cached ids of their white-space separated words."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        raw = Path(vocabulary).read_text(encoding="utf-8")
        self.tokenizer = Tokenizer.from_str(raw)
        self.cache_words = cache_words
        spec = json.loads(raw)
        self.top = max(self.tokenizer.get_vocab().values())
        self.special = [t["content"] for t in spec["added_tokens"]]
        normal = _listed(spec["normalizer"], "normalizers")
        steps = _listed(spec["pre_tokenizer"], "pretokenizers")
        # the tokens of a text are those of its words
        self.by_word = (
            bool(steps)
            and steps[0]["type"] == "Split"
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and steps[0]["pattern"].get("Regex") in WORD_PATTERNS
            and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in steps[1:])
            and all(x["type"] in WORD_NORMALIZERS or x["type"] == "Replace" and (x["pattern"], x["content"]) == ({"Regex": r"\s+"}, " ") for x in normal)
            and len(self.special) <= 16
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].isascii() or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
        )
        # and do not depend on case
        self.lower = self.by_word and any(x["type"] == "Lowercase" for x in normal)
        # tokens that end a pre-token, where the model marks them
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.top + 1, bool)
        for token, i in spec["model"]["vocab"].items() if self.by_word and suffix else ():
            self.last[i] = token.endswith(suffix)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.used = np.zeros(0, bool)  # asked for again since the last time words were forgotten
        self.bytes = 0

    def entries(self, words: list[str]) -> np.ndarray:
        """Where the cache has them; -1: nowhere."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def forget(self, words: list[str]) -> None:
        """All but these and, while they fill no more than half, those that were asked for again."""
        again = self.used
        keep = {w for w in words if w in self.at}
        if np.count_nonzero(again) <= self.cache_words // 2:
            keep.update(compress(self.at, again.tolist()))
        own = list(keep)
        self.ids, self.ends = _gather(self.ids, self.ends, self.entries(own))
        self.at = dict(zip(own, range(len(own)), strict=True))
        self.used = np.zeros(len(own), bool)
        self.bytes = sum(map(len, own))

    def learn(self, words: list[str]) -> None:
        """Put words into the cache that are not there."""
        # words of letters alone are pre-tokens, each up to a token that ends one
        simple = np.asarray(pc.match_substring_regex(pa.array(words, pa.string()), f"^[{LETTERS}]+$")) if self.lower and self.last.any() and words else np.zeros(len(words), bool)
        order = [*compress(words, simple), *compress(words, ~simple)]
        ids, sizes = [self.ids], [np.diff(self.ends)]
        n = int(simple.sum())
        for i in [*range(0, n, 4096), *range(n, len(order), 4096)]:
            part = order[i : min(i + 4096, n if i < n else len(order))]
            if i < n:
                got = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                each = np.diff(np.flatnonzero(self.last[got]), prepend=-1)
                if len(each) != len(part):
                    raise ValueError("a word of letters has more than one last token")
            else:
                one = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                got, each = np.asarray(one.ids, np.uint32), np.bincount(np.asarray(one.word_ids, np.int64), minlength=len(part))
            ids.append(got)
            sizes.append(each)
        n = len(self.at)
        self.at.update((w, n + i) for i, w in enumerate(order))
        self.used = np.concatenate([self.used, np.zeros(len(order), bool)])
        self.bytes += sum(map(len, order))
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def forms(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """What each word is looked up as: its front, in lower case, and the marks behind its last letter or digit.

        Of ASCII and Latin words only, and of vocabularies where both steps leave the ids as they
        are. Words that might hold a special token keep their form and have no tail.
        """
        if not self.lower or not len(words):
            return words, pa.array([""] * len(words), words.type)
        plain = pc.match_substring_regex(words, "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$")
        for token in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, token, ignore_case=True)))
        words = pc.if_else(plain, pc.utf8_lower(words), words)
        ends = pc.and_(plain, pc.match_substring_regex(words, f"[0-9{LETTERS}]{TAIL}"))
        front = pc.if_else(ends, pc.replace_substring_regex(words, TAIL, ""), words)
        return front, pc.if_else(ends, pc.replace_substring_regex(words, f"^.*[0-9{LETTERS}]", ""), "")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        if not self.by_word:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes
        split = pc.ascii_split_whitespace(texts)
        word_ends = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(word_ends[0], word_ends[-1] - word_ends[0]).dictionary_encode()
        word_ends = word_ends - word_ends[0]
        del split
        # each different word's front and tail, one after the other
        n = len(coded.dictionary)
        forms = pa.concat_arrays([x.cast(pa.large_string()) for x in self.forms(coded.dictionary)]).dictionary_encode()
        own = forms.dictionary.to_pylist()
        place = np.asarray(forms.indices).reshape(2, n).T.reshape(-1) if n else np.zeros(0, np.int64)
        entry = self.entries(own)
        if len(self.at) + np.count_nonzero(entry < 0) > self.cache_words or self.bytes > CACHE_BYTES:
            self.forget(own)
            entry = self.entries(own)
        self.used[entry[entry >= 0]] = True
        unknown = np.flatnonzero(entry < 0)
        self.learn([own[i] for i in unknown])
        entry[unknown] = self.entries([own[i] for i in unknown])
        # the ids of each different word of the piece, then those of all words
        ids, ends = _gather(self.ids, self.ends, entry[place])
        ids, done = _gather(ids, ends[::2], np.asarray(coded.indices))
        return ids, done[word_ends[1:]] - done[word_ends[:-1]]


def _gather(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those rows of ragged values, and their ends."""
    start = ends[:-1][rows]
    size = ends[1:][rows] - start
    done = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    # places as short as they can be: they are the largest array of a piece
    kind = np.int32 if max(int(done[-1]), len(values)) < 1 << 31 else np.int64
    place = np.arange(done[-1], dtype=kind)
    place += np.repeat((start - done[:-1]).astype(kind), size)
    return values[place], done


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(vocabulary: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    _ENCODERS[vocabulary].cache_words = cache_words
    return _ENCODERS[vocabulary]


def forget_encoders() -> None:
    """Of this process: a nested function would be sent with a copy of the dictionary and clear that."""
    _ENCODERS.clear()


def held_encoders() -> int:
    return len(_ENCODERS)


def _pieces(col: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes."""
    ends = np.asarray(pc.cumulative_sum(pc.binary_length(col).cast(pa.int64())))
    i = 0
    while i < len(ends):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield i, j
        i = j


def _merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of successive batches, until they have `most` bytes."""
    names: list[pa.Array] = []
    texts: list[pa.Array] = []
    held = 0
    for batch in batches:
        names.append(batch.column(0))
        texts.append(B.strings(batch.column(1)))
        held += texts[-1].nbytes
        if held >= most:
            yield pa.concat_arrays(names), pa.concat_arrays(texts)
            names, texts, held = [], [], 0
    if names:
        yield pa.concat_arrays(names), pa.concat_arrays(texts)


def id_type(encoder: WordEncoder, end_id: int) -> np.dtype:
    """What holds every id of the vocabulary, and the end id."""
    return np.dtype("<u2" if max(encoder.top, end_id) < 1 << 16 else "<u4")


CHUNKS = "shard int, chunk long, n_ids long, doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"
_NONE = -(1 << 63)  # the place of null ids in the order


def shard_bounds(docs: DataFrame, id_col: str, shards: int) -> list[int]:
    """shards - 1 ids, in order, that cut the table into about equal parts: from at most some SAMPLE_IDS ids a shard."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"))
    total = ids.count()
    if shards < 2 or not total:
        return []
    got = sorted(r.id for r in ids.sample(min(1.0, SAMPLE_IDS * shards / total), seed=5).limit(2 * SAMPLE_IDS * shards).collect())
    return [got[len(got) * i // shards] for i in range(1, shards)] if got else []


def encoded(
    docs: DataFrame, vocabulary: str, bounds: list[int], *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    cache_words: int = CACHE_WORDS, piece_bytes: int = PIECE_BYTES, release: bool = False,
) -> DataFrame:
    """(shard, id, ids binary) of every document, ids as two little-endian octets each or, in larger vocabularies, four, the end id behind them.

    Shard s holds ids from bound s - 1 to bound s; rows of an id that is a bound are dealt to the
    shards on its two sides, and to all between equal bounds, by a hash of their text. cache_words and
    piece_bytes bound what a worker holds; release: a task gives its tokenizer and cache back at its end.
    """
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mix"))
    cuts = np.asarray(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary, cache_words)
        most = piece_bytes if encoder.by_word else min(piece_bytes, WHOLE_BYTES)
        kind = id_type(encoder, end_id)

        def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).fill_null(_NONE).to_numpy()
            low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
            at = low + batch.column(2).to_numpy().astype(np.uint64) % (high - low + 1).astype(np.uint64)
            names = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), batch.column(0)], ["shard", "id"])
            return pa.RecordBatch.from_arrays([names, batch.column(1)], names=["name", "text"])

        for names, texts in _merged(map(shard, batches), most):
            for i, j in _pieces(texts, most):
                ids, sizes = encoder.encode(texts.slice(i, j - i))
                out = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype(kind)  # after each document
                offsets = np.concatenate([[0], kind.itemsize * np.cumsum(sizes + 1)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
                own = names.slice(i, j - i)
                # rows' ids are copied to the JVM: a few hundred documents at a time
                for k in range(0, j - i, 500):
                    part = own.slice(k, 500)
                    yield pa.RecordBatch.from_arrays([*part.flatten(), packed.slice(k, 500)], names=["shard", "id", "ids"])
        if release:
            forget_encoders()

    return picked.mapInArrow(B.tidy(run), "shard int, id long, ids binary")


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    mode: int = BYTE_PLANES,
    block: int = BLOCK,
    chunk_ids: int = CHUNK_IDS,
    shards: int | None = None,
    cache_words: int = CACHE_WORDS,
    piece_bytes: int = PIECE_BYTES,
    release: bool = False,
) -> None:
    """Write the ids of all documents, in ascending order of their ids, below path; the last three as in ``encoded``."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bounds = shard_bounds(docs, id_col, shards)
    rows = encoded(docs, vocabulary, bounds, id_col=id_col, text_col=text_col, end_id=end_id, cache_words=cache_words, piece_bytes=piece_bytes, release=release)
    kind = id_type(WordEncoder(vocabulary), end_id)
    ordered = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 0
        held: list[np.ndarray] = []
        docs_held: list[int | None] = []
        sizes_held: list[int] = []
        n_held, shard = 0, None

        def close() -> pa.RecordBatch:
            nonlocal chunk, n_held
            ids = np.concatenate(held)
            row = {"shard": [shard], "chunk": [chunk], "n_ids": [len(ids)], "doc_ids": [list(docs_held)], "doc_sizes": [list(sizes_held)], "payload": [encode_planes(ids, mode, block)]}
            chunk, n_held = chunk + 1, 0
            held.clear(), docs_held.clear(), sizes_held.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            packed = batch.column(2)
            for i in range(batch.num_rows):
                if shard != (now := batch.column(0)[i].as_py()):
                    if held:
                        yield close()
                    shard, chunk = now, 0
                held.append(np.frombuffer(packed[i].as_buffer(), kind).astype("<u4"))
                docs_held.append(batch.column(1)[i].as_py())
                sizes_held.append(len(held[-1]))
                n_held += sizes_held[-1]
                if n_held >= chunk_ids:
                    yield close()
        if held:
            yield close()

    ordered.mapInArrow(B.tidy(run), CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    got = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # a row for each shard: their number is this function's parameter
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    got.select("shard", "n_ids", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/shards")


def _read(spark: SparkSession, path: str, kind: str, of_chunk: Callable) -> DataFrame:
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    shards = spark.read.schema("shard int, n_ids long, before long").parquet(f"{path}/shards")
    order = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = chunks.select("shard", "chunk", "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    # shards and chunks: one small row for 2^18 ids or more, except each shard's last
    index = index.join(F.broadcast(shards.select("shard", "before")), "shard")
    index = index.select("shard", "chunk", (F.col("own") + F.col("before")).alias("start"))
    joined = chunks.join(index, ["shard", "chunk"]).select("start", "doc_ids", "doc_sizes", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.asarray(row["doc_sizes"], np.int64)
                ids = decode_planes(row["payload"])
                if len(ids) != sizes.sum():
                    raise ValueError("a chunk's documents do not add up to its ids")
                ends = np.cumsum(sizes)
                yield of_chunk(row["doc_ids"], row["start"] + ends - sizes, sizes, ids, ends)

    return joined.mapInArrow(B.tidy(run), kind)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files."""

    def of_chunk(names, start, sizes, ids, ends):
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start, pa.int64()), lists], names=["doc_id", "start", "ids"])

    return _read(spark, path, "doc_id long, start long, ids array<bigint>", of_chunk)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the files."""

    def of_chunk(names, start, sizes, ids, ends):
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        cols = [pa.array(names, pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", of_chunk)


def tokenised(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """Write docs below the shared folder and read the digests back; options are those of ``write_tokens``."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, **options)
    return read_digests(docs.sparkSession, path)


def op4_token_planes(spark, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))
