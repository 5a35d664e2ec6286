"""N-gram Jaccard join with Bayesian pruning.

Texts are sets of five-word shingles; two texts are linked where the Jaccard similarity of
their sets is ``threshold`` or more. One row for each document is returned: its class (the
connected component of links that it lies in, named by its least document id) and the number
of other shingle sets that its own is linked to. Texts with equal sets are copies: they count
as one, and not for each other.

1. Each text's shingles, the hash of its shingle set, and ``BANDS * ROWS`` MinHash values are
   computed in one scan; what is kept is the set's hash and one hash per band. Copies (equal
   sets) are one node from here on.
2. Sets that share a band are candidates. A pair at the threshold shares none of 40 bands of 5
   with probability (1 - 0.8^5)^40 = 1.2e-7, and less above it. Each band's sets are tied to
   the least of them, and the components of these ties group everything that must be compared.
3. A group is cut into blocks of about ``BLOCK`` sets or ``BLOCK_BYTES`` of text. Each block, and
   every two blocks with sets that share a band, are a unit of work of bounded size, on whichever
   task; a set goes to the units of those blocks only that it shares a band with, so that groups
   that hang together by chains of bands cost what their shared bands do. In a unit, MinHash
   values are compared step by step; after each step a pair is dropped if, given its matches, the
   posterior probability (uniform prior) that its similarity reaches the threshold is below
   ``TOLERANCE``. What is left is verified on the shingle sets themselves. A unit returns a row for
   each of its sets: its number of links and one tie to another set it is linked with; pairs are
   never rows.
4. The ties' components are the classes.

Joins on bands, groups, classes and sets, any of which may hold a third of all rows, know each
key's rows beforehand and deal those of many rows over salts (``spread_join``).

Words are separated by white space and compared as they are. Defined results: a text of one to
four words has one shingle, all its words; a null text or one without words is a class of its
own, without links; rows that repeat a text are copies; rows that repeat an id keep their own
texts' classes, which then may have one class id (``details`` has a key that no two classes share);
texts of any length are read whole, one longer than ``BLOCK_BYTES`` being a block or more by itself;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm import _bytesnp as B
from stratafold.llm._common import cut, discard, hot_limit, small_batches, spread_join, table, text_or_empty

THRESHOLD, SHINGLE, BANDS, ROWS = 0.8, 5, 40, 5
STEP, TOLERANCE, BLOCK, BLOCK_BYTES = 40, 1e-7, 128, 4 << 20
#: Bytes of the compared sets' keys and units that are broadcast to the texts; above, both are shuffled.
MAX_BROADCAST_BYTES = 32 << 20
_HASHES = BANDS * ROWS
_RANDOM = np.random.default_rng(20_240_229)
_A = _RANDOM.integers(1, 1 << 32, _HASHES, np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, _HASHES, np.uint32)
_U64 = np.uint64


def shingles(s: B.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles' hashes of every document, sorted, and where each document's end."""
    start, end, doc = B.word_spans(s)
    words = B.span_hashes(s.buf, start, end)
    h, at = B.windows(words, doc, k)
    of = doc[at]
    n = len(s.ends) - 1
    counts = np.bincount(doc, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.cumsum(counts) - counts
        whole = np.zeros(len(short), _U64)
        for j in range(k - 1):
            has = counts[short] > j
            whole[has] = B.mix(whole[has] * B._BASE + words[first[short[has]] + j])
        h, of = np.concatenate([h, whole]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(n + 1))


def signatures(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents with shingles, hashes): the MinHash values."""
    full = np.flatnonzero(np.diff(ends))
    out = np.empty((_HASHES, len(full)), np.uint32)
    if len(full):
        x, at = (h >> _U64(32)).astype(np.uint32), ends[full]
        room = np.empty_like(x)
        for p in range(_HASHES):
            np.multiply(x, _A[p], out=room)
            np.add(room, _B[p], out=room)
            np.bitwise_xor(room, room >> np.uint32(15), out=room)
            out[p] = np.minimum.reduceat(room, at)
    return out.T.copy()


def set_ids(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each document's set, as two columns; zeros for none."""
    out = np.zeros((len(ends) - 1, 2), _U64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        size = np.diff(ends)[full].astype(_U64)
        for c, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, c] = B.mix(np.add.reduceat(B.mix(h ^ _U64(salt)), ends[full]) + size)
    return out


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key long, set_id binary or null, node long, bands array<long>, octets long); key is the text's xxhash64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = B.mix(np.arange(1, ROWS + 1, dtype=_U64) * B._BASE) | _U64(1)
        for batch in batches:
            at = 0
            texts = B.strings(batch.column(1))
            octets = pc.binary_length(texts).cast(pa.int64())
            for s in B.slices(texts):
                h, ends = shingles(s)
                n = len(ends) - 1
                full = np.diff(ends) > 0
                ids = set_ids(h, ends)
                sig = signatures(h, ends).reshape(-1, BANDS, ROWS).astype(_U64)
                bands = np.zeros((n, BANDS), np.int64)
                bands[full] = B.mix((sig * weights).sum(2, dtype=_U64) + B.mix(np.arange(BANDS, dtype=_U64) + _U64(7))).view(np.int64)
                names = [x.tobytes() if f else None for x, f in zip(ids, full, strict=True)]
                sizes = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(bands[full].reshape(-1)))
                cols = [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(names, pa.binary()), pa.array(ids[:, 0].view(np.int64)), lists, octets.slice(at, n)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "set_id", "node", "bands", "octets"])
                at += n

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text_or_empty(text)).alias("key"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(B.tidy(run), f"doc_id {kind}, key long, set_id binary, node long, bands array<bigint>, octets long")


# --- connected components ------------------------------------------------------------------


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) -> (node, comp): the least node of each node's component, for nodes with an edge.

    Large-star and small-star contraction: every node above b is tied to the least node that b is
    tied to or is, then every node's lower neighbours and itself to the least of them, until
    nothing changes: about the logarithm of the longest path rounds, each a few shuffles of the
    edges and a checkpoint. Nodes of many edges are dealt over salts. rows: about how many edges there are.
    """
    spark = edges.sparkSession
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows, forget=True)
    last = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) % 1000003)")).first()
    while last[0]:
        limit = hot_limit(spark, last[0])
        # (b, its least neighbour or itself, its upper neighbours)
        both = e.select("a", "b", F.lit(0).alias("up")).union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("up")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.sum("up").alias("n")).where("n > 0").select(F.col("a").alias("b"), F.least("a", "m").alias("m"), "n")
        large = spread_join(e, least, "b", "n", limit).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "a", "n", limit)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, e = e, cut(small.where("a <> b").distinct(), last[0], forget=True)
        discard(before)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) % 1000003)")).first()
        if now == last:
            break
        last = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


# --- units ---------------------------------------------------------------------------------


def least_matches(threshold: float, step: int = STEP, hashes: int = _HASHES, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair is dropped).

    With a uniform prior, m matches of n leave the similarity Beta(m + 1, n - m + 1), and the
    probability that it is t or more is that of at most m successes in n + 1 draws at t.
    """
    out = []
    for n in [*range(step, hashes, step), hashes]:
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def similar_pairs(sig: np.ndarray, sets: list[np.ndarray], split: int | None, threshold: float = THRESHOLD) -> np.ndarray:
    """The linked pairs (i, j) of a unit; split: i before it and j from it on, None: all i < j."""
    n = len(sets)
    if split is None:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(split), np.arange(split, n), indexing="ij"))
    size = np.fromiter(map(len, sets), np.int64, n)
    fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[fits], j[fits]
    matches, done = np.zeros(len(i), np.int64), 0
    for upto, least in least_matches(threshold):
        matches += (sig[i, done:upto] == sig[j, done:upto]).sum(1)
        keep = matches >= least
        i, j, matches, done = i[keep], j[keep], matches[keep], upto
    if not len(i):
        return np.zeros((0, 2), np.int64)
    # exactly: pairs of a few sets one by one, dense groups as products over the shingles they share
    if len(i) <= 4 * n:
        common = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)), np.int64, len(i))
    else:
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        place = np.full(len(times), -1)
        place[shared] = np.arange(len(shared))
        row, col = np.repeat(np.arange(n), size), place[code]
        row, col = row[col >= 0], col[col >= 0]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        product = np.zeros((n, n), np.float32)
        for at in range(0, len(shared), 4096):
            lo, hi = np.searchsorted(col, [at, at + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[row[lo:hi], col[lo:hi] - at] = 1
            product += part @ part.T
        common = np.rint(product[i, j]).astype(np.int64)
    linked = common * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-9
    return np.stack([i[linked], j[linked]], 1)


def _forest(pairs: np.ndarray, n: int) -> list[int]:
    """For each of n the least of those it is connected with."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def _links(units: DataFrame, threshold: float) -> DataFrame:
    """(comp, lo, hi, blk, set_id, n_texts, text) -> (set_id, links, text_links, tie) rows, by unit."""

    def solve(held: dict[tuple, tuple], split_at: int | None) -> pa.RecordBatch:
        members = sorted(held.items())  # (block, set) to (number of texts, text)
        sig, sets, kept, weight = [], [], [], []
        for s in B.slices(B.strings(pa.array([t for _, (_, t) in members], pa.large_string()))):
            h, ends = shingles(s)
            ids = set_ids(h, ends)
            got = iter(signatures(h, ends))
            for i in range(len(ends) - 1):
                if ends[i + 1] > ends[i]:
                    values = next(got)
                    own, (n, _) = members[s.first + i]
                    if ids[i].tobytes() == own[1]:  # else a row that only shares the id and the hash
                        sig.append(values)
                        sets.append(h[ends[i] : ends[i + 1]])
                        kept.append(own)
                        weight.append(n)
        split = None if split_at is None else sum(m[0] == split_at for m in kept)
        pairs = similar_pairs(np.asarray(sig, np.uint32).reshape(len(sets), _HASHES), sets, split, threshold)
        links = np.bincount(pairs.reshape(-1), minlength=len(sets))
        n = np.asarray(weight, np.int64)
        texts = np.zeros(len(sets), np.int64)
        np.add.at(texts, pairs[:, 0], n[pairs[:, 1]])
        np.add.at(texts, pairs[:, 1], n[pairs[:, 0]])
        ties = _forest(pairs, len(sets))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([kept[i][1] for i in some], pa.binary()), pa.array(links[some], pa.int64()), pa.array(texts[some], pa.int64()), pa.array([kept[ties[i]][1] for i in some], pa.binary())],
            names=["set_id", "links", "text_links", "tie"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for i, row in enumerate(zip(*cols, strict=True)):
                if row[:3] != unit:
                    if held:
                        yield solve(held, None if unit[1] == unit[2] else unit[1])
                    unit, held = row[:3], {}
                if row[3:5] not in held:  # rows that repeat an id and a text come more than once
                    held[row[3:5]] = (row[5], batch.column(6)[i].as_py())
        if held:
            yield solve(held, None if unit[1] == unit[2] else unit[1])

    keys = ["comp", "lo", "hi"]
    spark = units.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = units.select(*keys, "blk", "set_id", "n_texts", "text").repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(B.tidy(run), "set_id binary, links long, text_links long, tie binary")


def _least(id_col: str, *others: str) -> Column:
    """The least by id, null ids last, and then by the others."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, *others))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The features of every row, and of every set its class, links, copies and whether it is its class's head.

    The head is the set of the class's least document, which is (rep, rep_key); that of every set
    is its own least one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    feats = cut(_features(docs, id_col, text_col))
    sets = feats.where("set_id is not null").groupBy("set_id").agg(
        _least("doc_id", "key").alias("d"), F.count("*").alias("n_copies"), F.count_distinct("key").alias("n_texts"),
        F.first("node").alias("node"), F.first("bands").alias("bands"), F.max("octets").alias("octets"),
    ).select("set_id", F.col("d.doc_id").alias("rep"), F.col("d.key").alias("rep_key"), "n_copies", "n_texts", "node", "bands", "octets")
    sets = cut(sets)
    n_sets = sets.count()
    limit = hot_limit(spark, BANDS * n_sets)
    keys = sets.select("node", F.explode("bands").alias("band"))
    lead = keys.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("other"), F.count("*").alias("n")).where("lead <> other").select("band", "lead", "n")
    ties = spread_join(keys, lead, "band", "n", limit).where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    comps = cut(components(ties, n_sets), n_sets)
    members = _members(sets, comps, block)
    discard(comps)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    held = members.agg(F.sum(F.lit(64) + 4 * F.size("others"))).first()[0] or 0
    near = F.broadcast(members) if held <= MAX_BROADCAST_BYTES else members
    units = texts.join(near, texts["__id"].eqNullSafe(near["__rep"]) & (F.xxhash64(texts["text"]) == near["__key"])).withColumn("other", F.explode("others"))
    units = units.select("comp", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "set_id", "n_texts", "text")
    found = cut(_links(units, threshold))
    discard(members)

    links = found.groupBy("set_id").agg(F.sum("links").alias("n_links"), F.sum("text_links").alias("text_links"))
    n_found = found.count()
    classes = cut(components(found.select(F.col("set_id").alias("a"), F.col("tie").alias("b")), n_found), n_found)
    own = sets.select("set_id", "rep", "rep_key", "n_copies", "n_texts")
    named = classes.join(own, classes["node"] == own["set_id"]).select("comp", "set_id", "rep", "rep_key")
    heads = named.groupBy("comp").agg(_least("rep", "rep_key", "set_id").alias("h"), F.count("*").alias("n"))
    named = spread_join(named, heads, "comp", "n", limit).select(F.col("set_id"), F.col("h.rep").alias("least"), F.col("h.set_id").alias("of"))
    whole = own.join(named, "set_id", "left").join(links, "set_id", "left").select(
        "set_id", "rep", "rep_key", F.coalesce(F.col("of") == F.col("set_id"), F.lit(True)).alias("head"),
        F.when(F.col("of").isNull(), F.col("rep")).otherwise(F.col("least")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies",
        (F.coalesce("text_links", F.lit(0)) + F.col("n_texts") - 1).cast("long").alias("n_text_links"), F.hex(F.coalesce("of", "set_id")).alias("class_key"),
    )
    return feats, whole


def _members(sets: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """(comp, set_id, __rep, __key, n_texts, blk, others) of the sets to compare: others are the blocks with which they are."""
    spark = sets.sparkSession
    size = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("octets") / F.lit(BLOCK_BYTES))).cast("int")
    tied = cut(sets.join(comps, "node"))
    blocks = tied.groupBy("comp").agg(size.alias("blocks"), F.count("*").alias("n"))
    limit = hot_limit(spark, BANDS * tied.count())
    dealt = spread_join(tied, blocks, "comp", "n", limit).select(
        "comp", "node", "set_id", F.col("rep").alias("__rep"), F.col("rep_key").alias("__key"), "n_texts", "blocks",
        F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("blk"), F.when(F.col("blocks") > 1, F.col("bands")).alias("bands"),
    )
    dealt = cut(dealt)
    # of groups of several blocks: each band's blocks, or that they are all of its group's
    keys = dealt.where("blocks > 1").select("node", "blk", "blocks", F.explode("bands").alias("band"))
    at = keys.groupBy("band").agg(F.collect_set("blk").alias("at"), F.first("blocks").alias("all"), F.count("*").alias("n")).where(F.size("at") > 1)
    at = at.select("band", "n", (F.size("at") == F.col("all")).alias("full"), F.when(F.size("at") < F.col("all"), F.col("at")).alias("at"))
    shared = spread_join(keys.select("node", "band"), at, "band", "n", limit)
    shared = shared.groupBy("node").agg(F.max("full").alias("full"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    others = F.when(F.col("full"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array_union(F.array("blk"), F.coalesce("at", F.array().cast("array<int>"))))
    out = cut(dealt.join(shared, "node", "left").select("comp", "set_id", "__rep", "__key", "n_texts", "blk", others.alias("others")))
    discard(tied, dealt)
    return out


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK, details: bool = False) -> DataFrame:
    """(id, class_id, n_links, n_copies) for every row of docs.

    details: two more columns, n_text_links, the other different texts that a text is linked to, those
    of its own shingle set included, and class_key, which is null for rows without words.
    """
    feats, whole = _classes(docs, id_col, text_col, threshold, block)
    cols = ["class_id", "n_links", "n_copies", *(["n_text_links", "class_key"] if details else [])]
    some = spread_join(feats.where("set_id is not null").select("doc_id", "set_id", "key"), whole, "set_id", "n_copies", hot_limit(docs.sparkSession, feats.count())).select("doc_id", *cols)
    none = feats.where("set_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long"), *([F.lit(0).cast("long"), F.lit(None).cast("string")] if details else [])
    )
    return some.union(none).withColumnRenamed("doc_id", id_col)


def keep_heads(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of every class; the same columns.

    A document is named by its id and its text's hash, so classes that share an id each keep a
    row: that of the least id (a null one last) and, where this id has several texts in the class,
    of the least hash. Rows that repeat an id and a text stay as one of them. Rows without words
    all stay.
    """
    feats, whole = _classes(docs, id_col, text_col, **options)
    heads = whole.where("head").select(F.col("rep").alias("__head"), F.col("rep_key").alias("__hash"))
    blank = feats.where("set_id is null").select(F.col("doc_id").alias("__head"), F.col("key").alias("__hash")).distinct()
    hashed = F.xxhash64(text_or_empty(docs[text_col].cast("string")))

    def those(h: DataFrame) -> DataFrame:
        return docs.join(h, docs[id_col].eqNullSafe(h["__head"]) & (hashed == h["__hash"]), "left_semi")

    repeats = feats.where("set_id is not null").groupBy("doc_id", "key").count().where("count > 1")
    if repeats.isEmpty():
        return those(cut(heads.union(blank)))
    # texts are shuffled a second time only where rows repeat
    once = those(cut(heads)).withColumn("__hash", hashed).dropDuplicates([id_col, "__hash"]).drop("__hash")
    return once.union(those(cut(blank)))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The class key is left out, being a hash that SQL cannot give."""
    return jaccard_join(table(spark, sf_dir, "documents"), details=True).drop("class_key")


#: Every pair of sets that share a shingle is compared, and classes are grown link by link.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
u AS (SELECT DISTINCT r, s FROM g),
k AS (SELECT r, md5(string_agg(s, chr(10) ORDER BY s)) AS set_id, count(*) AS n FROM u GROUP BY r),
sets AS (SELECT set_id, min(r) AS r, any_value(n) AS n, min(doc_id) AS rep, count(*) AS n_copies, count(DISTINCT text) AS n_texts FROM k JOIN d USING (r) GROUP BY set_id),
su AS (SELECT sets.set_id, sets.n, u.s FROM sets JOIN u USING (r)),
p AS (SELECT a.set_id AS x, b.set_id AS y FROM su a JOIN su b ON a.s = b.s AND a.set_id < b.set_id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 8
      GROUP BY a.set_id, b.set_id, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach(set_id, other) AS (SELECT set_id, set_id FROM sets UNION SELECT reach.set_id, e.y FROM reach JOIN e ON reach.other = e.x),
c AS (SELECT reach.set_id, min(rep) AS class_id FROM reach JOIN sets ON sets.set_id = reach.other GROUP BY reach.set_id),
l AS (SELECT e.x AS set_id, count(*) AS n_links, sum(n_texts) AS texts FROM e JOIN sets ON sets.set_id = e.y GROUP BY e.x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(sets.n_copies, 1) AS BIGINT) AS n_copies,
  CAST(coalesce(l.texts, 0) + coalesce(sets.n_texts, 1) - 1 AS BIGINT) AS n_text_links
FROM d LEFT JOIN k USING (r) LEFT JOIN sets USING (set_id) LEFT JOIN c USING (set_id) LEFT JOIN l USING (set_id)
"""
