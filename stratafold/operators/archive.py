"""Listings, predicates and set operations of catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.running import running_before
from stratafold.functions.scalars import extension
from stratafold.sources.catalog import id_range, path

#: Letters of sort orders; ``g`` is the rank of a group file's type where files have one (``grp_rank``).
ORDERS = {"g": "grp", "e": "ext", "n": "name", "p": "dir", "s": "size"}


def attribute_packed(listed: DataFrame, blocks: DataFrame) -> DataFrame:
    """listed files with ``packed``: their block's packed size on its first listed file, else 0.

    listed: files with grp and block, after any filter. blocks: (grp, block, packed_size).
    """
    first = F.min("file_id").over(Window.partitionBy("grp", "block"))
    return listed.join(blocks, ["grp", "block"]).withColumn("packed", F.when(F.col("file_id") == first, F.col("packed_size")).otherwise(F.lit(0).cast("long")))


def packed_blocks(f: DataFrame) -> DataFrame:
    """(grp, block, packed_size, n_files, orig_size): here a block packs to a third, rounded down, and 16 octets."""
    return f.groupBy("grp", "block").agg(F.count("*").alias("n_files"), F.sum("size").alias("orig_size")).withColumn(
        "packed_size", (F.floor(F.col("orig_size") / 3) + 16).cast("long")
    )


def block_bounds(f: DataFrame) -> DataFrame:
    """(grp, block, first_file, last_file, start, upto): block b owns the files [start, upto) of its group, counted from 0."""
    k = f.groupBy("grp", "block").agg(F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"), F.count("*").alias("n_files"))
    k = running_before(k, F.col("n_files"), ["grp"], ["block"], F.floor(F.col("block") / 4096), "start")
    return k.withColumn("upto", F.col("start") + F.col("n_files"))


def in_blocks(f: DataFrame, bounds: DataFrame, span: int = 4096) -> DataFrame:
    """f (grp, pos from 0) with the block whose bounds hold its place: a range join, by spans of places."""
    spans = bounds.withColumn("_span", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("upto") - 1) / span)))).select("grp", "_span", "block", "start", "upto")
    keyed = f.withColumn("_span", F.floor(F.col("pos") / span))
    return keyed.join(spans, ["grp", "_span"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("upto"))).drop("_span", "start", "upto")


def extract_until(f: DataFrame, accepted: Column) -> DataFrame:
    """Files that must be read to get at all accepted ones: per block up to its last accepted one."""
    last = F.max(F.when(accepted, F.col("file_id"))).over(Window.partitionBy("grp", "block"))
    return f.withColumn("accepted", accepted).withColumn("last", last).where(F.col("file_id") <= F.col("last")).drop("last")


def update(old: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """Reconcile two catalogs (path, mtime, size) by path.

    replace: the new file wins; newer: the newer wins and new ones are added; freshen: the newer
    wins and nothing is added; sync: what is new and nothing else, the old kept where not older. A
    file without a time is there all the same, and older than any with one.
    """
    o = old.select("path", F.lit(True).alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("mtime", "size")])
    n = new.select("path", F.lit(True).alias("n"), *[F.col(c).alias(f"n_{c}") for c in ("mtime", "size")])
    both = o.join(n, "path", "full_outer")
    has_old, has_new = F.coalesce("o", F.lit(False)), F.coalesce("n", F.lit(False))
    later = F.coalesce(F.col("n_mtime") > F.col("o_mtime"), F.col("n_mtime").isNotNull())
    newer = has_new & (~has_old | later)
    keep, take = {
        "replace": (F.lit(True), has_new),
        "newer": (F.lit(True), newer),
        "freshen": (has_old, newer & has_old),
        "sync": (has_new, newer),
    }[mode]
    return both.where(keep).select(
        "path",
        F.when(take, F.col("n_mtime")).otherwise(F.col("o_mtime")).alias("mtime"),
        F.when(take, F.col("n_size")).otherwise(F.col("o_size")).alias("size"),
        F.when(take & has_old, "updated").when(take, "added").otherwise("kept").alias("action"),
    )


def join_archives(archives: list[DataFrame]) -> DataFrame:
    """The union of catalogs; of equal paths the one of the later archive."""
    parts = [a.withColumn("archive", F.lit(i)) for i, a in enumerate(archives)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cols = [c for c in out.columns if c != "path"]
    # an aggregate by path, so that copies meet before the shuffle
    best = out.groupBy("path").agg(F.max_by(F.struct(*cols), "archive").alias("r"))
    return best.select("path", "r.*")


def ranked(f: DataFrame, order: str, group: str | None = None, whole: bool = False) -> DataFrame:
    """f with ``pos``: its place in a sort order such as ``gen`` or ``es``, within its group.

    The group is that of the order's first letter, or ``group``; whole: there is none, and the
    places are those of the whole catalog. A group is ranked in ranges: its keys up to the first
    name or size, cut to the name's first four characters or to 256 octets.
    """
    unknown = set(order) - set(ORDERS)
    if unknown:
        raise ValueError(f"no meaning is known for the sort letters {sorted(unknown)}")
    f = f.withColumn("ext", extension(F.col("name")))
    keys = [ORDERS[c] for c in order] + ["file_id"]
    coarse = []
    for k in keys:
        coarse.append({"name": F.substring("name", 1, 4), "size": F.floor(F.col("size") / 256), "file_id": id_range("file_id")}.get(k, F.col(k)))
        if k in ("name", "size", "file_id"):
            break
    within = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(coarse)])
    out = running_before(f, F.lit(1).cast("long"), [] if whole else [group or ORDERS[order[0]]], keys, within, "pos")
    return out.withColumn("pos", F.col("pos") + 1)


def first_matching_mask(names: DataFrame, masks: list[tuple[int, str, str]], name: str) -> DataFrame:
    """names with the ``type`` of the first mask that their name matches: one expression, no join."""
    from stratafold.functions.scalars import mask_pattern

    out = F.lit("$default")
    for _, kind, mask in sorted(masks, reverse=True):
        out = F.when(F.lower(F.col(name)).rlike(mask_pattern(mask.lower())), F.lit(kind)).otherwise(out)
    return names.withColumn("type", out)


def full_path(f: DataFrame) -> DataFrame:
    return f.withColumn("path", path(F.col("dir"), F.col("name")))


def extract_plan(archived: DataFrame, present: DataFrame, policy: str) -> DataFrame:
    """archived files (path, mtime) with ``action`` against what is on disk (path, mtime).

    policy: ``overwrite``, ``skip`` what is there, or ``update`` what is older there.
    """
    there = present.select("path", F.lit(True).alias("exists"), F.col("mtime").alias("there"))
    later = F.coalesce(F.col("mtime") > F.col("there"), F.col("mtime").isNotNull())
    replace = {"overwrite": F.lit(True), "skip": F.lit(False), "update": later}[policy]
    action = F.when(F.col("exists").isNull(), "create").when(replace, "replace").otherwise("keep")
    return archived.join(there, "path", "left").withColumn("action", action).drop("there", "exists")


def backup(f: DataFrame, kind: str, last_full: Column, last_any: Column) -> DataFrame:
    """Files (mtime) of a backup: ``full`` all, ``differential`` those changed since the last full
    one, ``incremental`` those changed since the last of any kind."""
    return f.where({"full": F.lit(True), "differential": F.col("mtime") > last_full, "incremental": F.col("mtime") > last_any}[kind])


def guard(changes: DataFrame, archives: DataFrame) -> DataFrame:
    """changes (archive, ...) with ``applied``: not to locked archives, nor to ones that do not exist."""
    known = archives.select("archive", (~F.coalesce("locked", F.lit(False))).alias("open"))
    return changes.join(known, "archive", "left").withColumn("applied", F.coalesce("open", F.lit(False))).drop("open")


#: What writing an archive anew can do: ``info`` modes write the catalog only, without or with CRCs.
RECOMPRESS = ("append", "smart", "all", "info", "info_crc", "no_headers")


def recompress(f: DataFrame, blocks: DataFrame, touched: Column, mode: str) -> DataFrame:
    """blocks (grp, block) with ``action``, what happens to each when ``touched`` files change.

    append: blocks stay, changed files go to new ones; smart: blocks with a changed file are
    packed again; all: every block is; info and info_crc: only the catalog is written, without
    and with CRCs; no_headers: every block is packed and no catalog written.
    """
    hit = f.groupBy("grp", "block").agg(F.max(touched).alias("hit"))
    again = F.coalesce("hit", F.lit(False))
    action = {
        "append": F.when(again, "copy and add").otherwise("copy"),
        "smart": F.when(again, "repack").otherwise("copy"),
        "all": F.lit("repack"),
        "info": F.lit("omit"),
        "info_crc": F.lit("read and omit"),
        "no_headers": F.lit("repack without catalog"),
    }[mode]
    return blocks.join(hit, ["grp", "block"], "left").withColumn("action", action).drop("hit")


def move(archived: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, ...) added to an archive, those present winning, and then none of them left on disk."""
    return join_archives([archived, present]), present.limit(0)


def annotate(archives: DataFrame, comments: DataFrame) -> DataFrame:
    """archives (archive, locked, comment) with new comments (archive, new_comment), but locked ones as they are."""
    return archives.join(comments, "archive", "left").withColumn("comment", F.when(F.coalesce("locked", F.lit(False)), F.col("comment")).otherwise(F.coalesce("new_comment", "comment"))).drop("new_comment")


def info(f: DataFrame, blocks: DataFrame, chain: str, keys: Sequence[str] = ()) -> DataFrame:
    """The report on archives: files (dir, size, block, keys) and blocks (keys, packed_size) under one chain.

    Memory is that of the chain's methods, the dictionary the largest of their first parameters.
    """
    from stratafold.functions import scalars as S

    by_file = f.groupBy(*keys).agg(
        F.count_distinct("dir").alias("dirs"), F.count("*").alias("files"), F.sum("size").alias("size"),
        F.max(F.col("archive_locked")).alias("locked"), F.max("archive_comment").alias("comment"), F.max("archive_recovery").alias("recovery"),
    )
    by_block = blocks.groupBy(*keys).agg(F.count("*").alias("solid_blocks"), F.sum("packed_size").alias("packed"))
    both = by_file.join(by_block, list(keys)) if keys else by_file.crossJoin(F.broadcast(by_block))  # a row each
    c = F.lit(chain)
    largest = F.array_max(F.transform(S.methods(c), lambda m: F.coalesce(S.parse_mem(F.get(m["params"], F.lit(0))), F.lit(0).cast("long"))))
    return both.select(
        *keys, "dirs", "files", "size", "packed", F.round(F.col("packed") * 100 / F.col("size"), 2).alias("ratio"),
        F.lit(1).cast("long").alias("directory_blocks"), "solid_blocks", F.floor(F.col("size") / F.col("solid_blocks")).alias("mean_block"),
        S.compress_memory(c).alias("compress_memory"), S.chain_memory(c).alias("memory"), largest.alias("dictionary"), "locked", "recovery", "comment",
        F.lit(0).cast("long").alias("sfx_size"), S.encrypted_by_substring(c).alias("headers_encrypted"), F.array_join(F.filter(F.transform(S.methods(c), lambda m: m["name"]), lambda n: n.rlike("^(" + "|".join(S.CIPHERS) + ")")), "+").alias("ciphers"),
    )


def technical(listed: DataFrame, blocks: DataFrame, chain: Column) -> DataFrame:
    """The widest listing: of files with grp, block, dir and name."""
    from stratafold.functions import scalars as S

    both = listed.join(blocks.select("grp", "block", "n_files"), ["grp", "block"])
    return full_path(both).select(
        "path", extension(F.col("name")).alias("ext"), "size", "block", (F.col("n_files") > 1).alias("solid"), chain.alias("method"), S.is_encrypted(chain).alias("encrypted")
    )


def violations(blocks: DataFrame) -> DataFrame:
    """(archive, pos, problem) of block descriptors (archive, type, pos, origsize, compsize) that cannot be right."""
    problems = F.array_compact(F.array(
        F.when(~F.col("type").between(0, 5), "unknown type"), F.when(F.col("origsize") <= 0, "nothing in it"),
        F.when(F.col("compsize") <= 0, "no data"), F.when(F.col("compsize") > F.col("pos"), "begins before the archive"),
    ))
    return blocks.select("archive", "pos", F.explode(problems).alias("problem"))


def listing_line(size: Column, packed: Column, name: Column) -> Column:
    """A line of the text listing: two right-aligned numbers and the name."""
    return F.concat(F.lpad(size.cast("string"), 12, " "), F.lpad(packed.cast("string"), 12, " "), F.lit(" "), name)
