"""Files of a file system as a source and a sink: find them, write archives' contents, remove what was moved.

``find`` lists through Spark's readers, so any store that they open will do. ``extract`` and
``remove`` write and delete with the executors' own file calls: their root must be a folder that
all executors share, under the same path. A file is written beside its place and put there in one
step, so that a task that is run again leaves whole files only.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path, PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.arrow import append
from stratafold.functions.scalars import matches


def find(spark: SparkSession, path: str, recursive: bool = True, masks: list[str] | None = None) -> DataFrame:
    """(path, size, mtime) of the files below a folder whose base names match a mask; their content is not read.

    Spark's scan passes over empty files. They are added from the listing that the reader keeps on the
    driver for any scan, without a time.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    f = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    listed = [(unquote(x),) for x in found.inputFiles()]
    if listed:
        names = spark.createDataFrame(listed, "path string").withColumn("__at", F.regexp_replace("path", "^[a-z]+:/+", "/"))
        seen = f.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("__at"))
        empty = names.join(seen, "__at", "left_anti")
        f = f.union(empty.select("path", F.lit(0).cast("long"), F.lit(None).cast("timestamp")))
    return f if masks is None else f.where(matches(F.element_at(F.split("path", "/"), -1), masks))


def _inside(root: str, path: str) -> Path:
    """The place of a path below a root; a path that leads out of it is an error."""
    parts = PurePosixPath(path.replace("\\\\", "/")).parts
    if not parts or ".." in parts or parts[0].startswith("/") or ":" in parts[0]:
        raise ValueError(f"a path that leads out of the folder: {path!r}")
    return Path(root, *parts)


def extract(contents: DataFrame, root: str, flat: bool = False, policy: str = "overwrite") -> DataFrame:
    """Write files (dir, name, mtime seconds, content) below root; (path, size, written) of each.

    flat: by their names alone. policy: ``overwrite``, ``skip`` what is there, or ``update`` what is
    older there. Folders are made as needed and times restored; a null content is an empty file.
    """
    if policy not in ("overwrite", "skip", "update"):
        raise ValueError(f"no policy {policy}")

    def write(folder: str | None, name: str, mtime: int | None, content: bytes | None) -> tuple:
        path = name if flat or not folder else f"{folder}/{name}"
        place = _inside(root, path)
        there = place.exists()
        if there and (policy == "skip" or policy == "update" and (mtime or 0) <= place.stat().st_mtime):
            return path, place.stat().st_size, False
        place.parent.mkdir(parents=True, exist_ok=True)
        part = place.with_name(f".{place.name}.{uuid.uuid4().hex}")
        part.write_bytes(content or b"")
        if mtime is not None:
            os.utime(part, (mtime, mtime))
        os.replace(part, place)
        return path, len(content or b""), True

    picked = contents.select(F.col("dir").alias("__dir"), F.col("name").alias("__name"), F.col("mtime").cast("long").alias("__mtime"), F.col("content").cast("binary").alias("__content"))
    out = append(picked, picked.columns, [("path", "string"), ("size", "long"), ("written", "boolean")], write)
    return out.select("path", "size", "written")


def remove(paths: DataFrame, root: str) -> DataFrame:
    """Delete files (path) below root, as a move does once they are archived; (path, removed) of each."""

    def gone(path: str) -> tuple:
        place = _inside(root, path)
        there = place.is_file()
        place.unlink(missing_ok=True)
        return (there,)

    return append(paths.select("path"), ["path"], [("removed", "boolean")], gone)
