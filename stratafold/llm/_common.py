"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate whitespace-delimited words: space and \t..\r.
WS_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session in one process (unit tests) that names none gets a temporary one; on a cluster it has to be named.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratafold-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch where the session keeps Spark's default of 10,000, which whole texts overfill.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its JVM side hold at a time; a value set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


#: Rows of a file that cut() writes, where it knows how many rows there are about.
FILE_ROWS = 25_000


def cut(df: DataFrame, rows: int | None = None, forget: bool = False) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder.

    rows: about how many there are, by which small results of a shuffle come in fewer files than it
    has partitions. forget: the planner's estimate of the size goes too; it multiplies with every
    join of an iteration and comes to numbers of millions of digits.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if rows is not None:
        df = df.coalesce(max(1, min(rows // FILE_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    kept = out = df.checkpoint(eager=True)
    if forget:
        out = DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)
    out.cut_path = kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*cuts: DataFrame) -> None:
    """Remove the checkpoints of cut(), once nothing that will be computed reads them."""
    for df in cuts:
        remove(df.sparkSession, df.cut_path)


#: Rows of a key up to which it is no hot one, however few rows there are.
HOT_ROWS = 1000


def hot_limit(spark: SparkSession, rows: int) -> int:
    """Rows of a key beyond which it is split: at most four such keys a shuffle partition can exist."""
    return max(HOT_ROWS, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread_join(left: DataFrame, right: DataFrame, on: str, count: str, limit: int) -> DataFrame:
    """left joined with right, which has a row for each key and, in ``count``, left's rows of that key.

    A key of more than ``limit`` rows is dealt over count / limit salts, right's row being copied
    to each. Such keys are broadcast to left: as their counts add up to no more than left's rows,
    there are at most rows / limit of them.
    """
    pieces = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = right.where(F.col(count) > limit).select(F.col(on).alias("__hot"), pieces.alias("__pieces"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.coalesce("__pieces", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), left[on] == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot", "__pieces")
    copied = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    return dealt.join(copied, [on, "__salt"]).drop("__salt")


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
