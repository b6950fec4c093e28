"""Helpers shared by the operators: tables written to the shared folder, column checks, word pattern."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the ASCII blanks (fixed value, as the contracts state it).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
# Bits of the filters that leave rows out of a shuffle (1 MB in all).
FILTER_BITS = 1 << 23
# Spark's setting for deleting the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see: the one in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster the setting is required, as executors could not see such a folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fieldtally-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted as each query ends, not when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again.

    This cuts the lineage (lost executors cost a re-read, not a recomputation), keeps
    columns prunable and runs the work exactly once. Nothing reads the shuffles of the write once it
    is done, so their files go at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with brief_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once nothing will read them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _maybe_marked(df: DataFrame, hashed: Column, wanted: DataFrame, wanted_hash: Column, how: str) -> DataFrame:
    """`df` with `__maybe`, whether its 64-bit hash may be among those of `wanted`; an inner join leaves some of the others out."""
    bit = F.pmod(wanted_hash, F.lit(FILTER_BITS))
    parts = wanted.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits"))
    bit = F.pmod(hashed, F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))).cast("int"), F.lit(2)) == 1
    return df.join(F.broadcast(parts), F.bitmap_bucket_number(bit) == F.col("__bucket"), how).select(
        *df.columns, F.coalesce(hit, F.lit(False)).alias("__maybe"))


def maybe_among(df: DataFrame, hashed: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """Rows of `df` whose 64-bit hash may be among those of `wanted`, by a bitmap of FILTER_BITS bits.

    The bitmap is broadcast and has the same size for any input. Rows that pass by chance are for a later
    join to drop; no wanted row is lost.
    """
    return _maybe_marked(df, hashed, wanted, wanted_hash, "inner").filter("__maybe").select(*df.columns)


def maybe_marked(df: DataFrame, hashed: Column, wanted: DataFrame, wanted_hash: Column) -> DataFrame:
    """All rows of `df` and `__maybe`: false where their 64-bit hash is not among those of `wanted` (see `maybe_among`)."""
    return _maybe_marked(df, hashed, wanted, wanted_hash, "left")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and text are not in the stored `keys(doc_id, text_hash)`; columns as they were.

    Only rows that may be among the keys are shuffled to meet them; the others stay where they are.
    """
    marked = maybe_marked(docs.withColumn("__hash", F.xxhash64(text_or_empty())), F.xxhash64("doc_id", "__hash"),
                          keys, F.xxhash64("doc_id", "text_hash"))
    gone = keys.select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash"))
    checked = marked.filter("__maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")) &
                                            (F.col("__hash") == F.col("__gone_hash")), "left_anti")
    return marked.filter("not __maybe").select(*docs.columns).unionByName(checked.select(*docs.columns))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def words_of(text: Column) -> Column:
    """The words of a non-null text in order; none for a blank one."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS, -1))
