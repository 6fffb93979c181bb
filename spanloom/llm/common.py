"""Shared helpers of the corpus operators: tables, staged results, Arrow batch bounds, prefix sums."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the word pattern [^\x20\x09-\x0D]+, which is also what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows and bytes of one Arrow batch, so that a Python worker's memory doesn't follow the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
#: Bits of the bitmap of wanted hashes: 4 MB, broadcast.
WANTED = 1 << 25
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, unless the session has smaller ones."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)).rstrip("bB"))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. In local mode, where that is unset, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: working tables need a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spanloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has executions that end in here delete their shuffle files, which else stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage, and a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def maybe_among(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """rows (with a column hash) with `maybe`: false where no row of `hashes` has that hash. The bitmap's size is fixed, whatever the rows."""
    place = lambda c: F.pmod(F.col(c), F.lit(WANTED)) + 1
    bits = hashes.select(place("hash").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    rows = rows.withColumn("_p", place("hash")).withColumn("_at", F.bitmap_bucket_number("_p"))
    rows = rows.join(F.broadcast(bits), F.col("_at") == F.col("_bucket"), "left")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)), 16, 10) as int)")
    on = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_p) % 8 as int))")) != 0, F.lit(False))
    return rows.withColumn("maybe", on).drop("_p", "_at", "_bucket", "_bits")


def prefix_sums(parts: DataFrame, queue: list[str], order: str, size: str, out: str) -> DataFrame:
    """parts (one row per queue and part) with `out`, the sum of `size` over the queue's earlier parts."""
    before = Window.partitionBy(*queue).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
