"""Exact deduplication with a heavy-hitter split.

Each row gets the SHA-256 of its text with A-Z lower-cased. Misra-Gries summaries of the digests, one per task, are
summed; a digest with more than 1/(COUNTERS + 1) of the rows can't be missing from the sum, and at most COUNTERS
digests can reach the bound, so the winners that an exact count verifies are few whatever the input. They are
broadcast, and copies of hot texts are decided on the map side. The remaining digests, none of them hot, use an
ordinary shuffle.

Defined results: a null text counts as empty; null ids count as smallest; of repeated rows with the winner's id just
one is kept; other columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import LOWER, UPPER, bound_batches, maybe_among, stage, table, text_of

#: Counters of a Misra-Gries summary; also the most rows that are broadcast.
COUNTERS = 1000


def digests(texts: pa.Array) -> pa.Array:
    """SHA-256 of each text with A-Z lower-cased: bytes.lower() changes these letters only."""
    return pa.array([hashlib.sha256(t.lower()).digest() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def digest(text: Column) -> Column:
    return F.arrow_udf(digests, T.BinaryType())(text)


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int = COUNTERS) -> Iterator[pa.RecordBatch]:
    """(digest, least count) of the digests that survive, and a row with a null digest for the number of rows seen."""
    held: dict[bytes, int] = {}
    rows = 0
    for batch in batches:
        rows += len(batch)
        for x in batch.column(0).to_pylist():
            if x in held:
                held[x] += 1
            elif len(held) < counters:
                held[x] = 1
            else:
                held = {k: n - 1 for k, n in held.items() if n > 1}
    yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.binary()), pa.array([*held.values(), rows], pa.int64())], ["digest", "n"])


def heavy_winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """rows: digest, doc_id, row. digest, n, win of each digest with over about 1/counters of the rows, n and win exact; at most `counters` rows."""
    summed = rows.select("digest").mapInArrow(lambda b: misra_gries(b, counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    likely = stage(summed.where("digest is null or n > 1"), "heavy-likely")
    bound = (likely.where("digest is null").agg(F.sum("n")).first()[0] or 0) // (counters + 1)
    likely = likely.where((F.col("n") > max(1, bound)) & F.col("digest").isNotNull()).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    return rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("win")).where("n > 1")


def decide(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every row of `docs` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    rows = stage(docs.select(docs["doc_id"], digest(text_of(docs)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = stage(heavy_winners(rows, counters), "heavy-winners")
    hot = rows.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "row", "n", "win")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select("doc_id", "digest", "row", F.count("*").over(same).alias("n"), F.max(F.struct("doc_id", "row")).over(same).alias("win"))
    return hot.unionByName(rest).select("doc_id", "digest", F.col("win.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("win.row")).alias("kept"))


def keep_largest(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """docs without copies, all columns: of equal texts one row with the largest doc_id.

    Rows of hot digests that can't win leave on the map side, and texts that no other row has stay there: a bitmap of
    fixed size tells which may be repeated. Only these meet, once, combined per task before the shuffle.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = stage(docs.select(docs["doc_id"], digest(text_of(docs)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = stage(heavy_winners(rows, counters), "heavy-winners").select(F.col("digest").alias("_hot"), F.col("win.doc_id").alias("_win"))
    repeated = stage(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("digest").alias("hash")), "repeated")
    held = docs.select(F.struct("*").alias("_row"), docs["doc_id"].alias("_id"), digest(text_of(docs)).alias("_digest"))
    held = held.join(F.broadcast(heavy), F.col("_digest") == F.col("_hot"), "left").where(F.col("_hot").isNull() | F.col("_id").eqNullSafe(F.col("_win")))
    held = maybe_among(held.select("_row", "_id", "_digest", F.xxhash64("_digest").alias("hash")), repeated)
    best = held.where("maybe").groupBy("_digest").agg(F.max_by("_row", F.struct("_id", "_digest")).alias("_row"))
    return held.where("not maybe").select("_row.*").unionByName(best.select("_row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it stays, and which of its copies does."""
    return decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""
