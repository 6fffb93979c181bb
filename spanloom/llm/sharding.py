"""Sharding along a Hilbert curve over quantised metadata.

Three dimensions - size class, language and source - are quantised into 16 equi-depth steps each. The cell's place on
the Hilbert curve is looked up in a table of 4096 entries, documents are sorted by it, and the order is cut into runs
with as many rows each, at most one apart. A run thus covers a compact region, and statistics of any of the three
columns prune whole shards. Texts don't move: only ids, sizes and checksums are sorted, by range; places follow from
the counts of the range partitions. Ties of the curve are broken by checksum, size and id, so equal texts of a cell lie
side by side, a hot cell splits over partitions, and reruns agree.

Defined results: a null text has no bytes; null languages, sources and ids sort last; repeated rows take a slot each;
other columns aren't read, whatever their names; an empty table gives no rows; with fewer rows than shards, some
shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import stage, table, text_of

BITS, DIMS, SHARDS, OVERHEAD = 4, 3, 40, 16
STEPS = 1 << BITS


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Place of a point on the Hilbert curve, after J. Skilling, Programming the Hilbert curve (2004)."""
    x = list(point)
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | ((x[i] ^ t) >> b & 1)
    return place


def curve() -> list[int]:
    """Curve index of each cell, cells numbered with the last dimension fastest."""
    return [hilbert_index((c // STEPS**2, c // STEPS % STEPS, c % STEPS)) for c in range(STEPS**DIMS)]


def size_class(size: str) -> Column:
    """Quarter octaves of a size: its number of bits and the two bits behind the first."""
    return F.expr(f"length(bin({size})) * 4 + (shiftright({size}, greatest(length(bin({size})) - 3, 0)) & 3)")


def steps(rows: DataFrame, column: str) -> DataFrame:
    """Each value of a dimension and its equi-depth step: the share of rows before the middle of its own. Nulls last.

    Values are summed up by range, each range in a task of its own, and ranges by their totals.
    """
    order = F.col("_v").asc_nulls_last()
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("n"))
    ranged = stage(counts.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "shard-values")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row for each range partition
    before, whole = {}, 0
    for r in sums:
        before[r["part"]] = whole
        whole += r["n"]
    offsets = F.lit([before.get(i, 0) for i in range(max(before, default=-1) + 1)] or [0]).cast("array<bigint>")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + F.get(offsets, F.col("part"))
    return ranged.withColumn("upto", upto).select("_v", F.expr(f"cast((upto * 2 - n) * {STEPS} div ({max(whole, 1)}L * 2) as int)").alias(f"step_{column}"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and curve of every row of `docs` (doc_id, text, lang, source)."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"))
    rows = stage(rows.withColumn("class", size_class("size")), "shard-rows")
    for dim in ("class", "lang", "source"):
        step = stage(steps(rows, dim), "shard-steps")  # staged, its size is known: it is broadcast only if it is small
        rows = rows.join(step, rows[dim].eqNullSafe(step["_v"]), "left").drop("_v")
    cell = (F.col("step_class") * STEPS + F.col("step_lang")) * STEPS + F.col("step_source")
    rows = rows.select("doc_id", "size", "text_crc32", F.get(F.lit(curve()), cell).alias("curve"))
    order = ["curve", "text_crc32", "size", F.col("doc_id").asc_nulls_last()]
    # The id is the partition's number and the row's in it, as sorted; staged, it stays.
    ranked = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("at", 33)
    counts = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each range partition
    before, total = {}, 0
    for r in counts:
        before[r["part"]] = total
        total += r["n"]
    offsets = F.lit([before.get(i, 0) for i in range(max(before, default=-1) + 1)] or [0]).cast("array<bigint>")
    place = F.get(offsets, part.cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)
    cut = lambda n: F.expr(f"cast(place * {n} div {max(total, 1)} as int)")
    out = ranked.withColumn("place", place).withColumn("shard", cut(shards))
    first = F.expr(f"(cast(shard as bigint) * {max(total, 1)} + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - first).cast("long").alias("slot"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, column: str = "doc_id") -> DataFrame:
    """The documents as Parquet files, a folder `shard=n` for each shard, in curve order. Returns the assignment. Needs unique ids."""
    placed = stage(hilbert_shards(docs, shards), "shard-places")
    keys = placed.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    held = docs.join(keys, docs[column].eqNullSafe(keys["_id"]))
    held = held.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    held.withColumn("shard", F.col("_shard")).drop("_id", "_shard", "_slot").write.partitionBy("shard").parquet(path)
    return placed


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the curve, by rows."""
    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")

