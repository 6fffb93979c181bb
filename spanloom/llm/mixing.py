"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by hash, form a stream of words that is cut into equal blocks of about
BLOCK words. The schedule has one slot for each BLOCK words of the mix: slot i has the golden-ratio point
(i * GOLDEN mod 2^31) / 2^31, which the cumulative targets map to a source. A source's slots are ranked; rank r takes
block r mod n in pass r div n, so that all blocks of a source have been taken equally often, but for the last pass.
Any prefix of the schedule meets the targets to within a few blocks.

Slots and blocks are numbered by prefix sums over chunks, so neither a hot source nor the whole schedule meets in one
task. The driver holds one row a source, and tasks one number a source, as targets depend on all sources. A target is at most TIMES its source's size, which the
surplus of words is dealt around, and a pass of a source beyond TIMES is never begun.

Defined results: a null text has no words and takes no part in a block (taken is 0); a null source is a source of its
own, last; repeated rows are shared and taken once each; null ids are allowed; other columns aren't read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import bound_batches, prefix_sums, stage, table, text_of

BLOCK, TIMES = 64, 3
#: 2^31 / golden ratio, made odd: multiples modulo 2^31 pass every point once.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Slots of a chunk, and documents of a bucket on average.
CHUNK, BUCKET = 1 << 15, 256


def count_words(texts: pa.Array) -> pa.Array:
    """bytes.split() splits on the same six characters as the pattern [^\x20\x09-\x0D]+."""
    return pa.array([len(t.split()) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def words(docs: DataFrame) -> Column:
    """Words of the text; a null text has none."""
    return F.arrow_udf(count_words, T.LongType())(text_of(docs))


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(text_of(docs))


def targets(sizes: list[int], weights: list[float], times: float = TIMES) -> list[float]:
    """Each source's share of all words by weight, at most times its size; what is above is dealt out again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / whole > times * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(times * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def slots(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chunks (chunk, begin, end, bases) to slot, source_no (its number) and rank: bases has the source's slots in earlier chunks. bounds: cumulative targets as points."""
    for batch in batches:
        for chunk, begin, end, bases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            i = np.arange(begin, end, dtype="i8")
            source = np.searchsorted(bounds, (i % POINTS) * GOLDEN % POINTS, side="right")
            order = np.argsort(source, kind="stable")
            grouped = source[order]
            first = np.searchsorted(grouped, grouped, side="left")
            rank = np.empty(len(i), "i8")
            rank[order] = np.arange(len(i)) - first
            base = np.zeros(len(bounds) + 1, "i8")
            for x in bases or ():
                base[x["source_no"]] = x["before"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), chunk, "i8")), pa.array(i), pa.array(source.astype("i4")), pa.array(rank + base[source])], ["chunk", "slot", "source_no", "rank"])


class Mix:
    """The parts of a mix: docs (with source sizes and places in the streams), blocks and schedule."""

    def __init__(self, docs: DataFrame, weights: list[float] | None = None, block: int = BLOCK, times: int = TIMES, row: str | None = None, tie: str | None = None, size: str | None = None, hash: str | None = None):
        """docs: doc_id, text, source. weights: by source in code point order, null last; 1, 2, 3, repeating, by default. row: a column of unique numbers, else rows are numbered here; tie: one of numbers that order rows of one id and text ahead of these; size, hash: what words() and text_hash() of the text gave, if that is known."""
        spark = docs.sparkSession
        bound_batches(spark)
        number, ahead = docs[row].cast("long") if row else F.monotonically_increasing_id(), docs[tie].cast("long") if tie else F.lit(0).cast("long")
        rows = docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), (docs[size] if size else words(docs)).alias("size"), (docs[hash] if hash else text_hash(docs)).alias("hash"), ahead.alias("tie"), number.alias("row"))
        self.rows = rows = stage(rows, "mix-rows")
        found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
        found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        weights = weights or [i % 3 + 1 for i in range(len(found))]
        target = targets(sizes, weights, times)
        total = sum(target)
        n_blocks = [max(1, round(s / block)) if s else 0 for s in sizes]
        self.sources = spark.createDataFrame([(i, r["source"], r["size"], t, n) for i, (r, t, n) in enumerate(zip(found, target, n_blocks, strict=True))], "source_no int, source string, source_size long, target double, n_blocks long").coalesce(1)
        # A source's blocks differ a little from BLOCK words; its slots are as many as its own blocks ask for.
        wanted = [t / s * n if s else 0.0 for t, s, n in zip(target, sizes, n_blocks, strict=True)]
        self.n_slots, self.times = round(sum(wanted)), times
        share = np.cumsum(wanted) / max(sum(wanted), 1e-9) * POINTS if wanted else np.zeros(0)
        self.bounds = np.floor(share).astype("i8")
        if len(self.bounds):
            self.bounds[np.flatnonzero(wanted)[-1] if total else -1 :] = POINTS
        # Places in a source's stream: buckets of the shuffled order, each source's buckets summed up, then rows in a bucket.
        most = max((r["docs"] for r in found), default=1)
        self.n_buckets = -(-most // BUCKET)
        rows = self.placed(rows)
        buckets = prefix_sums(rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")), ["source_no"], "bucket", "words", "before")
        self.buckets, self.rows_placed = buckets, rows
        self.docs = self.begun(rows.join(buckets.select("source_no", "bucket", "before"), ["source_no", "bucket"])).drop("key", "bucket", "before", "tie")

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, hash, source) with what self.sources has of the source, and their key and bucket in the shuffled order."""
        rows = rows.join(F.broadcast(self.sources), rows["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        return rows.withColumn("key", F.xxhash64("doc_id", "hash")).withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(self.n_buckets)).cast("int"))

    @staticmethod
    def begun(rows: DataFrame) -> DataFrame:
        """Placed rows of whole buckets and the words `before` these, with `begin`: the words ahead of the row in its source's stream."""
        within = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("begin", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    def turns(self) -> tuple[DataFrame, DataFrame]:
        """What taken() comes to a document, without its parts: a source's blocks are taken equally often, and the first few of them once more.

        A row a source (source_no, turns, more, edge): times that each of its words is taken, words of its stream that are taken
        once more, and the bucket in which these end (none: null). A row a document of such a bucket (row, extra): its words among those.
        """
        drawn = {r["source_no"]: r["n"] for r in self.drawn(self.chunks()).groupBy("source_no").agg(F.count("*").alias("n")).collect()}
        rows = []
        for r in self.sources.collect():
            n, blocks = drawn.get(r["source_no"], 0), r["n_blocks"]
            turns, first = divmod(min(n, self.times * blocks), blocks) if blocks else (0, 0)
            rows.append((r["source_no"], turns, first * r["source_size"] // blocks if blocks else 0))
        ends = self.rows.sparkSession.createDataFrame(rows, "source_no int, turns long, more long").coalesce(1)
        last = self.buckets.join(F.broadcast(ends), "source_no").where("more > 0 and before < more and more <= before + words")
        edges = stage(last.select("source_no", F.col("bucket").alias("edge"), "before"), "mix-edges")
        ends = stage(ends.join(edges.select("source_no", "edge"), "source_no", "left"), "mix-ends")
        own = self.rows_placed.join(F.broadcast(edges), "source_no").where("bucket = edge").join(F.broadcast(ends.select("source_no", "more")), "source_no")
        extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("begin")))
        return ends, stage(self.begun(own).select("row", extra.cast("long").alias("extra")), "mix-extra")

    def pieces(self) -> DataFrame:
        """Each document's part of each block that it reaches: block b of n holds the words from b * size div n to (b + 1) * size div n of its source."""
        first = F.expr("greatest(0L, (begin * n_blocks) div source_size - 1)")
        last = F.expr("least(n_blocks - 1, ((begin + size) * n_blocks) div source_size)")
        out = self.docs.where("size > 0").withColumn("block", F.explode(F.sequence(first, F.greatest(first, last))))
        low = lambda b: F.expr(f"({b}) * source_size div n_blocks")
        out = out.withColumn("from", F.greatest(F.lit(0), low("block") - F.col("begin"))).withColumn("to", F.least(F.col("size"), low("block + 1") - F.col("begin")))
        return out.where(F.col("to") > F.col("from")).select("doc_id", "row", "source_no", "block", "from", "to")

    def chunks(self) -> DataFrame:
        """id, begin, end and bases (null) of each chunk of slots."""
        count = -(-self.n_slots // CHUNK)
        ids = self.rows.sparkSession.range(0, count, 1, max(1, min(count // 4, 10_000)))
        return ids.select("id", (F.col("id") * CHUNK).alias("begin"), F.least((F.col("id") + 1) * CHUNK, F.lit(self.n_slots)).alias("end"), F.lit(None).cast("array<struct<source_no:int,before:bigint>>").alias("bases"))

    def drawn(self, chunks: DataFrame) -> DataFrame:
        """chunk, slot, source_no, rank of the slots of chunks."""
        bounds = self.bounds
        return chunks.mapInArrow(lambda b: slots(b, bounds), "chunk long, slot long, source_no int, rank long")

    def schedule(self) -> DataFrame:
        """slot, source_no, block and pass of every slot."""
        chunks = self.chunks()
        counts = self.drawn(chunks).groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
        counts = prefix_sums(counts, ["source_no"], "chunk", "n", "before").groupBy("chunk").agg(F.collect_list(F.struct("source_no", "before")).alias("bases"))
        # The slots are drawn again, from where earlier chunks end: what is joined has a row a chunk.
        counts = stage(counts, "mix-chunks")
        ranked = self.drawn(chunks.drop("bases").join(counts, F.col("id") == F.col("chunk"), "left").select("id", "begin", "end", "bases"))
        ranked = ranked.join(self.sources.select("source_no", "n_blocks"), "source_no")
        return ranked.select("slot", "source_no", F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks").alias("pass")).where(F.col("pass") < self.times)

    def taken(self) -> DataFrame:
        """doc_id, row, block, from, to, times: how often each document's part of a block is taken. Blocks never taken are left out."""
        drawn = self.schedule().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        return self.pieces().join(drawn, ["source_no", "block"])


def mix(docs: DataFrame, weights: list[float] | None = None, block: int = BLOCK, times: int = TIMES) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of `docs`."""
    plan = Mix(docs, weights, block, times)
    taken = plan.taken().groupBy("row").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"))
    out = plan.rows.join(plan.sources, plan.rows["source"].eqNullSafe(plan.sources["source"])).join(taken, "row", "left")
    return out.select("doc_id", plan.rows["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighed 1, 2, 3, repeating."""
    return mix(table(spark, sf_dir, "documents"))
