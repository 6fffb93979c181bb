"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014).

Blocks of edges are contracted first, each in its task: a block's edges become ties of its nodes to the smallest that
they reach in it. A block has BLOCK edges on average, so tasks grow in number and not in size, and edges of one block
are done. What several blocks leave goes on in steps. Every step is a group-by and a join of edges, so nothing is
gathered on the driver; each is staged, so a lost executor costs no more than the step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stage, unstage

#: Edges that a task contracts, on average.
BLOCK = 1 << 18


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v of a block's edges to each node and the smallest that it reaches in the block, but for these themselves."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, v = top(u), top(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    nodes = list(above)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], ["u", "v"])


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself; with repeats, which _small() drops."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select("v", F.lit(0).alias("out"), F.lit(1).alias("in")).withColumnRenamed("v", "node"))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out = 1 and in = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, component (its smallest node) of every node that isn't the smallest of its component; staged."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    blocks = -(-edges.count() // BLOCK)
    held = stage(edges.coalesce(max(1, blocks)).mapInArrow(contract, "u long, v long"), "edges")
    while blocks > 1 and not _stars(held):
        held, old = stage(_small(_large(held)), "edges"), held
        unstage(old)
    return held.select(F.col("u").alias("node"), F.col("v").alias("component"))
