"""Exact top-k by inner product: tiled matrix products, partial selection in each tile, tree merging.

Queries and vectors are dealt over a grid: each query goes to one row of tiles, each vector to one column, by its
number, so tiles are equal whatever the ids and no vector is hot. A tile holds at most QUERIES x VECTORS rows; it is
one matrix product in 64-bit floats while no sum can reach 2^53, else of Python integers, and keeps each query's k best
by partial selection. The lists of a row of tiles merge in FAN-fold levels of a tree.

Defined results: vectors that are null, or hold null or non-finite components or one that is 2^63 or more when scaled,
take no part; shorter vectors count as if filled with zeros, empty ones too; a score beyond 64 bits counts as the
largest or smallest 64-bit integer; repeated rows are rows of their own, and a query leaves out its own row only; null ids
are no queries and sort last among ties; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, stage, table

#: Most rows of a tile, whose scores take 8 * BLOCK * VECTORS bytes at a time; below that, about COLUMNS columns of LEAST vectors at least.
QUERIES, VECTORS, LEAST, COLUMNS, BLOCK, FAN = 8192, 1 << 16, 1 << 10, 16, 128, 16


LARGEST = 2**63 - 1


def tile(k: int) -> Callable:
    def best(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """Each query's k best vectors of the tile: highest score, then smallest place among the vectors in order of id."""
        names = ["query", "query_id", "node", "row", "vec_id", "score"]
        out: list[list] = [[] for _ in names]
        if len(queries) and len(vectors):
            vectors = vectors.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
            width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (queries, vectors))
            dense = lambda t, kind: _dense(t.column("v"), width, kind)
            q, v = dense(queries, "f8"), dense(vectors, "f8")
            n, ids, rows = len(vectors), vectors.column("id").to_pylist(), vectors.column("row").to_numpy()
            exact = float(max(np.abs(q).max(initial=0), 1)) * float(max(np.abs(v).max(initial=0), 1)) * width < 2**53
            if not exact:
                q, v = dense(queries, object), dense(vectors, object)
            places, take = np.arange(n), min(n, k + 1)
            query_rows, query_ids = queries.column("row").to_pylist(), queries.column("id").to_pylist()
            for at in range(0, len(q), BLOCK):
                scores = q[at : at + BLOCK] @ v.T
                if not exact:
                    scores = np.vectorize(lambda x: min(max(x, -LARGEST - 1), LARGEST), otypes=[object])(scores) if scores.size else scores
                for i, line in enumerate(scores):
                    if exact:
                        floor = np.partition(line, n - take)[n - take]
                        above, ties = np.flatnonzero(line > floor), np.flatnonzero(line == floor)
                        chosen = np.concatenate([above, ties[: take - len(above)]])
                    else:
                        chosen = np.array(sorted(places, key=lambda p: (-line[p], p))[:take])
                    chosen = [p for p in sorted(chosen, key=lambda p: (-line[p], p)) if rows[p] != query_rows[at + i]][:k]
                    for name, values in zip(names, ([query_rows[at + i]] * len(chosen), [query_ids[at + i]] * len(chosen), [key[1]] * len(chosen), [int(rows[p]) for p in chosen], [ids[p] for p in chosen], [int(line[p]) for p in chosen]), strict=True):
                        out[names.index(name)].extend(values)
        kind = queries.schema.field("id").type
        return pa.table([pa.array(c, t) for c, t in zip(out, [pa.int64(), kind, pa.int32(), pa.int64(), kind, pa.int64()], strict=True)], names)

    return best


def _dense(column: pa.ChunkedArray, width: int, kind: str | type) -> np.ndarray:
    """Rows of 64-bit integers as a matrix of kind; object makes Python integers of them."""
    column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum([0, *sizes])
    if width and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), kind)
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        out[i, : b - a] = flat[a:b]
    return out


def top_k(vectors: DataFrame, key: str, values: str, is_query: Column, k: int, scale: int = 64, queries: int = QUERIES, size: int = VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that is_query the k rows with the highest inner products of floor(scale * x), without its own."""
    spark = vectors.sparkSession
    bound_batches(spark)
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)) & (F.abs(x * scale) < 2.0**63))
    rows = vectors.select(vectors[key].alias("id"), vectors[values].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = rows.where(sound).select("id", whole.alias("v"), "asks").withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "topk-vectors")
    asked, total = rows.agg(F.count_if("asks"), F.count("*")).first()
    high, wide = max(1, -(-asked // queries)), max(1, -(-total // min(size, max(LEAST, total // COLUMNS))))
    # Each row's own number deals it out evenly; every query goes to all columns and every vector to all rows of tiles.
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = rows.where("asks").select(deal(high).alias("i"), each(wide).alias("j"), "row", "id", "v")
    # Named anew: a cogroup of a table with itself mixes up columns of the same identity.
    has = rows.select(each(high).alias("i"), deal(wide).alias("j"), *[F.col(c).alias(c, metadata={}) for c in ("row", "id", "v")])
    kind = dict(rows.dtypes)["id"]
    best = asks.groupBy("i", "j").cogroup(has.groupBy("i", "j")).applyInArrow(tile(k), f"query long, query_id {kind}, node int, row long, vec_id {kind}, score long")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"]
    while True:
        best = best.withColumn("node", F.floor(F.col("node") / FAN).cast("int"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query", "node").orderBy(*order))).where(F.col("rank") <= k)
        wide = -(-wide // FAN)
        if wide <= 1:
            return best.select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every vec_id that is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
