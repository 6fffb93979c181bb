"""A training corpus from documents: quality, exact copies, near copies, mixture, packing.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
in the shared folder and reads it again as the next stage's documents. All but the last return the columns of
documents, whatever these are.

Defined results: see the operators. A stage that keeps no row gives an empty table of the same columns, which the
stages behind it turn into empty results.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, stage, table
from spanloom.llm.exact_dedup import keep_largest
from spanloom.llm.mixing import Mix, text_hash, words
from spanloom.llm.ngram_jaccard import keep_one
from spanloom.llm.packing import pack
from spanloom.llm.quality import keep_good

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on `labels`, doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return keep_largest(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return keep_one(docs)


def _cut(texts: pa.Array, ends: pa.Array) -> pa.Array:
    """Each text's words before the word of that number, with the white space behind them."""
    out = []
    for text, end in zip(texts.cast(pa.binary()).to_pylist(), ends.to_pylist(), strict=True):
        nth = next(itertools.islice(_WORD.finditer(text), end, None), None)
        out.append(text[: nth.start() if nth else len(text)].decode())
    return pa.array(out, pa.string())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, weighed 1, 2, 3, repeating: a document's row for each pass that takes any of its words, with those words.

    A pass over a source takes a stretch of its stream, so a document is taken whole but for those where the last pass
    ends. Its source and its place in the shuffled order say how often; only documents of the one bucket of a source in
    which its last pass ends meet a table, and no other text moves.

    n_chars, where documents have it, follows the text. Documents without words carry nothing to mix and stay out. Rows
    are told apart by a number of their own, so rows of one id and text each take their own turns; which of them comes
    first follows a hash of the whole row, so reruns agree.
    """
    bound_batches(spark)
    whole_row = F.to_json(F.struct(*[docs[c].cast("string") for c in docs.columns]))
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(whole_row).alias("_tie"), words(docs).alias("_size"), text_hash(docs).alias("hash"), F.monotonically_increasing_id().alias("_number"))
    rows = stage(rows, "mix-numbered")
    plan = Mix(rows.select("_row.doc_id", "_row.source", "_tie", "_size", "hash", "_number"), row="_number", tie="_tie", size="_size", hash="hash")
    ends, extra = plan.turns()
    rows = plan.placed(rows.where("_size > 0").select("_row", "_size", "_number", "hash", "_row.doc_id", F.col("_row.source").cast("string").alias("source"))).select("_row", "_size", "_number", "source_no", "bucket")
    rows = rows.join(F.broadcast(ends), "source_no")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    sure = rows.where(~at_edge).withColumn("extra", F.when(F.col("bucket") < F.col("edge"), F.col("_size")).otherwise(0))
    out = sure.unionByName(rows.where(at_edge).join(extra, F.col("_number") == F.col("row")).drop("row"))
    # The words that each pass takes, from the first on.
    out = out.withColumn("_end", F.explode(F.concat(F.array_repeat("_size", F.col("turns").cast("int")), F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<bigint>")))))
    whole = F.col("_end") == F.col("_size")
    cut = F.arrow_udf(_cut, "string")
    some = cut(F.when(whole, F.lit("")).otherwise(F.col("_row.text")), F.col("_end"))
    out = out.withColumn("_cut", F.when(whole, F.col("_row.text")).otherwise(some))
    cols = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_cut")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("_cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents of the mix in sequences of 2048 tokens; doc_id isn't unique in the mix."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the hashed order of the mix and the tokenizer can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None
