"""Quality by compression: two zstandard dictionaries, one trained on good and one on bad labelled texts.

A text is compressed with both, in blocks of BLOCK bytes so that a long text is judged by the dictionaries and not by
its own past. The difference of the two sizes, divided by the larger, is the raw figure; a logistic curve fitted on
labelled texts that the dictionaries haven't seen turns it into the probability of label 1.

The fit reads a bounded sample: at most PER_CLASS labelled rows of each class, the first by a hash of the id, and these
whole: those that train the dictionaries reach the driver, and of those that the curve is fitted on the raw figures,
computed on executors. Scoring reads every whole text. Rows whose
crc32(doc_id as text) mod 4 is 2 are never learnt from, and labels, language, source and id are no inputs of a score.

Defined results: a null or empty text has raw figure 0; without labels of both classes, all scores are the share of
label 1 (0.5 without any); null ids aren't held out; repeated rows each get the score; other columns aren't read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import bound_batches, table, text_of

PER_CLASS, DICTIONARY, LEVEL, BLOCK, KEEP = 2000, 1 << 15, 3, 4096, 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * x + self.offset))))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@functools.lru_cache(4)
def compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = []
    for content in (good, bad):
        words = zstandard.ZstdCompressionDict(content)
        words.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=params))
    return made[0], made[1]


def difference(text: bytes, good: bytes, bad: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / the larger."""
    with_good, with_bad = compressors(good, bad)
    a = b = 0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        a += len(with_good.compress(block))
        b += len(with_bad.compress(block))
    return (b - a) / max(a, b, 1)


@functools.cache
def filler() -> list[bytes]:
    """Samples without structure, the same ones always: with them the trainer has enough material whatever the texts are; without, it fails on few."""
    return [b"".join(hashlib.sha256(b"%d:%d" % (i, j)).digest() for j in range(64)) for i in range(64)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts and the filler."""
    samples = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    return zstandard.train_dictionary(DICTIONARY, samples + filler()).as_bytes()


def logistic(xs: list[float], ys: list[int]) -> tuple[float, float]:
    """Slope and offset by Newton's method, with Platt's smoothed targets and a slight ridge on the slope."""
    n1, n0 = sum(ys), len(ys) - sum(ys)
    goal = [(n1 + 1) / (n1 + 2) if y else 1 / (n0 + 2) for y in ys]
    a, b = 0.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, t in zip(xs, goal, strict=True):
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, a * x + b))))
            w = max(p * (1 - p), 1e-9)
            g1, g0 = g1 + (p - t) * x, g0 + p - t
            h11, h01, h00 = h11 + w * x * x, h01 + w * x, h00 + w
        g1, h11 = g1 + 1e-3 * a, h11 + 1e-3
        det = h11 * h00 - h01 * h01
        if det <= 1e-12:
            break
        da, db = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det
        a, b = a - max(-5.0, min(5.0, da)), b - max(-5.0, min(5.0, db))
        if abs(da) + abs(db) < 1e-7:
            break
    return max(a, 0.0), b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Half of the sample trains the dictionaries, half the curve."""
    may = labels.select(labels["doc_id"].alias("_id"), labels["quality"].cast("int").alias("_y")).where(~held_out(F.col("_id")) & F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).withColumn("_h", F.xxhash64("_id"))
    pick = [may.where(F.col("_y") == y).orderBy("_h", "_id").limit(per_class) for y in (0, 1)]
    sample = pick[0].unionByName(pick[1])  # at most 2 * per_class rows
    # Lists of the sample that reach the driver hold texts or figures, in one order.
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_h", "_y", F.xxhash64("text").alias("_t"), "text")
    first = lambda what, of: of.select("_h", "_y", "_t", what.alias("_x")).orderBy("_h", "_y", "_t").limit(2 * per_class).collect()
    learnt = F.col("_h").bitwiseAND(1) == 1
    whole = first(F.when(learnt, F.col("text")), rows)
    ones = sum(r["_y"] for r in whole)
    if not ones or ones == len(whole):
        share = (ones + 1e-9) / (len(whole) + 2e-9)
        return Model(b" " * 8, b" " * 8, 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    good, bad = (dictionary([r["_x"].encode() for r in whole if r["_y"] == side and r["_x"] is not None]) for side in (1, 0))
    figure = F.arrow_udf(lambda texts: pa.array([difference(t, good, bad) for t in texts.cast(pa.binary()).to_pylist()], pa.float64()), T.DoubleType())
    rest = rows.where(~learnt) if any(not r["_h"] & 1 for r in whole) else rows
    curve = [r for r in first(figure("text"), rest) if tuple(r)[:3] <= tuple(whole[-1])[:3]]
    return Model(good, bad, *logistic([r["_x"] for r in curve], [r["_y"] for r in curve]))


def score(model: Model) -> Column:
    """Probability of label 1 of a text column, to be called on it."""
    return F.arrow_udf(lambda texts: pa.array([model.probability(difference(t, model.good, model.bad)) for t in texts.cast(pa.binary()).to_pylist()], pa.float64()), T.DoubleType())


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bound_batches(docs.sparkSession)
    model = fit(docs, labels)
    out = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), score(model)(text_of(docs)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= keep).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, all columns."""
    bound_batches(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select(F.struct("*").alias("_row"), score(model)(text_of(docs)).alias("_score"))
    return rows.where(F.col("_score") >= keep).select("_row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents, learnt from labels.quality."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
