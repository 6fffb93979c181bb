"""Phrases of two and three words that occur more often than their parts let expect, mined by pivots as MG-FSM does.

Documents are read in blocks; a block's words become numbers of its own, and words are counted over all blocks. What
is rarer than a candidate may be is a blank from then on. An n-gram belongs to its pivot: its rarest word by (count,
id), at the first place of it. So at each place of a block one fragment is cut: the word there, as pivot, with up to
two words on either side, as far as all of them are no rarer; what a pivot can't own isn't sent. Equal fragments of a
block are one row with a count. Fragments are routed by pivot, and a pivot's partition counts the n-grams that it
owns: nothing but what reaches the least count leaves it. A pivot that occurs very often owns few different n-grams,
but its fragments may be many: it is dealt over several partitions by the fragments' hash, and these partial counts are
added up. Parts' counts and longer phrases are then joined to candidates only.

Counts are 64-bit integers, and scores quotients of 38-digit decimals, which hold 10^6 * a * a up to a = 3 * 10^15.

Defined results: a null text is empty; a null language is 'und'; repeated rows count each; a language without
candidates gives no rows, an empty table none at all; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import LOWER, UPPER, bound_batches, stage, table, text_of

LEAST, INSIDE, TOP = 10, 50, 2000
#: Bytes of a block, rows of a batch of dictionary entries, fragments of a partition on average, and occurrences of a pivot that one partition takes.
BLOCK, ROWS, PARTITION, HOT = 1 << 25, 1 << 15, 1 << 19, 1 << 18
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, and all that ends a piece as one character, which then stands alone.
_TABLE = bytes.maketrans(UPPER.encode() + BREAKS, LOWER.encode() + b"." * len(BREAKS))
NUMBERED = "block long, codes binary, idx int, lang string, word string, n long"
_NUMBERED = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("idx", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
FRAGMENTS = "pivot long, splits int, split int, l2 long, l1 long, r1 long, r2 long, n long"
_NAMES = ["pivot", "splits", "split", "l2", "l1", "r1", "r2", "n"]


class Words(dict):
    """Numbers a language's words; numbers are unique in the block."""

    def __init__(self, numbers: Iterator[int]):
        self.numbers = numbers
        self[b"."] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.numbers)
        return n


def number(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """lang, text to NUMBERED: words as codes, -1 between pieces, and a block's dictionary with its counts."""
    block, size, numbers, known, seen = TaskContext.get().partitionId() << 32, 0, itertools.count(), {}, []

    def made(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [block] * n if f.name == "block" else [None] * n), f.type) for f in _NUMBERED], schema=_NUMBERED)

    def dictionary() -> Iterator[pa.RecordBatch]:
        counts = _added(seen)
        for lang, words in known.items():
            own = [(w, i) for w, i in words.items() if i >= 0]
            for at in range(0, len(own), ROWS):
                some = own[at : at + ROWS]
                yield made(idx=[i for _, i in some], lang=[lang] * len(some), word=[w.decode() for w, _ in some], n=[int(counts[i]) for _, i in some])

    for batch in batches:
        flat: list[int] = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = known.get(lang)
            if words is None:
                words = known[lang] = Words(numbers)
            flat.extend(map(words.__getitem__, text.translate(_TABLE).replace(b".", b" . ").split()))
            flat.append(-1)
            size += len(text)
        codes = np.array(flat, "i4")
        seen.append(np.bincount(codes[codes >= 0]) if len(codes) else np.zeros(0, "i8"))
        yield made(codes=[codes.tobytes()])
        if size >= limit:
            yield from dictionary()
            block, size, numbers, known, seen = block + 1, 0, itertools.count(), {}, []
        elif len(seen) > 16:
            seen = [_added(seen)]
    yield from dictionary()


def _added(counts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(max(map(len, counts), default=0), "i8")
    for x in counts:
        out[: len(x)] += x
    return out


def cut_fragments(codes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rows (pivot, l1, r1, l2, r2) of ranks, -1 for none, of all places that own anything. rank: by code, -1 for blanks; its last is that of -1."""
    edge = np.full(2, -1)
    r = np.concatenate([edge, rank[codes], edge])
    p = r[2:-2]
    beside = lambda by: r[2 + by : len(r) - 2 + by]
    # Of equal words the first is the pivot: what is before it has to be more frequent, what is behind at least as frequent.
    l1 = np.where((p >= 0) & (beside(-1) > p), beside(-1), -1)
    r1 = np.where((p >= 0) & (beside(1) >= p), beside(1), -1)
    l2 = np.where((l1 >= 0) & (beside(-2) > p), beside(-2), -1)
    r2 = np.where((r1 >= 0) & (beside(2) >= p), beside(2), -1)
    owns = (l1 >= 0) | (r1 >= 0)
    return np.stack([x[owns] for x in (p, l1, r1, l2, r2)])


def counted(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of rows, and how often each occurs. Values lie from -1 to n - 1, n below 2^31."""
    keys = [rows[0] * (n + 1) + rows[1] + 1, (rows[2] + 1) * (n + 1) + rows[3] + 1, rows[4]]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return rows[:, order[first]], np.diff(np.append(first, len(order)))


def fragments(key: tuple, parts: pa.Table, known: pa.Table, hot: int) -> pa.Table:
    """A block's codes and its frequent words (idx, id, f) to FRAGMENTS."""
    parts_codes = [np.frombuffer(x, "i4") for x in parts.column("codes").to_pylist()]
    codes = np.concatenate(parts_codes) if parts_codes else np.zeros(0, "i4")
    idx, ids, f = (known.column(c).to_numpy() for c in ("idx", "id", "f"))
    order = np.lexsort((ids, f))
    ids, f = ids[order], f[order]
    rank = np.full(int(max(codes.max(initial=-1), idx.max(initial=-1))) + 2, -1, "i8")
    rank[idx[order]] = np.arange(len(order))
    rows, n = counted(cut_fragments(codes, rank), len(order))
    name = lambda x: np.where(x >= 0, ids[x], -1) if len(ids) else x
    pivot, l1, r1, l2, r2 = map(name, rows)
    splits = (f[rows[0]] // hot + 1).astype("i4") if len(f) else np.zeros(0, "i4")
    with np.errstate(over="ignore"):
        mixed = ((l2 * 31 + l1) * 31 + r1) * 31 + r2
        mixed = (mixed ^ (mixed >> 29)) * np.int64(0x1B873593CC9E2D51)
    split = ((mixed >> 33) % splits).astype("i4")
    columns = [pivot, splits, split, l2, l1, r1, r2, n]
    return pa.table([pa.array(c, pa.int32() if name.startswith("split") else pa.int64()) for name, c in zip(_NAMES, columns, strict=True)], _NAMES)


def owned(fragments_: DataFrame, least: int, partitions: int) -> DataFrame:
    """a, b, c (-1 for none), n: the n-grams that occur at least that often. Each pivot's partition counts its own."""
    gram = lambda a, b, c=F.lit(-1).cast("long"): F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    p, l2, l1, r1, r2 = (F.col(x) for x in ("pivot", "l2", "l1", "r1", "r2"))
    have = lambda x, g: F.when(x >= 0, g)
    grams = F.array_compact(F.array(have(l1, gram(l1, p)), have(r1, gram(p, r1)), have(l2, gram(l2, l1, p)), F.when((l1 >= 0) & (r1 >= 0), gram(l1, p, r1)), have(r2, gram(p, r1, r2))))
    routed = fragments_.repartition(partitions, "pivot", "split")
    mine = routed.select("pivot", "split", "splits", "n", F.explode(grams).alias("g")).groupBy("pivot", "split", "splits", "g.a", "g.b", "g.c").agg(F.sum("n").alias("n"))
    mine = stage(mine.where((F.col("splits") > 1) | (F.col("n") >= least)).select("splits", "a", "b", "c", "n"), "phrase-counts")
    dealt = mine.where("splits > 1").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return mine.where("splits = 1").select("a", "b", "c", "n").unionByName(dealt)


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exactly."""
    big = lambda x, n=19: x.cast(f"decimal({n},0)")
    top = (big(a) * big(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (big(l) * big(r)).cast("decimal(38,0)"))


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, inside: int = INSIDE, top: int = TOP, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), text_of(docs, text).alias("text"))
    numbered = stage(rows.mapInArrow(lambda x: number(x, block), NUMBERED), "phrase-blocks")
    entries = numbered.where("word is not null").select("block", "idx", "lang", "word", "n")
    words = entries.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    frequent = stage(words.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "phrase-words")
    sizes = stage(entries.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-languages")
    back = entries.select("block", "idx", "lang", "word").join(frequent, ["lang", "word"]).select("block", "idx", "id", "f")
    parts = numbered.where("codes is not null").select("block", "codes")
    # Named anew: a cogroup of tables of one origin mixes up columns of the same identity.
    back = back.select(*[F.col(c).alias(c, metadata={}) for c in back.columns])
    cut = parts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda k, x, y: fragments(k, x, y, hot), FRAGMENTS)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    grams = stage(owned(cut, least, partitions), "phrase-grams")
    name = lambda c: frequent.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"))
    named = grams.join(frequent.select(F.col("id").alias("a"), "lang", F.col("word").alias("word_a"), F.col("f").alias("f_a")), "a").join(name("b"), "b")
    two = grams.where("c < 0").select("a", "b", F.col("n").alias("both"))
    three = grams.where("c >= 0")
    around = three.select("a", "b", "n").unionByName(three.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    pairs = named.where("c < 0").join(around, ["a", "b"], "left").where(~F.coalesce(100 * F.col("longer") >= inside * F.col("n"), F.lit(False)))
    pairs = pairs.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("n").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r"), score(F.col("n"), F.col("f_a"), F.col("f_b")).alias("score"))
    triples = named.where("c >= 0").join(name("c"), "c").join(two.withColumnRenamed("both", "f_ab"), ["a", "b"]).join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("both").alias("f_bc")), ["b", "c"])
    one, other = score(F.col("n"), F.col("f_a"), F.col("f_bc")), score(F.col("n"), F.col("f_ab"), F.col("f_c"))
    triples = triples.withColumn("s1", one).withColumn("s2", other).withColumn("early", F.col("s1") <= F.col("s2"))
    triples = triples.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), F.when(F.col("early"), F.col("f_a")).otherwise(F.col("f_ab")).alias("l"), F.when(F.col("early"), F.col("f_bc")).otherwise(F.col("f_c")).alias("r"), F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Each task keeps a language's first rows before they meet.
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases over the whole texts of all documents."""
    return phrases(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
halves AS (SELECT lang, k, phrase, g, f AS a, 1 AS cut, g[1] AS head, array_to_string(g[2:k], ' ') AS rest FROM c
  UNION ALL SELECT lang, k, phrase, g, f, 2, array_to_string(g[1:2], ' '), g[3] FROM c WHERE k = 3),
cuts AS (SELECT h.lang, h.k, h.phrase, h.a, h.cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * h.a * h.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.k = h.cut AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.k = h.k - h.cut AND r.phrase = h.rest),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, phrase, max(f) AS longer FROM (
  SELECT lang, array_to_string(g[1:2], ' ') AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(g[2:3], ' '), f FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inner_ i ON s.k = 2 AND i.lang = s.lang AND i.phrase = s.phrase WHERE NOT coalesce(100 * longer >= 50 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
