"""Exact Jaccard self-join on word shingles by a grouped prefix join, and the components of its links.

A document's set holds the 64-bit hashes of its distinct shingles of WORDS words. Two sets link when their
intersection has at least PERCENT % of their union. In any order of all shingles, two linked sets share one among
each one's first n - ceil(PERCENT / 100 * n) + 1; these are its prefix.

1. A pass over all texts counts shingles in fixed-size sketches, of which each task sends its heaviest buckets; the
   order puts shingles of heavier buckets later. Passages that many documents share so leave the prefixes, whatever
   the sketch: any order is exact.
2. Documents with equal sets are one class; classes with equal prefixes and sizes are one group.
3. The lists of each group's FIRST first shingles give the first pairs: each group with a group of each of these lists,
   picked by a hash, so that a large family meets in many different ones; and each group's smallest class with its
   other classes. They are verified on whole sets, which are made again for the classes that need it.
4. All prefixes are inverted, an even share of the shingles at a time, so that only a share is on disk. A list of two
   groups that nothing links yet is a pair, which its two ends tell; of the others only lists that hold groups of
   several components are kept, and their rows move again. Prefixes themselves move for the groups that links reach.
5. In rounds, while more pairs remain than a few for each row of the lists and rounds find links, every group of an open list is paired with TRIES groups: of the picked groups of
   its lists that it may link with those with which it shares most lists. So pairs are in proportion to groups. Lists
   that are of one component by now are done.
6. What is left to look at are pairs in a list, or classes in a group, that aren't in the same component yet; only
   members outside of a list's most frequent component are paired with the rest. So a large group of near copies costs as many pairs as it has rows, and no link between different
   components is lost. Of the pairs that signatures leave, PICKS of each class are verified first, and those that are
   in one component then need no look: so a dense family moves sets in proportion to its classes.

Two groups that share an open list and also one of the AHEAD open lists ahead of it in both prefixes meet in that one
already, under looser bounds; so a pair of long documents isn't made once for every shingle that they share.

Pairs are filtered by size, by their places in the list, and by signatures: the parities of a set's hashes by residue,
of which two sets can't differ in more than in members. Group pairs with one class each are filtered so ahead of the
shuffle, others when they are expanded to classes; what is left is verified. Sets are exact up to collisions of 64-bit
hashes.

Texts are fetched by id and hash; a bitmap of fixed size first drops, on the map side, those that nothing asks for.

Defined results: a null text counts as empty; texts without words have an empty set and are linked with nothing (their
component is their own id); fewer words than WORDS make one shingle; repeated rows are one class and each get a row;
null ids are joined like others, and a component's id is null only if all of its ids are; other columns aren't read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import LOWER, UPPER, bound_batches, maybe_among, stage, table, text_of, unstage
from spanloom.llm.components import components

WORDS, PERCENT = 5, 80
#: Sketch: buckets, the heaviest that a task sends, and the most that are broadcast.
BUCKETS, SENT, HELD = 1 << 22, 4096, 1 << 16
#: Bytes that are hashed at once, and the length from which words are hashed one by one.
BLOCK, LONG = 1 << 19, 4096
#: Shingles whose lists give the first pairs; pairs of a group in a round, most rounds before all that remain are looked at, the share of links that makes another worth while, and the pairs of a row of the lists that need no round before.
FIRST, TRIES, ROUNDS, FEW, WORTH = 8, 8, 2, 0.25, 32
#: 64-bit words of a set's signature.
SIGNATURE = 8
#: Shares of the shingles whose lists are made one after the other; a power of two.
SHARES = 4
#: Pairs of a class that are verified in a round before the rest of the last pairs.
PICKS = 4
#: Open lists of a group ahead of a row's own that the row is given for the last pairs.
AHEAD = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE, PLACE, TURN = _stream(1, 256), _stream(2, LONG) | np.uint64(1), _stream(3, 64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _block_words(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some lower-cased bytes."""
    data = np.frombuffer(block, "u1")
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, "u8"), starts
    sizes = ends - starts
    letters = np.flatnonzero(~blank)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    hashes = np.add.reduceat(BYTE[data[letters]] * PLACE[place % LONG], first)
    for i in np.flatnonzero(sizes > LONG):
        hashes[i] = int.from_bytes(hashlib.blake2b(block[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return _mix(hashes + sizes.astype("u8") * np.uint64(0x9E3779B97F4A7C15)), starts


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of fewer words, of them all as one."""
    if len(words) < size:
        return _mix((words * TURN[: len(words)]).sum(dtype="u8", keepdims=True) + TURN[63 - len(words) : 64 - len(words)]) if len(words) else words
    n = len(words) - size + 1
    total = np.zeros(n, "u8")
    for k in range(size):
        total += words[k : k + n] * TURN[k]
    return _mix(total)


def shingle_sets(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8), A-Z lower-cased."""
    return map(np.unique, shingles(texts, size))


def shingles(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    """The shingle hashes of each text in their order, with repeats."""
    group, held = [], 0
    for text in [*texts, None]:
        if group and (text is None or held + len(text) > BLOCK):
            joined = b"\n".join(group).lower()
            words, starts = _block_words(joined)
            ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group]))
            begin = 0
            for end in ends:
                yield _shingles(words[begin:end], size)
                begin = end
            group, held = [], 0
        if text is None:
            return
        if len(text) > BLOCK:
            parts, at = [], 0
            while at < len(text):
                end = at + BLOCK
                while end < len(text) and not SPACE[text[end]]:
                    end += 1
                parts.append(_block_words(text[at:end].lower())[0])
                at = end
            yield _shingles(np.concatenate(parts), size)
        else:
            group.append(text)
            held += len(text) + 1


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    return shingle_sets(texts.cast(pa.binary()).to_pylist(), size)


def sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The task's heaviest buckets of shingles. Repeats within a text count, as nothing but speed follows from the counts."""
    counts, held, n = np.zeros(BUCKETS, "i4"), [], 0
    for batch in batches:
        for one in shingles(batch.column(0).cast(pa.binary()).to_pylist(), size):
            held.append(one)
            n += len(one)
            if n > BUCKETS:
                counts += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype("i8"), minlength=BUCKETS).astype("i4")
                held, n = [], 0
    if held:
        counts += np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).astype("i8"), minlength=BUCKETS).astype("i4")
    top = np.argpartition(counts, BUCKETS - SENT)[-SENT:]
    top = top[counts[top] > 1]
    yield pa.RecordBatch.from_arrays([pa.array(top.astype("i4")), pa.array(counts[top].astype("i8"))], ["bucket", "n"])


class Order:
    """The order of all shingles: by the weight of their bucket, then by hash. Sent as HELD buckets at most; workers lay them out."""

    def __init__(self, buckets: list[int], weights: list[int]):
        self.__setstate__((buckets, weights))

    def __getstate__(self) -> tuple[list[int], list[int]]:
        return self.heavy

    def __setstate__(self, heavy: tuple[list[int], list[int]]) -> None:
        self.heavy = heavy
        self.weight = np.zeros(BUCKETS, "i8")
        self.weight[heavy[0]] = heavy[1]

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        return self.weight[(hashes & np.uint64(BUCKETS - 1)).astype("i8")]

    def first(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The first n of sorted hashes."""
        weights = self.weights(hashes)
        light = hashes[weights == 0]
        return light[:n] if len(light) >= n else hashes[np.argsort(weights, kind="stable")[:n]]


def signature(hashes: np.ndarray, words: int = SIGNATURE) -> np.ndarray:
    """The parity of the hashes of each of 64 * words residues. Two signatures differ in no more bits than two sets in members."""
    odd = np.bincount((hashes >> np.uint64(32) & np.uint64(64 * words - 1)).astype("i8"), minlength=64 * words).astype("u1") & 1
    return np.packbits(odd).view("i8")


def wide_signature(hashes: np.ndarray) -> np.ndarray:
    """A signature of about a bit or two a member, a power of two of them: an array of a 64th or so of the set's bytes."""
    return signature(hashes, max(SIGNATURE, 1 << max(0, (len(hashes) - 1).bit_length() - 6)))


def folded(wide: np.ndarray, words: int) -> np.ndarray:
    """The signature of fewer words of the same set."""
    while len(wide) > words:
        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
    return wide


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def describe(batches: Iterator[pa.RecordBatch], order: Order, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """id, hash, row, text to id, hash, row, n, sig (of the set), bits (its signature), gkey (of size and prefix), prefix."""
    for batch in batches:
        ns, sigs, bits, keys, flat, ends = [], [], [], [], [], [0]
        for one in _sets(batch.column(3), size):
            head = order.first(one, prefix_size(len(one), percent))
            ns.append(len(one))
            sigs.append(struct.pack("<QQ", int(one.sum(dtype="u8")), int(_mix(one + np.uint64(1)).sum(dtype="u8"))))
            bits.append(signature(one))
            keys.append(hashlib.md5(struct.pack("<q", len(one)) + head.tobytes(), usedforsecurity=False).digest())
            flat.append(head)
            ends.append(ends[-1] + len(head))
        values = pa.array((np.concatenate(flat) if flat else np.zeros(0, "u8")).view("i8"))
        prefixes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ns, pa.int32()), pa.array(sigs, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.binary()), prefixes], ["id", "hash", "row", "n", "sig", "bits", "gkey", "prefix"])


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy().view("u8"), column.offsets.to_numpy() - column.offsets[0].as_py()
    return (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))


def linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b and their whole sets: the pairs that link."""
    for batch in batches:
        keep = []
        for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_enough(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, their sizes and wide signatures: the pairs that these leave possible."""
    for batch in batches:
        keep = []
        for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _lists(batch.column(4)), _lists(batch.column(5)), strict=True):
            words = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
            least = ((na + nb) * percent + 99 + percent) // (100 + percent)
            keep.append(differ <= na + nb - 2 * least)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _flat(arrays: list[np.ndarray]) -> pa.Array:
    values = pa.array((np.concatenate(arrays) if arrays else np.zeros(0, "u8")).view("i8"))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), values)


def make_wide(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """cid, text to cid, n, wide (signature)."""
    for batch in batches:
        ns, wide = [], []
        for one in _sets(batch.column(1), size):
            ns.append(len(one))
            wide.append(wide_signature(one))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), _flat(wide)], ["cid", "n", "wide"])


def make_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """cid, text to cid, n, wide (signature), set."""
    for batch in batches:
        sets = list(_sets(batch.column(1), size))
        ns = pa.array([len(x) for x in sets], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), ns, _flat([wide_signature(x) for x in sets]), _flat(sets)], ["cid", "n", "wide", "set"])


class Join:
    """The join of `docs` (doc_id, text); `members` has doc_id, hash, row, n_shingles and component_id of every row."""

    def __init__(self, docs: DataFrame, size: int = WORDS, percent: int = PERCENT):
        self.spark = spark = docs.sparkSession
        self.size, self.percent = size, percent
        bound_batches(spark)
        self.texts = docs.select(docs["doc_id"].alias("id"), text_of(docs).alias("text")).withColumn("hash", F.xxhash64("text"))
        kind = dict(docs.dtypes)["doc_id"]
        heavy = docs.select(text_of(docs).alias("text")).mapInArrow(lambda b: sketch(b, size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bucket").limit(HELD).collect()
        self.order = held = spark.sparkContext.broadcast(Order([r["bucket"] for r in heavy], [r["n"] for r in heavy]))
        texts = self.texts.withColumn("row", F.monotonically_increasing_id()).select("id", "hash", "row", "text")
        self.rows = stage(texts.mapInArrow(lambda b: describe(b, held.value, size, percent), f"id {kind}, hash long, row long, n int, sig binary, bits array<long>, gkey binary, prefix array<long>"), "jaccard-rows")
        full = self.rows.where("n > 0")
        self.groups = stage(full.groupBy("gkey").agg(F.min("row").alias("gid"), F.first("n").alias("n"), F.first(F.slice("prefix", 1, FIRST)).alias("firsts"), F.min_by("bits", "row").alias("bits")), "jaccard-groups")
        classes = full.groupBy("gkey", "sig").agg(F.min("row").alias("cid"), F.min("id").alias("least"), F.min_by(F.struct("id", "hash", "n", "bits"), "row").alias("of"))
        self.classes = stage(classes.join(self.groups.select("gkey", "gid"), "gkey").select("gkey", "sig", "gid", "cid", "least", "of.id", "of.hash", "of.n", "of.bits"), "jaccard-classes")
        self.wide: list[DataFrame] = []
        parts = self.components()
        named = self.classes.join(parts, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
        ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("cid").alias("first"))
        named = stage(named.join(ids, "component").select("gkey", "sig", "cid", "first", "component_id"), "jaccard-components")
        unstage(parts, self.classes)
        joined = self.rows.join(named, ["gkey", "sig"], "left")
        component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
        self.members = joined.select(F.col("id").alias("doc_id"), "hash", "row", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "first")

    def components(self) -> DataFrame:
        """node, component of the classes that links reach. Each staged table is deleted as soon as its successor is there."""
        inside = self.classes.where("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
        met = self.met()
        pairs = stage(self.first_pairs(met).unionByName(inside), "jaccard-pairs")
        links = self.verify(pairs)
        parts = components(links)
        unstage(met, pairs, links)
        placed, twos = self.shared_lists(parts)
        lists = self.most_frequent(placed)
        for salt in range(ROUNDS):
            if self.few(lists, twos):
                break
            pairs = stage(self.stars(lists, salt), "jaccard-pairs")
            tried = pairs.count()
            links = self.verify(pairs) if tried else pairs
            found = links.count() if tried else 0
            if found:
                parts, old = components(_edges(parts).unionByName(links)), parts
                unstage(old)
                lists = self.open(lists, parts)
            unstage(pairs, links)
            if found <= FEW * tried:
                break
        known = stage(self.parted(parts), "jaccard-class-parts")
        rest = self.rest(known, lists, twos)
        unstage(known, lists, twos, self.groups)
        near = self.screened(rest)
        unstage(rest)
        return self.settle(parts, near)

    def settle(self, parts: DataFrame, pairs: DataFrame) -> DataFrame:
        """parts with the links of staged pairs of classes. In rounds, PICKS pairs of each class are verified, and pairs of one component by then are dropped; then what is left. Both tables are deleted."""
        for salt in range(ROUNDS + 1):
            picked = stage(self.picks(pairs, salt), "jaccard-picked-pairs") if salt < ROUNDS else pairs
            all_of_them = salt == ROUNDS or 2 * picked.count() >= pairs.count()
            if all_of_them and picked is not pairs:
                unstage(picked)
                picked = pairs
            if picked.isEmpty():
                unstage(picked)
                break
            links = self.verify(picked, screened=True)
            parts, old = components(_edges(parts).unionByName(links)), parts
            unstage(old, links, picked)
            if all_of_them:
                break
            pairs, old = stage(self.apart(pairs, parts), "jaccard-near-pairs"), pairs
            unstage(old)
        return parts

    @staticmethod
    def picks(pairs: DataFrame, salt: int) -> DataFrame:
        """Of pairs (a, b) the first PICKS of each end by hashes of the round's own."""
        ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
        best = ends.groupBy("x").agg(*[F.min(F.struct(F.xxhash64("x", "y", F.lit(salt * PICKS + i)).alias("key"), "y")).alias(f"p{i}") for i in range(PICKS)])
        best = best.select("x", F.explode(F.array(*[f"p{i}.y" for i in range(PICKS)])).alias("y"))
        return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    @staticmethod
    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes of different components."""
        side = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"p{x}"))
        return pairs.join(side("b"), "b", "left").join(side("a"), "a", "left").where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b")

    def met(self) -> DataFrame:
        """Pairs (a, b) of groups, staged: each group with one of each list of its first shingles, picked by a hash of the list's own."""
        lists = self.groups.select("gid", F.explode("firsts").alias("hash"))
        picked = lists.groupBy("hash").agg(F.min(F.struct(F.xxhash64("hash", "gid").alias("key"), "gid")).alias("p"), F.count("*").alias("k")).where("k > 1").select(F.col("hash").alias("h"), F.col("p.gid").alias("pivot"))
        picked = stage(picked, "jaccard-picked")
        rows = maybe_among(lists, picked.select(F.col("h").alias("hash"))).where("maybe").join(picked, F.col("hash") == F.col("h")).where("gid <> pivot")
        met = stage(rows.select(F.least("gid", "pivot").alias("a"), F.greatest("gid", "pivot").alias("b")).distinct(), "jaccard-met")
        unstage(picked)
        return met

    def first_pairs(self, met: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of groups that may_link() leaves: signatures join pairs instead of lists."""
        side = lambda x: self.groups.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
        return met.join(side("b"), "b").join(side("a"), "a").where(self.may_link("na", "nb", "sa", "sb")).select("a", "b")

    def may_link(self, na: str, nb: str, a: str, b: str) -> Column:
        """Whether two sets of these sizes and signatures can link: they differ in so many members at least as their signatures in bits. A null signature says nothing."""
        low, high = F.least(na, nb), F.greatest(na, nb)
        shared = F.expr(f"(({na} + {nb}) * {self.percent} + {99 + self.percent}) div {100 + self.percent}")
        bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SIGNATURE)]
        differ = functools.reduce(Column.__add__, bits)
        return (low * 100 >= high * self.percent) & F.coalesce(differ <= F.col(na) + F.col(nb) - 2 * shared, F.lit(True))

    def heads(self, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """gid, n, prefix, low, high of the groups, and `from`, `to`: their components (low, high) in an order that has components of several classes below 0 and groups that are alone as they are.

        Groups that are alone, from the rows as they lie; the others, whose prefixes move, staged; and the staged table
        that tells them apart, to be deleted with these.
        """
        ends = parts.select(F.col("node").alias("cid")).unionByName(parts.select(F.col("component").alias("cid"))).distinct()
        reached = self.classes.join(ends, "cid", "left_semi").select("gid").unionByName(self.classes.where("cid <> gid").select("gid")).distinct()
        part = F.coalesce("component", "cid")
        spans = self.classes.select("gid", "cid").join(reached, "gid", "left_semi").join(parts, F.col("cid") == F.col("node"), "left").groupBy("gid").agg(F.min(part).alias("low"), F.max(part).alias("high"))
        full = self.rows.where("n > 0")
        copies = full.select(F.col("row").alias("gid")).join(self.groups.select("gid"), "gid", "left_anti")
        spans = stage(spans.unionByName(copies, allowMissingColumns=True), "jaccard-spans")
        rows = maybe_among(full.select(F.col("row").alias("gid"), "n", "prefix", F.xxhash64("row").alias("hash")), spans.select(F.xxhash64("gid").alias("hash")))
        alone = [F.col("gid").alias(x) for x in ("low", "high", "from", "to")]
        sure = rows.where("not maybe").select("gid", "n", "prefix", *alone)
        known = spans.withColumn("copy", F.col("low").isNull()).select(F.col("gid").alias("g"), "low", "high", "copy")
        other = rows.where("maybe").drop("hash", "maybe").join(known, F.col("gid") == F.col("g"), "left").where("not coalesce(copy, false)")
        other = other.select("gid", "n", "prefix", F.coalesce("low", "gid").alias("low"), F.coalesce("high", "gid").alias("high"), F.coalesce(-1 - F.col("high"), "gid").alias("from"), F.coalesce(-1 - F.col("low"), "gid").alias("to"))
        return sure, stage(other, "jaccard-reached"), spans

    def shared_lists(self, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Staged, of the lists that hold groups of several components: h, gid, n, pos, part; and as pairs (a, b) of groups, with the number of their lists, those that hold just two, both alone. part: the group's component, null if its classes are in several.

        Prefixes are read here for the last time, so the rows are staged again without them.
        """
        sure, other, spans = self.heads(parts)
        groups = sure.unionByName(other)
        index = groups.select("from", "to", F.explode("prefix").alias("h"))
        alone = (F.col("k") == 2) & (F.col("from") >= 0)
        shares = []
        for share in range(SHARES):
            held = index.where(F.col("h").bitwiseAND(F.lit(SHARES - 1)) == share)
            held = held.groupBy("h").agg(F.count("*").alias("k"), F.min("from").alias("from"), F.max("to").alias("to")).where("k > 1 and from < to")
            shares.append(stage(held.select(F.when(~alone, F.col("h")).alias("h"), F.when(alone, F.col("from")).alias("a"), F.when(alone, F.col("to")).alias("b")), "jaccard-shared-lists"))
        shared = functools.reduce(DataFrame.unionByName, shares)
        twos = stage(shared.where("h is null").groupBy("a", "b").agg(F.count("*").alias("lists")), "jaccard-twos")
        shared = shared.where("h is not null").select("h")
        own = F.when(F.col("low") == F.col("high"), F.col("low")).alias("part")
        placed = groups.select("gid", "n", own, F.posexplode("prefix").alias("pos", "hash"))
        wanted = maybe_among(placed, shared.select(F.col("h").alias("hash"))).where("maybe")
        lists = stage(wanted.join(shared, F.col("hash") == F.col("h")).select("h", "gid", "n", "pos", "part"), "jaccard-lists")
        self.rows, old = stage(self.rows.select("id", "hash", "row", "n", "sig", "gkey"), "jaccard-rows"), self.rows
        unstage(old, other, spans, *shares)
        return lists, twos

    def signed(self, lists: DataFrame) -> DataFrame:
        """lists with `bits`, their groups' signatures: rows carry these only where pairs are made. A group of several classes has none, and neither has one of so large sets that hardly any signatures tell two of them apart."""
        telling = F.col("n") * 2 * (100 - self.percent) < 36 * SIGNATURE * (100 + self.percent)
        signs = self.classes.select("gid", F.when(telling, F.col("bits")).alias("bits")).groupBy("gid").agg(F.when(F.count("*") == 1, F.first("bits")).alias("bits"))
        return lists.join(signs, "gid")

    def stars(self, lists: DataFrame, salt: int) -> DataFrame:
        """Pairs (a, b) of groups: each group with those TRIES of its lists' picked groups, of other components, with which it shares most lists.

        A list's picked group is the first by a hash with the round's salt.
        """
        lists = stage(self.signed(lists), "jaccard-signed")
        picked = lists.groupBy("h").agg(F.min(F.struct(F.xxhash64("gid", F.lit(salt)).alias("key"), "gid", "n", "part", "bits")).alias("p"))
        rows = lists.join(picked, "h").where((F.col("gid") != F.col("p.gid")) & F.coalesce(F.col("part") != F.col("p.part"), F.lit(True)) & self.may_link("n", "p.n", "bits", "p.bits"))
        shared = rows.groupBy("gid", F.col("p.gid").alias("pivot")).agg(F.count("*").alias("c"))
        best = shared.withColumn("i", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("c"), "pivot"))).where(F.col("i") <= TRIES)
        return best.select(F.col("pivot").alias("a"), F.col("gid").alias("b"))

    @staticmethod
    def few(lists: DataFrame, twos: DataFrame) -> bool:
        """Whether all pairs that rest() would look at are in proportion to the lists, so that rounds can't save any."""
        sizes = lists.groupBy("h").agg(F.count("*").alias("k"), F.count_if(_apart()).alias("out"))
        k, pairs = sizes.agg(F.sum("k"), F.sum(F.col("k") * F.col("out"))).first()
        two = twos.agg(F.sum("lists")).first()[0] or 0
        return (pairs or 0) + 4 * two <= WORTH * ((k or 0) + 2 * two)

    def made(self, pairs: DataFrame, make: Callable, kinds: str, name: str, known: DataFrame | None = None) -> DataFrame:
        """What make() gives for the texts of the classes of pairs (a, b), staged; not for those in `known`."""
        size = self.size
        asked = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        if known is not None:
            asked = asked.join(known.select("cid"), "cid", "left_anti")
        asked = stage(self.classes.join(asked, "cid", "left_semi").select("cid", F.col("id").alias("_id"), F.col("hash").alias("_hash")), "jaccard-asked")
        texts = maybe_among(self.texts, asked.select(F.col("_hash").alias("hash"))).where("maybe").select("id", "hash", "text")
        got = texts.join(asked, (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))).select("cid", "text").dropDuplicates(["cid"])
        out = stage(got.mapInArrow(lambda b: make(b, size), kinds), name)
        unstage(asked)
        return out

    def near(self, pairs: DataFrame, wide: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that sizes and wide signatures leave possible, staged."""
        percent = self.percent
        side = lambda x: wide.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "wa", "wb")
        return stage(both.mapInArrow(lambda b: near_enough(b, percent), "a long, b long"), "jaccard-near-pairs")

    def screened(self, pairs: DataFrame) -> DataFrame:
        """near() of staged pairs of which most won't link: only wide signatures are made of their texts, where verify() has none. These are deleted."""
        known = functools.reduce(DataFrame.unionByName, self.wide)
        more = self.made(pairs, make_wide, "cid long, n int, wide array<long>", "jaccard-wide", known)
        near = self.near(pairs, known.unionByName(more))
        unstage(more, *self.wide)
        return near

    def verify(self, pairs: DataFrame, screened: bool = False) -> DataFrame:
        """Of staged pairs of classes (a, b) those that link, staged. Sets move for pairs that near() leaves, unless they were screened before, and are deleted again."""
        percent = self.percent
        sets = self.made(pairs, make_sets, "cid long, n int, wide array<long>, set array<long>", "jaccard-sets")
        near = pairs if screened else self.near(pairs, sets)
        if not screened:
            known = [x.select("cid") for x in self.wide]
            wide = functools.reduce(lambda rows, x: rows.join(x, "cid", "left_anti"), known, sets.select("cid", "n", "wide"))
            self.wide.append(stage(wide, "jaccard-wide"))

        def side(x: str) -> DataFrame:
            held = maybe_among(sets.select("cid", "set", F.xxhash64("cid").alias("hash")), near.select(F.xxhash64(x).alias("hash")))
            return held.where("maybe").select(F.col("cid").alias(x), F.col("set").alias(f"s{x}"))

        both = near.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
        links = stage(both.mapInArrow(lambda b: linked(b, percent), "a long, b long"), "jaccard-links")
        unstage(sets, *([] if screened else [near]))
        return links

    def parted(self, parts: DataFrame) -> DataFrame:
        """gid, cid, n, bits, part (component) of all classes."""
        return self.classes.join(parts, F.col("cid") == F.col("node"), "left").select("gid", "cid", "n", "bits", F.coalesce("component", "cid").alias("part"))

    def open(self, lists: DataFrame, parts: DataFrame) -> DataFrame:
        """The lists that still have groups of several components, with `part` and the list's most frequent one. The old lists are deleted."""
        groups = self.parted(parts).groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high"))
        groups = groups.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).alias("part"))
        placed = stage(lists.select("h", "gid", "n", "pos").join(groups, "gid").select("h", "gid", "n", "pos", "part"), "jaccard-placed")
        unstage(lists)
        return self.most_frequent(placed)

    def most_frequent(self, placed: DataFrame) -> DataFrame:
        """Of lists with `part` those with groups of several components, with the list's most frequent one. The old lists are deleted.

        Behind a row's place a set must have as many shingles left as a link needs; rows too far back for a link even
        with the list's smallest set leave.
        """
        counts = placed.groupBy("h", "part").agg(F.count("*").alias("k"), F.min("n").alias("least"))
        open_ = counts.groupBy("h").agg(F.min("least").alias("least"), F.count("*").alias("parts"), F.count_if(F.col("part").isNull()).alias("mixed"), F.max_by("part", F.struct(F.col("part").isNotNull(), "k", "part")).alias("most"))
        open_ = open_.where("parts > 1 or mixed > 0").select("h", "most", "least")
        # A link is with a set of `percent` % of the row's own at least.
        shared = F.expr(f"((n + greatest(least, (n * {self.percent} + 99) div 100)) * {self.percent} + {99 + self.percent}) div {100 + self.percent}")
        lists = stage(placed.join(open_, "h").where(F.col("pos") + shared <= F.col("n")).drop("least"), "jaccard-open-lists")
        unstage(placed)
        return lists

    def rest(self, classes: DataFrame, lists: DataFrame, twos: DataFrame) -> DataFrame:
        """Pairs of classes (a, b) of different components that share a list or a group, as far as places in the lists and signatures leave a link possible; staged. twos: pairs of groups besides those of the lists."""
        apart = _apart()
        before = Window.partitionBy("gid").orderBy("pos").rowsBetween(-AHEAD, -1)
        lists = stage(self.signed(lists).withColumn("ahead", F.collect_list("h").over(before)), "jaccard-ahead")
        left = lists.where(apart).select("h", F.col("gid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("ia"), F.col("part").alias("part_a"), F.col("bits").alias("ba"), F.col("ahead").alias("ha"))
        right = lists.select("h", F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("ib"), F.col("part").alias("part_b"), F.col("bits").alias("bb"), F.col("ahead").alias("hb"), apart.alias("apart"))
        differ = F.coalesce(F.col("part_a") != F.col("part_b"), F.lit(True))
        once = (F.col("a") < F.col("b")) | ~F.col("apart")
        # Two sets that link share `least` shingles; behind the first of them each must have as many left.
        least = F.expr(f"((na + nb) * {self.percent} + {99 + self.percent}) div {100 + self.percent}")
        near = (F.col("ia") + least <= F.col("na")) & (F.col("ib") + least <= F.col("nb")) & self.may_link("na", "nb", "ba", "bb")
        # A list that both are in is open, as they are of several components; so the first of those that they share makes the pair.
        first = ~F.arrays_overlap("ha", "hb")
        pairs = left.join(right, "h").where((F.col("a") != F.col("b")) & differ & once & near & first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = stage(pairs.unionByName(twos.select("a", "b")).distinct(), "jaccard-open-pairs")
        unstage(lists)
        side = lambda x: classes.select(F.col("gid").alias(f"g{x}"), F.col("cid").alias(f"c{x}"), F.col("part").alias(f"p{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
        may = self.may_link("na", "nb", "sa", "sb")
        across = pairs.join(side("b"), F.col("b") == F.col("gb")).join(side("a"), F.col("a") == F.col("ga")).where((F.col("pa") != F.col("pb")) & may).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        # In a group of several components, the classes outside of the smallest class' component with all others.
        own = classes.where("cid = gid").select(F.col("gid").alias("g"), F.col("part").alias("main"))
        mixed = classes.join(own, F.col("gid") == F.col("g")).drop("g")
        out = mixed.where("part <> main").select("gid", F.col("cid").alias("a"), F.col("part").alias("part_a"), F.col("n").alias("na"), F.col("bits").alias("sa"))
        other = mixed.select("gid", F.col("cid").alias("b"), "part", "main", F.col("n").alias("nb"), F.col("bits").alias("sb"))
        inside = out.join(other, "gid").where("part_a <> part and (a < b or part = main)").where(may).select("a", "b")
        found = stage(across.unionByName(inside), "jaccard-rest")
        unstage(pairs)
        return found


def _apart() -> Column:
    """Whether a row of the open lists is outside of its list's most frequent component."""
    return F.coalesce(F.col("part") != F.col("most"), F.lit(True))


def _edges(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one document of each component: that of its first class. Equal rows (id and text) stay or go together."""
    members = Join(docs, size, percent).members
    out = F.coalesce((F.col("n_shingles") > 0) & (F.col("row") != F.col("first")), F.lit(False))
    gone = members.groupBy(F.col("doc_id").alias("_id"), "hash").agg(F.bool_and(out).alias("_out")).where("_out").select("_id", "hash")
    gone = stage(gone, "jaccard-gone")
    rows = docs.select(F.struct("*").alias("_row"), docs["doc_id"].alias("_doc"), F.xxhash64(text_of(docs)).alias("hash"))
    rows = maybe_among(rows, gone)
    sure = rows.where("not maybe").select("_row.*")
    other = gone.select("_id", F.col("hash").alias("_hash"))
    return sure.unionByName(rows.where("maybe").join(other, (F.col("hash") == F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id")), "left_anti").select("_row.*"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return Join(table(spark, sf_dir, "documents")).members.select("doc_id", "n_shingles", "component_id")


OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n x ON i.a = x.doc_id JOIN n y ON i.b = y.doc_id WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reached) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""
