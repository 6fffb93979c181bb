"""Alignment of two tokenizers' tokens, each distinct segment tokenised once.

A text (with a blank in front) is split before runs of blanks that follow something else than white space. compile()
proves of the vocabularies that neither joins anything across such a place: the byte-level one because its
pre-tokenizer never matches a blank behind other characters and no entry holds one there, the other because no piece
does. So tokens of a text are those of its segments one behind the other, and groups of aligned tokens never reach
over a segment's end.

Blocks of whole documents are turned into numbers by a dictionary of the block's segments. The dictionaries meet in
Spark, dealt and sorted by segment: each distinct segment of the corpus is tokenised and aligned once, as its rows
come by, and its alignment joins the rows of all blocks that have it.
A block then counts in how many of its documents each pair of ids is linked; summed up over blocks, the counts are
joined back to the blocks' pairs, and documents are composed by sums over their segments' numbers. Nothing whole
reaches the driver or one task: blocks are bounded, a frequent segment has one row a block, and pairs are summed on
the map side first. The only broadcast has one row an id of A at most, a vocabulary's size.

Defined results: a null or empty text, and one whose joined bytes of either side differ from those of the blank and
the text (U+2581 in it), has no tokens: zeros and an empty digest, and it holds no pair; repeated rows are documents
of their own; null ids are allowed; other columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, stage, table, text_of

A_NAME, B_NAME, BLANK = "byte_bpe_50k.json", "piece_bpe_32k.model", "▁"
#: Characters of a block, rows of a batch of dictionary entries, and segments of documents looked at together.
BLOCK, ROWS, TOGETHER = 1 << 25, 1 << 15, 1 << 15
_ODD = re.compile(rf"[\s{BLANK}] |\A | \Z|{BLANK}")
_CUT = re.compile(rf"(?<=[^\s{BLANK}]) ++(?!\Z)")
PARTS = "block long, part int, ids array<{kind}>, sizes array<int>, codes binary, idx int, segment string"
ALIGNED = "block long, idx int, groups binary"


def segments(text: str) -> list[str]:
    """What a text and the blank in front of it consist of, each less its first blank. The usual text is split at its blanks."""
    if not text:
        return []
    if not _ODD.search(text):
        return text.split(" ")
    whole = " " + text
    edges = [0, *(m.start() for m in _CUT.finditer(whole)), len(whole)]
    return [whole[i + 1 : j] for i, j in zip(edges, edges[1:], strict=False) if j > i]


class Numbers(dict):
    """Numbers values in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def number(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text to PARTS: a row for each batch of a block's documents (sizes: segments of each; codes: their numbers), then its dictionary."""
    block, part, size, numbers, schema = TaskContext.get().partitionId() << 32, 0, 0, Numbers(), None

    def made(ids: list, sizes: list, codes: list, idx: list, segment: list) -> pa.RecordBatch:
        n = len(idx) or len(ids)
        columns = [[block] * n, [part] * n, ids, sizes, codes, idx, segment]
        return pa.RecordBatch.from_arrays([pa.array(c or [None] * n, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def dictionary() -> Iterator[pa.RecordBatch]:
        known = list(numbers)
        for at in range(0, len(known), ROWS):
            yield made([], [], [], list(range(at, min(at + ROWS, len(known)))), known[at : at + ROWS])

    for batch in batches:
        kinds = [pa.int64(), pa.int32(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.string()]
        schema = pa.schema(list(zip(["block", "part", "ids", "sizes", "codes", "idx", "segment"], kinds, strict=True)))
        flat: list[int] = []
        sizes = []
        for text in batch.column(1).to_pylist():
            own = segments(text)
            flat.extend(map(numbers.__getitem__, own))
            sizes.append(len(own))
            size += len(text)
        yield made([batch.column(0).to_pylist()], [sizes], [squeezed(np.array(flat, "i4"))], [], [])
        part += 1
        if size >= limit:
            yield from dictionary()
            block, part, size, numbers = block + 1, 0, 0, Numbers()
    if schema is not None:
        yield from dictionary()


@functools.cache
def compile(a_name: str, b_name: str):
    """Both tokenizers, and the bytes of each of their tokens; refused where a cut isn't proved."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task's cores are Spark's to deal out
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(a_name))
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    steps = json.loads(a.to_str())
    first = steps["pre_tokenizer"] or {}
    if steps["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
        raise ValueError(f"{a_name}: not a byte-level vocabulary that leaves texts as they are")
    # The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    a_bytes = [b""] * a.get_vocab_size()
    for token, i in a.get_vocab(with_added_tokens=False).items():
        a_bytes[i] = bytes(byte_of[c] for c in token)
        if re.search(r"[^\s] ", a_bytes[i].decode("utf-8", "replace")):
            raise ValueError(f"{a_name}: a token crosses a cut")
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_name))
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if re.search(f"[^{BLANK}]{BLANK}", piece):
            raise ValueError(f"{b_name}: a token crosses a cut")
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(BLANK, " ").encode())
    return a, a_bytes, [len(x) for x in a_bytes], b, b_bytes, [len(x) for x in b_bytes]


class Groups:
    """Groups of aligned tokens as a stream of ids: a group's a, BAR, its b, END."""

    def __init__(self, a_sizes: list[int], b_sizes: list[int]):
        self.a_sizes, self.b_sizes, self.wide = np.array(a_sizes), np.array(b_sizes), len(b_sizes)
        most = max(len(a_sizes), len(b_sizes))
        self.kind = np.dtype("u2" if most < 2**16 - 1 else "u4")
        self.end = 2 ** (8 * self.kind.itemsize) - 1
        self.bar = self.end - 1
        #: An id, at its end or before another one of its side, then BAR and END, as text.
        self.texts = [f"{i}{sign}" for i in range(most) for sign in ("", ",")] + ["|", ";"]

    def align(self, a: list[list[int]], b: list[list[int]]) -> list[bytes]:
        """Streams of segments whose tokens have the same bytes on both sides, many at once: the places where tokens end that both sides have cut the groups."""
        n_a = np.array([*map(len, a)], "i8")
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x), "i8") for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        first_a, first_b = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(cuts)))]) for x in (of_a, of_b))
        group = np.arange(len(cuts))
        out = np.empty(len(flat_a) + len(flat_b) + 2 * len(cuts), self.kind)
        out[np.arange(len(flat_a)) + first_b[of_a] + 2 * of_a] = flat_a
        out[first_a[1:] + first_b[:-1] + 2 * group] = self.bar
        out[np.arange(len(flat_b)) + first_a[of_b + 1] + 2 * of_b + 1] = flat_b
        out[first_a[1:] + first_b[1:] + 2 * group + 1] = self.end
        groups = np.concatenate([[0], of_a[np.cumsum(n_a) - 1] + 1])
        edges = (first_a[groups] + first_b[groups] + 2 * groups).tolist()
        return [out[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]

    def links(self, stream: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups of segments (edges: where their streams begin and end), where each one's links begin, and all links as a * wide + b, with repeats."""
        bar, end = stream == self.bar, stream == self.end
        before = np.cumsum(end) - end
        second = np.cumsum(bar) > before
        is_a, is_b = ~second & ~end, second & ~bar & ~end
        flat_a, flat_b = stream[is_a].astype("i8"), stream[is_b].astype("i8")
        n = int(end.sum())
        sizes_a, sizes_b = (np.bincount(before[x], minlength=n) for x in (is_a, is_b))
        each = sizes_a * sizes_b
        starts = np.concatenate([[0], np.cumsum(each)])
        group = np.repeat(np.arange(n), each)
        within = np.arange(starts[-1]) - starts[group]
        first_a, first_b = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes_a, sizes_b))
        pairs = flat_a[first_a[group] + within // sizes_b[group]] * self.wide + flat_b[first_b[group] + within % sizes_b[group]]
        groups = np.concatenate([[0], np.cumsum(end)])[edges]
        return np.diff(first_a[groups]), np.diff(first_b[groups]), np.diff(groups), starts[groups], pairs

    def as_text(self, stream: np.ndarray, edges: np.ndarray) -> list[str]:
        """Each segment's groups as 'a,a|b,b;a|b'."""
        most = len(self.texts) // 2 - 1
        ids = stream.astype("i8")
        token = ids < self.bar
        codes = np.where(token, 2 * ids + np.append(token[1:], False), np.where(ids == self.bar, 2 * most, 2 * most + 1))
        parts, at = [*map(self.texts.__getitem__, codes.tolist())], edges.tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(at, at[1:], strict=False)]


@functools.cache
def groups_of(a_name: str, b_name: str) -> Groups:
    both = compile(a_name, b_name)
    return Groups(both[2], both[5])


def align(batches: Iterator[pa.RecordBatch], a_name: str, b_name: str) -> Iterator[pa.RecordBatch]:
    """block, idx, segment, in order of segment, to ALIGNED: each distinct segment is tokenised and aligned once, for all blocks that have it. groups is null where bytes differ."""
    a, a_bytes, _, b, b_bytes, _ = compile(a_name, b_name)
    made = groups_of(a_name, b_name)
    last: tuple[str, bytes | None] | None = None

    def once(segments_: list[str]) -> list[bytes | None]:
        found_a = [x.ids for x in a.encode_batch([" " + s for s in segments_], add_special_tokens=False)]
        found_b = b.encode(segments_, num_threads=1)
        good = [b"".join([a_bytes[i] for i in x]) == b" " + s.encode() == b"".join([b_bytes[i] for i in y]) for s, x, y in zip(segments_, found_a, found_b, strict=True)]
        streams = iter(made.align(list(itertools.compress(found_a, good)), list(itertools.compress(found_b, good))) if any(good) else ())
        return [next(streams) if x else None for x in good]

    for batch in batches:
        coded = batch.column(2).dictionary_encode()
        known = coded.dictionary.to_pylist()
        streams = [last[1]] if last is not None and known and known[0] == last[0] else []
        for at in range(len(streams), len(known), ROWS):
            streams += once(known[at : at + ROWS])
        if known:
            last = known[-1], streams[-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(streams, pa.binary()).take(coded.indices)], ["block", "idx", "groups"])


def squeezed(values: np.ndarray) -> bytes:
    """Integers as a zstandard frame, their low bytes apart from their high ones."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view("u1").reshape(-1, values.itemsize).T).tobytes())


def restored(frame: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sums(values: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values of each document's codes."""
    total = np.concatenate([[0], np.cumsum(values[codes])])[ends]
    return np.diff(total)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size of all runs, one behind the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, "i8")


def documents_with(codes: np.ndarray, ends: np.ndarray, good: np.ndarray, first: np.ndarray, pairs: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many of the good documents each pair is; first: where each segment's pairs begin."""
    counts, n, doc = np.zeros(n_pairs, "i8"), len(first) - 1, 0
    while doc < len(ends) - 1:
        last = max(doc + 1, int(np.searchsorted(ends, ends[doc] + TOGETHER, side="right")) - 1)
        own = np.repeat(np.arange(last - doc), np.diff(ends[doc : last + 1]))
        keys = np.unique(own * n + codes[ends[doc] : ends[last]])
        keys = keys[good[doc:last][keys // n]] if len(keys) else keys
        of, segment = keys // n, keys % n
        sizes = np.diff(first)[segment]
        met = np.unique(np.repeat(of, sizes) * n_pairs + pairs[_spread(first[segment], sizes)])
        counts += np.bincount(met % n_pairs, minlength=n_pairs) if len(met) else 0
        doc = last
    return counts


FIGURES = "block long, part int, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, first binary, pairs binary, local int, pair long, n long"
_FIGURES = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((n, pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups", "n_links")), ("digests", pa.list_(pa.string())), ("first", pa.binary()), ("pairs", pa.binary()), ("local", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])


def _filled(columns: dict[str, list]) -> pa.Table:
    n = max(map(len, columns.values()))
    return pa.table([pa.array(columns.get(f.name, [None] * n), f.type) for f in _FIGURES], schema=_FIGURES)


def joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The values of a binary column one behind the other, nulls as nothing, without an object for each."""
    column = column.drop_null()
    parts = [np.frombuffer(c.buffers()[2], "u1")[int(o[0]) : int(o[-1])] for c in column.chunks if len(c) for o in [np.frombuffer(c.buffers()[1], "i4")[c.offset : c.offset + len(c) + 1]] if o[-1] > o[0]]
    return (np.concatenate(parts) if parts else np.zeros(0, "u1")).view(kind)


def numbered_pairs(linked: list[np.ndarray], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of arrays, sorted, and all values as their numbers; an array at a time, as one sort of all takes a multiple of their memory."""
    names = np.unique(np.concatenate([np.zeros(0, kind), *map(np.unique, linked)]))
    return names, np.concatenate([np.zeros(0, "i4"), *(np.searchsorted(names, x).astype("i4") for x in linked)])


def composed(texts: pa.StringArray, codes: np.ndarray, ends: np.ndarray, together: int = 64) -> Iterator[pa.StringScalar]:
    """Each document's groups as text, some documents at a time."""
    for at in range(0, len(ends) - 1, together):
        own = ends[at : at + together + 1]
        rows = pa.ListArray.from_arrays((own - own[0]).astype("i4"), texts.take(pa.array(codes[own[0] : own[-1]])).cast(pa.large_string()))
        yield from pc.binary_join(rows, pa.scalar(";", pa.large_string()))


def figures(key: tuple, parts: pa.Table, known: pa.Table, made: Groups) -> pa.Table:
    """One block: its documents' figures by part, its segments' pairs in numbers of its own, and in how many of its documents each pair is."""
    block = key[0].as_py()
    column = known.column("groups").take(pc.sort_indices(known.column("idx")))
    bad = np.asarray(column.is_null()).astype("i8")
    del known
    edges = np.concatenate([[0], np.cumsum(pc.coalesce(pc.binary_length(column), 0).to_numpy())]) // made.kind.itemsize
    stream = joined(column, made.kind)
    del column
    # A stretch of segments at a time, so that what is laid out for them stays small.
    few, texts, n_each, n_links, linked = "i4" if made.wide * len(made.a_sizes) < 2**31 else "i8", [], [], [], []
    for at in range(0, len(bad), ROWS):
        own = edges[at : at + ROWS + 1] - edges[at]
        part = stream[edges[at] : edges[at] + own[-1]]
        *n, starts, pairs = made.links(part, own)
        n_each.append(np.stack(n))
        n_links.append(np.diff(starts))
        linked.append(pairs.astype(few))
        texts.append(pa.array(made.as_text(part, own), pa.string()))
    del stream
    n_a, n_b, n_groups = np.concatenate(n_each, axis=1) if n_each else np.zeros((3, 0), "i8")
    first = np.concatenate([[0], np.cumsum(np.concatenate(n_links))]) if n_links else np.zeros(1, "i8")
    names, pairs = numbered_pairs(linked, few)
    del linked
    texts = pa.chunked_array(texts, pa.string()).combine_chunks()
    counts, out = np.zeros(len(names), "i8"), []
    for row in parts.select(["part", "sizes", "codes"]).to_pylist():
        codes, ends = restored(row["codes"], "i4"), np.concatenate([[0], np.cumsum(row["sizes"])]).astype("i8")
        good = _sums(bad, codes, ends) == 0
        counts += documents_with(codes, ends, good, first, pairs, len(names))
        digests = [hashlib.sha256(x.as_buffer()).hexdigest() if fine and n else "" for x, fine, n in zip(composed(texts, codes, ends), good.tolist(), row["sizes"], strict=True)]
        mine = {c: [(_sums(v, codes, ends) * good).tolist()] for c, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", np.diff(first)))}
        out.append(_filled(mine | {"block": [block], "part": [row["part"]], "digests": [digests]}))
    out.append(_filled({"block": [block], "first": [squeezed(np.diff(first))], "pairs": [squeezed(pairs)]}))
    if len(names):
        met = np.flatnonzero(counts)
        out.append(_filled({"block": [block] * len(met), "local": met, "pair": names[met].astype("i8"), "n": counts[met]}))
    del texts
    pa.default_memory_pool().release_unused()  # the next block, of this task or another, needs it again
    return pa.concat_tables(out)


def compose(key: tuple, parts: pa.Table, counted: pa.Table) -> pa.Table:
    """One block: codes, figures and segments' pairs of its parts with the corpus' counts of its pairs, to documents."""
    rows = parts.to_pylist()
    whole = next(r for r in rows if r["first"] is not None)
    first, pairs = np.concatenate([[0], np.cumsum(restored(whole["first"], "i8"))]), restored(whole["pairs"], "i4")
    local, counts, best = (counted.column(c).to_numpy() for c in ("local", "count", "best"))
    of_pair = np.zeros((2, int(pairs.max(initial=-1)) + 1), "i8")
    of_pair[0, local], of_pair[1, local] = counts, best
    count_of, best_of = (np.diff(np.concatenate([[0], np.cumsum(v[pairs])])[first]) for v in of_pair)
    codes_of = {r["part"]: r for r in rows if r["codes"] is not None}
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out: list[list] = [[] for _ in names]
    for row in rows:
        if row["digests"] is None:
            continue
        own = codes_of[row["part"]]
        codes, ends = restored(own["codes"], "i4"), np.concatenate([[0], np.cumsum(own["sizes"])]).astype("i8")
        good = np.array([bool(d) for d in row["digests"]])
        columns = [own["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], (_sums(best_of, codes, ends) * good).tolist(), (_sums(count_of, codes, ends) * good).tolist(), row["digests"]]
        for column, values in zip(out, columns, strict=True):
            column.extend(values)
    kinds = [parts.schema.field("ids").type.value_type] + [pa.int64()] * 6 + [pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def align_corpus(docs: DataFrame, key: str, text: str = "text", a: str = A_NAME, b: str = B_NAME, block: int = BLOCK) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    bound_batches(docs.sparkSession)
    wide = groups_of(a, b).wide
    rows = docs.select(docs[key].alias("doc_id"), text_of(docs, text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    numbered = stage(rows.mapInArrow(lambda x: number(x, block), PARTS.format(kind=kind)), "align-blocks")
    known = numbered.where("segment is not null").select("block", "idx", "segment")
    # Rows of one segment lie side by side, so that its tokens are found once and handed back to all of its blocks.
    back = known.repartition("segment").sortWithinPartitions("segment").mapInArrow(lambda x: align(x, a, b), ALIGNED)
    parts = numbered.where("codes is not null").select("block", "part", "ids", "sizes", "codes")
    # Named anew: a cogroup of tables of one origin mixes up columns of the same identity.
    fresh = lambda df: df.select(*[F.col(c).alias(c, metadata={}) for c in df.columns])
    found = stage(parts.groupBy("block").cogroup(fresh(back).groupBy("block")).applyInArrow(lambda k, x, y: figures(k, x, y, groups_of(a, b)), FIGURES), "align-figures")
    local = found.where("pair is not null").select("block", "local", "pair", "n")
    totals = local.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / wide).cast("int"))
    totals = stage(totals, "align-pairs")
    most = F.broadcast(totals.groupBy("a").agg(F.max("count").alias("most")))  # one row an id of A at most
    totals = totals.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    counted = local.join(totals, "pair").select("block", "local", "count", "best")
    mine = found.where("pair is null").select("block", "part", "n_a", "n_b", "n_groups", "n_links", "digests", "first", "pairs")
    whole = parts.unionByName(mine, allowMissingColumns=True)
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    done = whole.groupBy("block").cogroup(fresh(counted).groupBy("block")).applyInArrow(compose, out)
    return done.withColumnRenamed("doc_id", key)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over every whole text of documents."""
    return align_corpus(table(spark, sf_dir, "documents"), "doc_id")
