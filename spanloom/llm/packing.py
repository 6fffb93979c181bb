"""Mixture-controlled packing: deficit round-robin over source queues.

Every document is tokenized once and its ids staged; in each source's queue the documents lie one behind the other.
Windows of about WINDOW tokens are filled by deficit round-robin: in each window a source earns its share of tokens,
takes the whole tokens that it has earned and carries the rest, its deficit, to the next window. What a source has
taken before window w is therefore floor(w * earnings), capped by its queue; where a queue runs out, the others'
shares are raised from there on (one phase of the schedule for each such source). So the place of any token follows
from its place in the queue by integer arithmetic: tasks share only one total a source and one offset for each task
and source, deficits carry across tasks and windows exactly, and no text or id is shuffled by source. Windows follow
each other without gaps and sequences are cut from them every LENGTH tokens, so only the last one is short.

The default target is each source's share of all tokens: every window has the corpus' proportions and all queues end
together. Explicit target weights fill every window to those, until queues run out.

Defined results: a null text counts as empty and is packed as the one closing id; a null source is a queue of its
own; repeated rows are packed once each; other columns aren't read, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, prefix_sums, stage, table, text_of

LENGTH, WINDOW, CLOSING = 2048, 64 * 2048, 1
#: The tokenizer's one special token.
SPECIAL = {"<|endoftext|>": 50256}
#: Runs of white space from this many characters on go to the tokenizers library: tiktoken's regular expression fails on very long ones.
RUN = 100_000
_LONG_RUN = re.compile(rf"\s{{{RUN}}}")


@functools.cache
def encoder(name: str):
    """The byte-level BPE of byte_bpe_50k.json, by its ranks; gives the ids that the tokenizers library gives."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.cache
def library(name: str):
    """The tokenizers library over the vocabulary that the rank file was made from."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{os.path.splitext(name)[0]}.json"))


def ids_of(text: str, name: str) -> list[int]:
    """The ids that the tokenizers library gives; by the faster encoder, unless that can't take the text."""
    if len(text) < RUN or not _LONG_RUN.search(text):
        try:
            return encoder(name).encode(text, allowed_special="all")
        except ValueError:  # its regular expression gave up
            pass
    return library(name).encode(text, add_special_tokens=False).ids


def tokenize(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """part, source, doc_id, at (tokens of the source before it in this task), n, ids (little-endian unsigned 32-bit, closed by CLOSING)."""
    at: dict[str | None, int] = {}
    part = TaskContext.get().partitionId()
    for batch in batches:
        doc_ids, sources, texts = (batch.column(i) for i in range(3))
        starts, sizes, ids = [], [], []
        for source, text in zip(sources.to_pylist(), texts.to_pylist(), strict=True):
            one = ids_of(text, name)
            one.append(CLOSING)
            starts.append(at.get(source, 0))
            at[source] = starts[-1] + len(one)
            sizes.append(len(one))
            ids.append(np.array(one, "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(batch), pa.int32()), sources, doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["part", "source", "doc_id", "at", "n", "ids"])


class Schedule:
    """Where a token of a queue goes. totals: tokens by source; weights: targets by source, or None for the totals."""

    def __init__(self, totals: dict[str | None, int], weights: dict[str | None, float] | None = None, window: int = WINDOW):
        self.names = sorted(totals, key=lambda s: (s is None, s or ""))
        self.rank = {s: i for i, s in enumerate(self.names)}
        self.totals = [totals[s] for s in self.names]
        wish = [Fraction(weights.get(s, 0) if weights else totals[s]) for s in self.names]
        taken, start, left = [Fraction(0)] * len(wish), Fraction(0), set(range(len(wish)))
        #: Phases: the window at which each begins, a fraction, and by source what it has earned there and earns in a window.
        self.phases: list[tuple[Fraction, list[Fraction], list[Fraction]]] = []
        while left:
            live = {i for i in left if wish[i] > 0} or left  # what has no weight comes last, in proportion
            whole = sum(wish[i] or self.totals[i] for i in live)
            rate = [window * (wish[i] or self.totals[i]) / whole if i in live else Fraction(0) for i in range(len(wish))]
            ends = {i: (self.totals[i] - taken[i]) / rate[i] for i in live}
            for_now = min(ends.values())
            self.phases.append((start, list(taken), rate))
            taken = [t + r * for_now for t, r in zip(taken, rate, strict=True)]
            start += for_now
            left -= {i for i in live if ends[i] == for_now}
        self.starts = [p[0] for p in self.phases]
        self._cache: dict[int, list[int]] = {}

    def served(self, w: int) -> list[int]:
        """Tokens that each source has given before window w."""
        if w not in self._cache:
            if len(self._cache) > 4096:
                self._cache.clear()
            start, taken, rate = self.phases[max(0, bisect_right(self.starts, w) - 1)]
            self._cache[w] = [min(n, int(t + r * (w - start))) for n, t, r in zip(self.totals, taken, rate, strict=True)]
        return self._cache[w]

    def window_of(self, i: int, g: int) -> int:
        """The window that holds token g of source i."""
        low = max(0, bisect_right([p[1][i] for p in self.phases], g) - 1)
        while low and not self.phases[low][2][i]:
            low -= 1
        start, taken, rate = self.phases[low]
        w = max(0, int(start + (g - taken[i]) / rate[i]) - 1) if rate[i] else int(start)
        while self.served(w + 1)[i] <= g:
            w += 1
        while w and self.served(w)[i] > g:
            w -= 1
        return w

    def runs(self, source: str | None, g: int, n: int) -> Iterator[tuple[int, int]]:
        """Cuts n tokens from place g of the queue into runs: (place in the packed stream, length)."""
        i, end = self.rank[source], g + n
        while g < end:
            w = self.window_of(i, g)
            here, after = self.served(w), self.served(w + 1)
            size = min(end, after[i]) - g
            yield sum(here) + sum(after[:i]) - sum(here[:i]) + g - here[i], size
            g += size


def lay(batches: Iterator[pa.RecordBatch], schedule: Schedule, length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    for batch in batches:
        rows = []
        for doc_id, source, g, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start = 0
            for place, size in schedule.runs(source, g, n):
                while size:
                    offset = place % length
                    piece = min(size, length - offset)
                    rows.append((doc_id, start, piece, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + piece)]), n, place // length, offset, source))
                    start, place, size = start + piece, place + piece, size - piece
        types = [batch.schema.field(0).type, *[pa.int64()] * 6, batch.schema.field(1).type]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The pieces of all documents (doc_id, source, text) in sequences. What the driver holds is a total for each source."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    cols = docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), text_of(docs).alias("text"))
    tokens = stage(cols.mapInArrow(lambda b: tokenize(b, tokenizer), f"part int, source string, doc_id {kind}, at long, n long, ids binary"), "packed-ids")
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    # Staged, its size is known before the join is planned: a row for each task and source, broadcast while small.
    before = stage(prefix_sums(parts, ["source"], "part", "tokens", "before").select(F.col("source").alias("_source"), F.col("part").alias("_part"), "before"), "packed-offsets")
    totals = {r[0]: r[1] for r in parts.groupBy("source").agg(F.sum("tokens")).collect()}
    schedule = Schedule(totals, weights, window)
    placed = tokens.join(before, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.select("doc_id", "source", (F.col("at") + F.col("before")).alias("g"), "n", "ids")
    return placed.mapInArrow(lambda b: lay(b, schedule, length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, every window in the corpus' proportions."""
    return pack(table(spark, sf_dir, "documents"))
