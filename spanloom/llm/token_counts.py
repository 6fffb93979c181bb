"""Token counts by a compiled transducer whose chunk maps compose in parallel.

The model joins neighbouring characters to pieces, best score first. Whether a sequence of tokens is a text's depends
on its neighbouring pairs only: merges within two tokens take place in the same order whatever stands around them, and
one across their border happens in the whole text if and only if it happens in the two alone. So each beginning of a
text has one last token, the one that fits behind the last token of what is left, and a transducer that reads
characters can follow it. Its state is the longest end of the text that begins a piece, the last tokens at the places
in that end, and the counts there. A transition has the next state and the tokens that it emits, less those that the
new last token swallows, so that the sum of a path is the count of the text read. States and transitions are compiled
when a text first needs them, from the vocabulary alone; the library counts nothing. Where no piece holds two
characters side by side, what came before is forgotten: the state is a cut's. Cuts lie before a run of blanks and on
both sides of a line feed, which compile() proves of the vocabulary; paths from cut to cut, words, are kept with their
sums. Both tables are emptied when they have grown to a fixed size.

A chunk's map is a table from the state before it to (tokens, state behind it). The state before a chunk is first
taken to be the one that the WARM characters before it lead to; where the chunk before can end in other states, these
are added to the table until none is missing (only texts without cuts for long, in which places never meet, need it).
Neighbouring maps then compose, FAN at a time, in a tree. A text's first chunk begins in the start state, and
most texts have no other.

Defined results: a null text counts as empty and has no tokens; repeated rows each get their count; other columns
aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, stage, table, text_of, unstage

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Characters of a chunk and of what is read before it, and maps composed at once; characters of kept words in all and of the longest, and transitions, that a worker keeps.
CHUNK, WARM, FAN, KEPT, LONGEST, TRANSITIONS = 1 << 16, 256, 32, 1 << 24, 64, 1 << 18
BLANK = "▁"
#: Words: what lies between cuts.
_WORDS = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
_CUT = re.compile(f"(?<=[^{BLANK}]){BLANK}|(?<=[^\n])\n|(?<=\n)(?=.)", re.S)


class State(dict):
    """window: the longest end of the text that begins a piece; last: the token that ends at each place of the window, its beginning included, or None where nothing can join it; counts: the tokens up to there, less those of the whole text. Maps a character to (next state, tokens)."""

    __slots__ = ("counts", "last", "machine", "window")

    def __init__(self, machine: Machine, window: str, last: tuple, counts: tuple):
        self.machine, self.window, self.last, self.counts = machine, window, last, counts

    def __missing__(self, char: str) -> tuple[State, int]:
        return self.machine.step(self, char)

    def name(self) -> str:
        return json.dumps([self.window, self.last, self.counts])


class Words(dict):
    """A word's tokens: the sum of its path from a cut."""

    def __init__(self, machine: Machine):
        self.machine, self.held = machine, 0

    def __missing__(self, word: str) -> int:
        n = self.machine.walk(self.machine.start, word)[0]
        if len(word) <= LONGEST:
            if self.held > KEPT:
                self.clear()
                self.held = 0
            self[word] = n
            self.held += len(word) + 16
        return n


class Machine:
    def __init__(self, scores: dict[str, float]):
        """scores: of the pieces that characters are joined to; other characters are as many tokens as they have bytes."""
        if any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in scores):
            raise ValueError("a piece crosses a cut")
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.begins = {p[:i] for p in scores for i in range(1, len(p))}
        self.side_by_side = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self._fits: dict[tuple[str | None, str], bool] = {}
        self._edges: dict[str, tuple[set[str], set[str], bool]] = {}
        self._ends: dict[str, tuple[list[int], int, bool]] = {}
        self.start = State(self, "", (None,), (0,))
        self.states = {("", (None,), (0,)): self.start}
        self.made, self.words = 0, Words(self)

    def joins(self, parts: list[str]) -> Iterator[int]:
        """Joins the pair with the best score, of equal ones the first, until none is left; yields each time at which place, ahead of the join."""
        cost = lambda i: -self.scores.get(parts[i] + parts[i + 1], -math.inf)
        costs = [cost(i) for i in range(len(parts) - 1)]
        while costs and (least := min(costs)) < math.inf:
            i = costs.index(least)
            yield i
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(i - 1)
            if i < len(costs):
                costs[i] = cost(i)

    def edges(self, token: str) -> tuple[set[str], set[str], bool]:
        """What stands first and last while a token's characters are joined, and whether they become that token."""
        if token not in self._edges:
            parts = list(token)
            first, last = {parts[0]}, {parts[-1]}
            for _ in self.joins(parts):
                first.add(parts[0])
                last.add(parts[-1])
            self._edges[token] = first | {parts[0]}, last | {parts[-1]}, len(parts) == 1
        return self._edges[token]

    def fits(self, before: str | None, token: str) -> bool:
        """Whether the two stay two: nothing is joined across their border."""
        key = (before, token)
        if key not in self._fits:
            if len(self._fits) > TRANSITIONS:
                self._fits.clear()
            self._fits[key] = self.edges(token)[2] and not (before and self._cross(before, token))
        return self._fits[key]

    def _cross(self, before: str, token: str) -> bool:
        if not any(a + b in self.scores for a in self.edges(before)[1] for b in self.edges(token)[0]):
            return False
        parts, lengths = [*before, *token], [1] * len(before)
        for i in self.joins(parts):  # lengths: of the parts before the border
            if i == len(lengths) - 1:
                return True
            if i < len(lengths):
                lengths[i : i + 2] = [2]
        return False

    def ends(self, text: str) -> tuple[list[int], int, bool]:
        """Lengths of the tokens that can end a window and a character, longest first; how much of them begins a piece; whether what is before that can be forgotten."""
        if text not in self._ends:
            if len(self._ends) > TRANSITIONS:
                self._ends.clear()
            sizes = [k for k in range(min(len(text), self.longest), 0, -1) if k == 1 or text[-k:] in self.scores]
            keep = next((k for k in range(min(len(text), self.longest - 1), 0, -1) if text[-k:] in self.begins), 0)
            self._ends[text] = sizes, keep, not keep or keep < len(text) and text[-keep - 1 : len(text) - keep + 1] not in self.side_by_side
        return self._ends[text]

    def step(self, state: State, char: str) -> tuple[State, int]:
        text = state.window + char
        sizes, keep, forgotten = self.ends(text)
        places = len(text)
        size = next(k for k in sizes if self.fits(state.last[places - k], text[places - k :]))
        token = text[places - size :]
        emitted = state.counts[places - size] + (1 if token in self.scores else len(token.encode()))
        last, counts = (*state.last, token)[-keep - 1 :], tuple([n - emitted for n in (*state.counts, emitted)[-keep - 1 :]])
        if forgotten:
            last = (None, *last[1:])
        if self.made > TRANSITIONS:
            self.start.clear()
            self.states, self.made = {("", (None,), (0,)): self.start}, 0
        state[char] = after = self.state(text[places - keep :], last, counts), emitted
        self.made += 1
        return after

    def state(self, window: str, last: tuple, counts: tuple) -> State:
        key = (window, last, counts)
        if key not in self.states:
            self.states[key] = State(self, window, last, counts)
        return self.states[key]

    def named(self, name: str) -> State:
        window, last, counts = json.loads(name)
        return self.state(window, tuple(last), tuple(counts))

    @staticmethod
    def walk(state: State, text: str) -> tuple[int, State]:
        """Tokens emitted and the state reached, character by character."""
        n = 0
        for char in text:
            state, emitted = state[char]
            n += emitted
        return n, state

    def run(self, state: State, text: str) -> tuple[int, State]:
        """As walk(), with whole words between the first cut and the last."""
        cut = _CUT.search(text, 1) if state is not self.start else None
        begin = cut.start() if cut else 0 if state is self.start else len(text)
        n, state = self.walk(state, text[:begin])
        words = _WORDS.findall(text, begin)
        if words:
            last, state = self.walk(self.start, words.pop())
            n += last + sum(map(self.words.__getitem__, words))
        return n, state


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + size]
        at += size


@functools.cache
def compile(model: str) -> Machine:
    """The transducer of a BPE model of sentencepiece with byte fallback that leaves texts as they are, but for blanks. Others are refused."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(model)
    with open(path, "rb") as held:
        fields = list(_fields(held.read()))
    # Of the model: 2 trainer, 3 normalizer. Of the trainer: 3 model type (2 BPE), 24 white space as suffix. Of the normalizer: 2 characters map, 3 dummy prefix, 4 extra blanks removed, 5 blanks escaped; true unless given.
    trainer, normalizer = (dict(x for f, m in fields if f == number for x in _fields(m)) for number in (2, 3))
    if trainer.get(3) != 2 or trainer.get(24) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError(f"{model}: not a BPE model that leaves texts as they are")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(library.get_piece_size())
    # Of a piece: 1 text, 2 score, 3 type (2 unknown, 3 control, 6 byte; others than 1, normal, aren't known here).
    if {dict(_fields(m)).get(3, 1) for f, m in fields if f == 1} - {1, 2, 3, 6} or not any(map(library.is_byte, ids)):
        raise ValueError(f"{model}: pieces of unknown types, or no bytes to fall back on")
    return Machine({library.id_to_piece(i): library.get_score(i) for i in ids if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i))})


def blanked(text: str) -> str:
    return text.replace(" ", BLANK)


def map_chunks(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """of, id, size, chunks, chunk, before (the state by name, or null), warm, text to of, id, size, chunks, chunk, begin, n, end, warm, text; texts of one chunk and their states aren't sent on."""
    machine = compile(model)
    start = machine.start.name()
    for batch in batches:
        out = []
        for chunks, chunk, before, warm, text in zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True):
            if before is not None:
                state = machine.named(before)
            else:
                state = machine.run(machine.start, blanked(warm))[1] if chunk else machine.start
            begin = state.name() if chunks > 1 else start
            # The library puts a blank in front of a text that isn't empty.
            n, end = machine.run(state, (BLANK if text and not chunk else "") + blanked(text))
            out.append((begin, n, *((end.name(), warm, text) if chunks > 1 else (None, None, None))))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        made = [pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], ["of", "id", "size", "chunks", "chunk", "begin", "n", "end", "warm", "text"])


def whole_maps(maps: DataFrame, run, most: int) -> DataFrame:
    """of, node, begin, n, end of the long texts' chunks, with every state that the chunk before can end in."""
    texts = maps.select("of", "id", "size", "chunks", "chunk", "warm", "text")
    known = maps.select("of", F.col("chunk").alias("node"), "begin", "n", "end")
    while True:
        ends = known.select("of", (F.col("node") + 1).alias("node"), F.col("end").alias("begin")).distinct()
        missing = ends.where(F.col("node") < most).join(known.select("of", "node", "begin"), ["of", "node", "begin"], "left_anti")
        asked = missing.withColumnsRenamed({"of": "_of", "begin": "before"})
        more = texts.join(asked, (F.col("of") == F.col("_of")) & (F.col("chunk") == F.col("node"))).select("of", "id", "size", "chunks", "chunk", "before", "warm", "text")
        found = stage(run(more).select("of", F.col("chunk").alias("node"), "begin", "n", "end"), "chunk-maps-more")
        if found.isEmpty():
            unstage(found)
            return known
        known = known.unionByName(found)


def fold(groups: pa.Array) -> pa.Array:
    """Arrays of neighbouring maps' rows (node, begin, n, end), in order, to the rows (begin, n, end) of their product."""
    out = []
    for rows in groups.to_pylist():
        tables: dict[int, dict[str, tuple[int, str]]] = {}
        for r in rows:
            tables.setdefault(r["node"], {})[r["begin"]] = r["n"], r["end"]
        first, *others = (tables[node] for node in sorted(tables))
        for after in others:
            first = {begin: (n + after[end][0], after[end][1]) for begin, (n, end) in first.items()}
        out.append([{"begin": begin, "n": n, "end": end} for begin, (n, end) in first.items()])
    return pa.array(out, pa.list_(pa.struct([("begin", pa.string()), ("n", pa.int64()), ("end", pa.string())])))


def compose(maps: DataFrame, width: int) -> DataFrame:
    """of, n of whole texts: FAN neighbouring maps at a time, a level of the tree behind the other."""
    product = F.arrow_udf(fold, "array<struct<begin:string,n:bigint,end:string>>")
    while width > 1:
        group = F.array_sort(F.collect_list(F.struct("node", "begin", "n", "end")))
        maps = maps.groupBy("of", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(group.alias("maps"))
        maps = maps.select("of", "node", product("maps").alias("map")).select("of", "node", F.explode("map").alias("m")).select("of", "node", "m.*")
        width = -(-width // FAN)
    return maps.where(F.col("begin") == json.dumps(["", [None], [0]])).select("of", "n")


def count_tokens(docs: DataFrame, key: str, text: str = "text", model: str = MODEL, chunk: int = CHUNK, warm: int = WARM) -> DataFrame:
    """key, n_bytes, n_tokens of every row."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text")).withColumn("of", F.monotonically_increasing_id())
    rows = rows.withColumn("size", F.octet_length("text").cast("long"))
    cut = F.when(F.length("text") <= chunk, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    rows = rows.select("of", "id", "size", cut.alias("cut"))
    none = F.lit(None).cast("string")
    pieces = F.transform("cut", lambda t, i: F.struct(i.alias("chunk"), F.when(i > 0, F.right(F.get("cut", i - 1), F.lit(warm))).alias("warm"), t.alias("text")))
    rows = rows.select("of", "id", "size", F.size("cut").alias("chunks"), F.explode(pieces).alias("p")).select("of", "id", "size", "chunks", "p.chunk", none.alias("before"), "p.warm", "p.text")
    run = lambda x: x.mapInArrow(lambda b: map_chunks(b, model), f"of long, id {kind}, size long, chunks int, chunk int, begin string, n long, end string, warm string, text string")
    maps = stage(run(rows), "chunk-maps")
    done = maps.where("chunks = 1").select("id", "size", "n")
    long = maps.where("chunks > 1")
    width = long.agg(F.max("chunks")).first()[0] or 0
    if width:
        sums = compose(whole_maps(long, run, width), width)
        done = done.unionByName(long.where("chunk = 0").select("of", "id", "size").join(sums, "of").select("id", "size", "n"))
    return done.select(F.col("id").alias(key), F.col("size").alias("n_bytes"), F.col("n").alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of documents."""
    return count_tokens(table(spark, sf_dir, "documents"), "doc_id").withColumn("over_limit", F.col("n_tokens") > LIMIT)
