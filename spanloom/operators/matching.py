"""XPath rules applied to trees: matches in document order, with texts, contexts and markup.

Seeds - which node, by which XPath - are one sorted array in the note's row: of the structural joins where these can
evaluate the mapping, else of the JVM's XPath; no shuffle either way. Texts are slices of the note's streams; each
node's is cut once, however many matches or children ask for it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.plain import canonical as plain_canonical
from spanloom.functions.plain import collapse as plain_collapse
from spanloom.functions.plain import context as plain_context
from spanloom.functions.text import canonical, cut
from spanloom.operators.structural import LATE, NOBODY, programs
from spanloom.plans.mapping import SAME_AS, Plan, anchored, branches, kind_of
from spanloom.sources.html_tree import Streams, parse
from spanloom.sources.notes import SEEDS_DDL, Built, Source, build, ids_of

FIELDS = [("order", pa.int32()), ("xp", pa.int32()), ("pos", pa.int32()), ("node", pa.int32()), ("tree_index", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("prefix", pa.string()), ("suffix", pa.string()), ("html", pa.string()), ("same_as", pa.string()), ("up", pa.list_(pa.int32()))]
#: What a table of matches can have, besides note_id.
COLUMNS = {n: "string" if t == pa.string() else "int" for n, t in FIELDS if n not in ("order", "up")}
ALL = frozenset(n for n, _ in FIELDS)
#: Matches of an Arrow batch that leaves a task.
BATCH_MATCHES = 4096
MATCHES = "array<struct<order:int,xp:int,pos:int,node:int,tree_index:int,tag:string,text:string,prefix:string,suffix:string,html:string,same_as:string,up:array<int>>>"


def text_of_node(raw: Column, node: Column) -> Column:
    return canonical(cut(raw, node["raw_start"], node["raw_end"]))


def _pairs(values: Column, owners: Column, xp: int) -> Column:
    both = F.arrays_zip(values.alias("v"), owners.alias("o"))
    return F.transform(both, lambda x, p: F.struct(F.lit(LATE).alias("order"), F.lit(xp).alias("xp"), p.alias("pos"), x["o"].alias("owner"), x["v"].alias("value")))


def _seeds(xpath: str, xp: int) -> list[Column]:
    """Seeds of one XPath; value is null for nodes."""
    out = []
    for branch in branches(xpath):
        if kind_of(branch) == "value":
            one = F.struct(F.lit(LATE).alias("order"), F.lit(xp).alias("xp"), F.lit(0).alias("pos"), F.lit(NOBODY).alias("owner"), F.xpath_string("xml", F.lit(branch)).alias("value"))
            out.append(F.array(one))
        elif kind_of(branch) != "node":
            path = anchored(branch, "//*[@__root]")
            owners = F.transform(F.xpath("xml", F.lit(f"({path})/../@__nid")), lambda x: x.cast("int"))
            out.append(_pairs(F.xpath("xml", F.lit(path)), owners, xp))
    own = [b for b in branches(xpath) if kind_of(b) == "node"]
    if own:
        ids = ids_of("xml", " | ".join(own))
        if "comment" not in xpath and "node()" not in xpath:
            ids = F.filter(ids, lambda x: F.get("nodes", x)["tag"] != "__comment__")
        out.append(F.transform(ids, lambda x, p: F.struct(x.alias("order"), F.lit(xp).alias("xp"), p.alias("pos"), x.alias("owner"), F.lit(None).cast("string").alias("value"))))
    return out


def seeds(trees: DataFrame, plan: Plan) -> DataFrame:
    """note_id, note_uri, raw, ser, nodes, seeds, linked: `linked` has a custom sameAs path's result for each seed, and is null for the usual path."""
    if programs(plan):
        return trees.select("note_id", "note_uri", "raw", "ser", "nodes", "seeds", "linked")
    found = [s for i, x in enumerate(plan.xpaths) for s in _seeds(x, i)]
    rows = trees.withColumn("seeds", F.array_sort(F.concat(*found)) if found else F.array().cast(SEEDS_DDL))
    linked = F.lit(None).cast("array<string>")
    if plan.same_as and plan.same_as != SAME_AS:
        path = F.lit(" | ".join(anchored(b, "/*") for b in branches(plan.same_as)))
        node = lambda s: F.get("nodes", s["owner"])
        linked = F.transform("seeds", lambda s: F.get(F.xpath(cut(F.col("xml"), node(s)["xml_start"], node(s)["xml_end"]), path), F.lit(0)))
    return rows.select("note_id", "note_uri", "raw", "ser", "nodes", "seeds", linked.alias("linked"))


class Cutter:
    """One note's nodes as columns, with their texts, each made once."""

    def __init__(self, raw: str, ser: str, nodes: dict[str, list], plan: Plan):
        self.raw, self.ser, self.nodes, self.plan = raw, ser, nodes, plan
        self._texts: dict[int, str] = {}
        self._links = [i for i, (t, h) in enumerate(zip(nodes["tag"], nodes["href"], strict=True)) if t == "a" and h is not None]

    def text(self, node: int) -> str:
        if node not in self._texts:
            self._texts[node] = plain_canonical(self.raw[self.nodes["raw_start"][node] : self.nodes["raw_end"][node]])
        return self._texts[node]

    def same_as(self, node: int) -> str | None:
        """The first link in a node's interval, found by bisection."""
        at = bisect_left(self._links, node)
        found = self.plan.same_as and at < len(self._links) and self._links[at] <= self.nodes["last"][node]
        return self.nodes["href"][self._links[at]] if found else None

    def match(self, seed: dict, linked: str | None, wanted: frozenset[str] = ALL) -> dict:
        """A match; of what has to be cut, only what is wanted is."""
        node, value = seed["owner"], seed["value"]
        if node == NOBODY:  # one value of the whole note, with no place in it
            return {n: None for n, _ in FIELDS} | {"order": seed["order"], "xp": seed["xp"], "pos": seed["pos"], "text": plain_collapse(value), "prefix": "", "suffix": "", "up": []}
        parent = self.nodes["parent"][node]
        context = "prefix" in wanted or "suffix" in wanted
        own = self.text(node) if context or value is None and "text" in wanted else None
        prefix, suffix = plain_context(own, self.text(parent)) if context and parent >= 0 else ("", "")
        up, at = [], node if "up" in wanted else -1
        while at >= 0:
            up.append(at)
            at = self.nodes["parent"][at]
        custom = self.plan.same_as != SAME_AS
        return {
            "order": seed["order"], "xp": seed["xp"], "pos": seed["pos"], "node": node, "tree_index": None if value is not None else node, "tag": self.nodes["tag"][node],
            "text": own if value is None else text_of_value(value), "prefix": prefix, "suffix": suffix, "html": plain_collapse(self.ser[self.nodes["ser_start"][node] : self.nodes["ser_end"][node]]) if "html" in wanted else None,
            "same_as": None if value is not None else linked if custom else self.same_as(node), "up": up,
        }


def text_of_value(value: str) -> str:
    """An attribute's or text's value as an item's text: markup in it is read as a fragment of its own."""
    if ("<" in value or "&" in value) and value.strip():
        value = Streams(*parse(value), with_xml=False).raw
    return plain_canonical(value)


def cut_seeded(batch: pa.RecordBatch, plan: Plan) -> Iterator[tuple[Cutter, list[dict]]]:
    """Each note of a batch of seeds(), and its matches."""
    nodes = batch.column(4)
    flat, ends = nodes.flatten(), nodes.offsets.to_pylist()
    columns = {n: flat.field(n).to_pylist() for n in ("parent", "last", "tag", "href", "raw_start", "raw_end", "ser_start", "ser_end")}
    base = ends[0]
    for i, (raw, ser, found, linked) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 5, 6)), strict=True)):
        own = {n: v[ends[i] - base : ends[i + 1] - base] for n, v in columns.items()}
        cutter = Cutter(raw, ser, own, plan)
        yield cutter, [cutter.match(s, linked[j] if linked else None) for j, s in enumerate(found)]


def cut_built(made: Built, plan: Plan, wanted: frozenset[str] = ALL) -> tuple[Cutter, list[dict]]:
    """The same of a note that was matched where it was built."""
    rows = made.streams.rows
    nodes = {"parent": [r.parent for r in rows], "last": [r.last for r in rows], "tag": [r.tag for r in rows], "href": [r.href for r in rows]}
    nodes |= {f"{s}_{e}": [getattr(r, s)[i] for r in rows] for s in ("raw", "ser") for i, e in enumerate(("start", "end"))}
    cutter, linked = Cutter(made.streams.raw, made.streams.ser, nodes, plan), made.linked
    found = [dict(zip(("order", "xp", "pos", "owner", "value"), x, strict=True)) for x in made.seeds or ()]
    return cutter, [cutter.match(s, linked[j] if linked else None, wanted) for j, s in enumerate(found)]


def matches(seeded: DataFrame, plan: Plan) -> DataFrame:
    """note_id, note_text, matches. up holds a match's node and its ancestors, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cutters, found = zip(*cut_seeded(batch, plan), strict=True) if len(batch) else ((), ())
            texts = [c.text(0) for c in cutters]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.struct(FIELDS)))], ["note_id", "note_text", "matches"])

    return seeded.mapInArrow(run, f"note_id {dict(seeded.dtypes)['note_id']}, note_text string, matches {MATCHES}")


def matched_nodes(trees: DataFrame, plan: Plan) -> DataFrame:
    """One row a match: note_id, xp, pos, node, tag, text, prefix, suffix, html, same_as."""
    return matches(seeds(trees, plan), plan).select("note_id", F.explode("matches").alias("m")).select("note_id", "m.*")


def matched_source(source: Source, plan: Plan, columns: tuple[str, ...]) -> DataFrame:
    """note_id and these COLUMNS of matched_nodes(), in one pass over notes whose XPaths are all structural: no node leaves its batch, and notes are done one by one."""
    parsed, wanted = source.parsed, frozenset(columns)
    fields = [(n, t) for n, t in FIELDS if n in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, at: list[int], rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[n] for r in rows], t) for n, t in fields)], ["note_id", *(n for n, _ in fields)])

        for batch in batches:
            at, rows = [], []
            for n, payload in enumerate(batch.column(2).to_pylist()):
                found = cut_built(build(*parsed(payload), plan), plan, wanted)[1]
                at += [n] * len(found)
                rows += found
                if len(rows) >= BATCH_MATCHES:
                    yield made(batch, at, rows)
                    at, rows = [], []
            yield made(batch, at, rows)

    return source.rows.mapInArrow(run, ", ".join([f"note_id {dict(source.rows.dtypes)['note_id']}", *(f"{n} {COLUMNS[n]}" for n, _ in fields)])).select("note_id", *columns)
