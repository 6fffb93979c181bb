"""The sequential step: which matches are found in their container, and the items they give.

Whether a match is taken depends on containers that earlier matches opened, so this is a fold over a note's matches;
a note is one row, and notes need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.plain import collapse, kept
from spanloom.operators.matching import Cutter, cut_built, cut_seeded, seeds
from spanloom.operators.structural import programs
from spanloom.plans.mapping import ITEM_CLASSES, Plan, Rule
from spanloom.sources.notes import Source, build, trees

WINDOW = 30
ITEM = [
    ("order_index", pa.int32()), ("tree_index", pa.int32()), ("rule", pa.int32()), ("xp", pa.int32()), ("cls", pa.string()), ("node", pa.int32()), ("tag", pa.string()), ("text", pa.string()),
    ("start", pa.int32()), ("end", pa.int32()), ("doc", pa.int32()), ("structure", pa.int32()), ("locator", pa.int32()), ("quotation", pa.int32()), ("level", pa.int32()), ("same_as", pa.string()), ("html", pa.string()), ("prefix", pa.string()), ("suffix", pa.string()), ("node_start", pa.int32()),
]
ITEM_DDL = "array<struct<" + ",".join(f"{n}:{'string' if t == pa.string() else 'int'}" for n, t in ITEM) + ">>"
DROPPED_DDL = "array<struct<xp:int,node:int,text:string>>"


def locate(text: str, prefix: str, suffix: str, within: str, window: int = WINDOW) -> int:
    """Where text stands in `within` between that prefix and suffix, white space aside; -1 if nowhere."""
    before, after = collapse(prefix), collapse(suffix)
    at = within.find(text)
    while at >= 0:
        end = at + len(text)
        if (not before or collapse(within[max(0, at - window) : at]).endswith(before)) and (not after or collapse(within[end : end + window]).startswith(after)):
            return at
        at = within.find(text, max(end, at + 1)) if at < len(within) else -1
    return -1


class Places:
    """All places of a text in its container, by what stands around them, so that many matches with the same text are located without scanning for each."""

    KEY = 8

    def __init__(self, text: str, within: str, window: int = WINDOW):
        self.around: list[tuple[int, str, str]] = []
        self._by: dict[tuple[int, int], dict[tuple[str, str], list[tuple[int, str, str]]]] = {}
        at = within.find(text)
        while at >= 0:
            end = at + len(text)
            self.around.append((at, collapse(within[max(0, at - window) : at]), collapse(within[end : end + window])))
            at = within.find(text, max(end, at + 1)) if at < len(within) else -1

    def first(self, prefix: str, suffix: str) -> int:
        """As locate(): the first place behind that prefix and before that suffix, white space aside; -1 if there is none."""
        before, after = collapse(prefix), collapse(suffix)
        i, j = min(self.KEY, len(before)), min(self.KEY, len(after))
        if (i, j) not in self._by:
            groups = self._by[i, j] = {}
            for x in self.around:
                groups.setdefault((x[1][-i:] if i else "", x[2][:j]), []).append(x)
        own = self._by[i, j].get((before[-i:] if i else "", after[:j]), ())
        return next((at for at, b, a in own if b.endswith(before) and a.startswith(after)), -1)


def fragments(text: str, split: str | None, find: str | None) -> list[tuple[int, str]]:
    """(offset, fragment) of a match by a rule's split and find; the whole text if find has no hit in any part."""
    parts = [p for p in re.split(split, text) if p and p.strip()] if split else [text]
    out, at = [], 0
    for part in parts:
        offset = text.find(part, at)
        at = offset + len(part)
        out += [(offset + m.start(), m[0]) for m in re.finditer(find, part)] if find else [(offset, part)]
    return out or [(0, text)]


def heading_level(tag: str | None) -> int:
    return int(tag[1]) if tag and len(tag) > 1 and tag[0] == "h" and tag[1].isdigit() else 1


@dataclass
class _State:
    """What runs through a note. Items are named by their order index, the note by 0."""

    note_text: str
    items: list[dict] = field(default_factory=list)
    documents: dict[int, int] = field(default_factory=dict)
    quotations: dict[int, int] = field(default_factory=dict)
    levels: dict[int, int] = field(default_factory=dict)
    structure: int | None = None
    locator: int | None = None
    places: dict[tuple[int, str], Places] = field(default_factory=dict)

    def locate(self, match: dict, container: int) -> int:
        key = container, match["text"]
        if key not in self.places:
            self.places[key] = Places(match["text"], self.text(container))
        return self.places[key].first(match["prefix"], match["suffix"])

    def text(self, item: int) -> str:
        return self.items[item - 1]["text"] if item else self.note_text

    def container(self, up: list[int]) -> tuple[int, int | None]:
        """(container, enclosing quotation): the nearest document with text, else the nearest quotation with text, else the note."""
        document = next((self.documents[n] for n in up if n in self.documents), None)
        quotation = next((self.quotations[n] for n in up if n in self.quotations), None)
        for item in (document, quotation):
            if item is not None and self.text(item):
                return item, quotation
        return 0, quotation

    def take(self, match: dict, rules: list[Rule]) -> bool:
        """The items of one match; False if it isn't found in its container."""
        container, quotation = self.container(match["up"])
        text = match["text"]
        start = self.locate(match, container)
        if start < 0:
            return False
        for rule in rules:
            for offset, fragment in fragments(text, rule.split, rule.find):
                if rule.cls not in ITEM_CLASSES:
                    continue
                me = len(self.items) + 1
                within, at, end = self.text(container), start + offset, start + offset + len(fragment)
                item = {n: None for n, _ in ITEM} | {"node_start": start, "order_index": me, "tree_index": match["tree_index"], "rule": rule.seq, "xp": match["xp"], "cls": rule.cls, "node": match["node"], "tag": match["tag"], "text": fragment, "start": at, "end": end, "prefix": within[max(0, at - WINDOW) : max(0, at)], "suffix": within[end : end + WINDOW], "doc": container, "structure": self.structure, "locator": self.locator, "quotation": quotation, "html": match["html"]}
                if rule.cls in ("Locator", "Structure", "Annotation"):
                    item["same_as"] = match["same_as"]
                self.items.append(item)
                if rule.cls == "Document":
                    self.documents[match["node"]] = me
                    if fragment == text:
                        container, start = me, 0
                elif rule.cls == "Quotation":
                    self.quotations[match["node"]] = me
                    if container == 0 and fragment == text:
                        container, start = me, 0
                elif rule.cls == "Locator":
                    item["locator"], self.locator = None, me
                elif rule.cls == "Structure":
                    level = item["level"] = heading_level(match["tag"])
                    item["structure"] = next((self.levels[x] for x in range(level - 1, 0, -1) if x in self.levels), None)
                    self.levels[level] = self.structure = me
        return True


def _by_xpath(plan: Plan) -> dict[int, list[Rule]]:
    by_xpath: dict[int, list[Rule]] = {}
    for rule in plan.rules:
        by_xpath.setdefault(rule.xp, []).append(rule)
    for own in by_xpath.values():
        own.sort(key=lambda r: {"Document": 0, "Quotation": 1}.get(r.cls, 2))
    return by_xpath


def folded(notes: Iterable[tuple[Cutter, list[dict]]], plan: Plan) -> list[pa.Array]:
    """Notes with their matches to columns note_text, items, dropped."""
    by_xpath = _by_xpath(plan)
    texts, items, dropped = [], [], []
    for cutter, found in notes:
        note_text = cutter.text(0)
        state = _State(note_text)
        dropped.append([{"xp": m["xp"], "node": m["node"], "text": m["text"]} for m in found if not state.take(m, by_xpath[m["xp"]])])
        texts.append(note_text)
        items.append(state.items)
    return [pa.array(texts, pa.string()), pa.array(items, pa.list_(pa.struct(ITEM))), pa.array(dropped, pa.list_(pa.struct([("xp", pa.int32()), ("node", pa.int32()), ("text", pa.string())])))]


RESOLVED = ["note_id", "note_uri", "ser", "note_text", "items", "dropped"]
_DDL = f"note_uri string, ser string, note_text string, items {ITEM_DDL}, dropped {DROPPED_DDL}"


def resolve(seeded: DataFrame, plan: Plan) -> DataFrame:
    """note_id, note_uri, ser, note_text, items, dropped: one row a note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), *folded(cut_seeded(batch, plan), plan)], RESOLVED)

    return seeded.mapInArrow(run, f"note_id {dict(seeded.dtypes)['note_id']}, {_DDL}")


def resolve_source(source: Source, plan: Plan) -> DataFrame:
    """As resolve(), in one pass over notes whose XPaths are all structural. No node leaves its batch."""
    parsed = source.parsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sers: list[str] = []

            def notes(batch: pa.RecordBatch = batch, sers: list[str] = sers) -> Iterator[tuple[Cutter, list[dict]]]:
                for payload in batch.column(2).to_pylist():
                    made = build(*parsed(payload), plan)
                    sers.append(made.streams.ser)
                    yield cut_built(made, plan)

            columns = folded(notes(), plan)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sers, pa.string()), *columns], RESOLVED)

    return source.rows.mapInArrow(run, f"note_id {dict(source.rows.dtypes)['note_id']}, {_DDL}")


OFFSETS = [("order_index", pa.int32()), ("note_start", pa.int32()), ("note_end", pa.int32()), ("cls", pa.string()), ("text", pa.string()), ("found", pa.string())]


def note_offsets(source: Source, plan: Plan, texts: bool = False) -> DataFrame:
    """note_id, order_index, note_start, note_end: where each item stands in its note's text, whatever its container. texts: also cls, text, and found, which is what the note has there.

    A container's text and the note's are both cut from the note's stream, with white space dropped in each; the places
    that each has kept lead from one to the other. Null where an item's container has no place in the note: a value, or
    an attribute's or text's.
    """
    parsed, structural_ = source.parsed, programs(plan) is not None
    fields = OFFSETS if texts else OFFSETS[:3]

    def notes(batch: pa.RecordBatch) -> Iterator[tuple[Cutter, list[dict]]]:
        if structural_:
            for payload in batch.column(2).to_pylist():
                yield cut_built(build(*parsed(payload), plan), plan)
        else:
            yield from cut_seeded(batch, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_xpath = _by_xpath(plan)
        for batch in batches:
            ids, rows = [], []
            for n, (cutter, found) in enumerate(notes(batch)):
                state = _State(cutter.text(0))
                for m in found:
                    state.take(m, by_xpath[m["xp"]])
                for item, row in zip(state.items, _in_note(cutter, state.items), strict=True):
                    ids.append(n)
                    rows.append((*row, item["cls"], item["text"], None if row[1] is None else state.note_text[row[1] : row[2]]) if texts else row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], ["note_id", *(n for n, _ in fields)])

    rows = source.rows if structural_ else seeds(trees(source, plan), plan)
    return rows.mapInArrow(run, ", ".join([f"note_id {dict(rows.dtypes)['note_id']}", *(f"{n} {'string' if t == pa.string() else 'int'}" for n, t in fields)]))


def _in_note(cutter: Cutter, items: list[dict]) -> Iterator[tuple[int, int | None, int | None]]:
    places: dict[int, np.ndarray] = {}

    def of_node(node: int) -> np.ndarray:
        if node not in places:
            begin, end = cutter.nodes["raw_start"][node], cutter.nodes["raw_end"][node]
            places[node] = begin + kept(cutter.raw[begin:end])[1]
        return places[node]

    for item in items:
        start, end = item["start"], item["end"]
        if item["doc"]:
            container = items[item["doc"] - 1]
            if container["tree_index"] is None:
                yield item["order_index"], None, None
                continue
            # A fragment begins where it was cut from its node's text.
            own, shift = of_node(container["node"]), container["start"] - container["node_start"]
            first, last = own[start + shift] if end > start else None, own[end + shift - 1] if end > start else None
            note = of_node(0)
            start, end = (int(np.searchsorted(note, first)), int(np.searchsorted(note, last)) + 1) if end > start else (None, None)
        yield item["order_index"], start, end


def dropped_matches(resolved: DataFrame) -> DataFrame:
    """Matches that weren't found in their container: note_id, xp, node, text."""
    return resolved.select("note_id", F.explode("dropped").alias("d")).select("note_id", "d.*")
