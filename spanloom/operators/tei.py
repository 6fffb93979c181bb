"""TEI documents of notes: nested divisions for structures, milestones, quotes, and paragraphs with named spans.

A note's items are one array in its row, so this is a map over notes, without a shuffle; assembling a tree from parent
references is what Catalyst can't express.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.items import item_urn
from spanloom.plans.mapping import Plan

NS, XML = "http://www.tei-c.org/ns/1.0", "http://www.w3.org/XML/1998/namespace"
ID = f"{{{XML}}}id"


def _tei(tag: str) -> str:
    return f"{{{NS}}}{tag}"


def paragraph(doc: dict, spans: list[dict]) -> ET.Element:
    """A document's text with its annotations as names: from the last start to the first, and without those that reach into one already placed."""
    text, last = doc["text"], len(doc["text"])
    pieces: list[str | ET.Element] = []
    for a in sorted(spans, key=lambda x: x["start"], reverse=True):
        if a["end"] > last:
            continue
        name = ET.Element(_tei("name"), {ID: a["id"]} | ({"target": a["same_as"]} if a["same_as"] else {}))
        name.text = text[a["start"] : a["end"]]
        pieces[:0] = [name, text[a["end"] : last]]
        last = a["start"]
    p = ET.Element(_tei("p"), {ID: doc["id"]})
    p.text = text[:last]
    for piece in pieces:
        if isinstance(piece, str):
            p[-1].tail = (p[-1].tail or "") + piece
        else:
            p.append(piece)
    return p


def build(items: list[dict]) -> str:
    root = ET.Element(_tei("TEI"))
    ET.SubElement(root, _tei("teiHeader"))
    body = ET.SubElement(ET.SubElement(root, _tei("text")), _tei("body"))
    divs: dict[int, ET.Element] = {}
    of = lambda cls: (i for i in items if i["cls"] == cls)
    for s in of("Structure"):  # a parent precedes its children
        div = ET.SubElement(divs.get(s["structure"], body), _tei("div"), {ID: s["id"]})
        ET.SubElement(div, _tei("head"), {ID: s["id"]}).text = s["text"]
        divs[s["order_index"]] = div
    for i in of("Locator"):
        ET.SubElement(divs.get(i["structure"], body), _tei("milestone"), {"unit": "page", "n": i["text"], ID: i["id"]})
    for i in of("Quotation"):
        ET.SubElement(divs.get(i["structure"], body), _tei("quote"), {ID: i["id"]}).text = i["text"]
    named: dict[int, list[dict]] = {}
    for a in of("Annotation"):
        named.setdefault(a["doc"], []).append(a)
    for d in of("Document"):
        if d["text"]:
            divs.get(d["structure"], body).append(paragraph(d, named.get(d["order_index"], [])))
    ET.register_namespace("tei", NS)
    _indent(root)
    return "<?xml version='1.0' encoding='utf-8'?>\n" + ET.tostring(root, encoding="unicode") + "\n"


def _indent(element: ET.Element, depth: int = 0) -> None:
    """Line breaks where an element holds only elements; mixed content stays as it is."""
    if not len(element) or (element.text or "").strip() or any((c.tail or "").strip() for c in element):
        return
    element.text = "\n" + "  " * (depth + 1)
    for i, child in enumerate(element):
        _indent(child, depth + 1)
        child.tail = "\n" + "  " * (depth + (i + 1 < len(element)))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([build(i) for i in batch.column(1).to_pylist()], pa.string())], ["note_id", "xml"])


def tei(resolved: DataFrame, plan: Plan) -> DataFrame:
    """note_id, xml."""
    kind = dict(resolved.dtypes)["note_id"]
    keep = F.transform("items", lambda i: F.struct(i["cls"].alias("cls"), i["order_index"].alias("order_index"), item_urn(i["order_index"], plan).alias("id"), i["text"].alias("text"), i["start"].alias("start"), i["end"].alias("end"), i["structure"].alias("structure"), i["doc"].alias("doc"), i["same_as"].alias("same_as")))
    return resolved.select("note_id", keep.alias("items")).mapInArrow(_write, f"note_id {kind}, xml string")
