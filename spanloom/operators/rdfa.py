"""RDFa: typeof on matched elements, and namespaces on the document's root when that is the note's root."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.structural import programs
from spanloom.plans.mapping import Plan
from spanloom.sources.html_tree import _escape_attribute
from spanloom.sources.notes import ids_of


def namespaces(context: object) -> dict[str, str]:
    """The attributes that declare a context's namespaces; only URIs of http, and no references between terms."""
    out: dict[str, str] = {}
    for prefix, uri in (context.items() if isinstance(context, dict) else ()):
        uri = (uri.get("@id") or uri.get("id")) if isinstance(uri, dict) else uri
        if isinstance(uri, str) and uri.startswith("http"):
            name = {"@vocab": "vocab", "@base": "xml:base"}.get(prefix) or (None if prefix.startswith("@") else f"xmlns:{prefix}")
            if name:
                out[name] = uri
    return out


def _insert(batches: Iterator[pa.RecordBatch], names: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """note_id, ser, tags (offset, attribute text) to note_id, html."""
    own = "".join(f' {k}="{_escape_attribute(k, v)}"' for k, v in names.items())
    for batch in batches:
        out = []
        for ser, tags in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, last = [], 0
            for t in sorted(tags, key=lambda x: x["at"]):
                end = t["at"] + 1 + len(t["tag"])
                parts += [ser[last:end], own if t["root"] else "", f' typeof="{_escape_attribute("typeof", t["types"])}"' if t["types"] and not t["has"] else ""]
                last = end
            out.append("".join([*parts, ser[last:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["note_id", "html"])


def rdfa(trees: DataFrame, plan: Plan) -> DataFrame:
    """note_id, html. An element takes the types of the first rule, by XPath and then by place, that selects it; one that has a typeof keeps it."""
    first: dict[int, str] = {}
    for r in plan.rules:
        first.setdefault(r.xp, " ".join(r.types))
    if programs(plan):
        types = F.array(*[F.lit(first.get(xp)) for xp in range(len(plan.xpaths))]) if plan.xpaths else F.array().cast("array<string>")
        hits = [F.transform(F.filter("seeds", lambda s: s["value"].isNull()), lambda s: F.struct(s["owner"].alias("id"), s["xp"].alias("xp"), F.get(types, s["xp"]).alias("types")))]
    else:
        hits = [_hits(x, xp, first[xp]) for xp, x in enumerate(plan.xpaths)]
    hits_all = F.array_sort(F.concat(*hits)) if hits else F.array().cast("array<struct<id:int,xp:int,types:string>>")
    rows = trees.withColumn("hits", hits_all)

    def tag(n: F.Column) -> F.Column:
        mine = F.get(F.filter("hits", lambda h: h["id"] == n["id"]), F.lit(0))["types"]
        opening = F.substring(F.col("ser"), n["ser_start"] + 1, n["ser_end"] - n["ser_start"])
        has = F.regexp_like(opening, F.lit(r"""^<[^>]*\stypeof="[^"]+"""))
        return F.struct(n["ser_start"].alias("at"), n["tag"].alias("tag"), mine.alias("types"), has.alias("has"), ((n["id"] == 0) & (n["tag"] == "html")).alias("root"))

    wanted = F.filter("nodes", lambda n: (n["tag"] != "__comment__") & ((n["id"] == 0) | F.exists("hits", lambda h: h["id"] == n["id"])))
    rows = rows.select("note_id", "ser", F.transform(wanted, tag).alias("tags"))
    kind = dict(trees.dtypes)["note_id"]
    names = namespaces(json.loads(plan.context))
    return rows.mapInArrow(lambda b: _insert(b, names), f"note_id {kind}, html string")


def _hits(xpath: str, xp: int, types: str) -> F.Column:
    return F.transform(ids_of("xml", xpath), lambda i: F.struct(i.alias("id"), F.lit(xp).alias("xp"), F.lit(types).alias("types")))
