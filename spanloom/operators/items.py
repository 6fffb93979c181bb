"""Items of notes: ids, references, selectors, and JSON-LD. All of it is projection of the note's row."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import uuid_urn
from spanloom.operators.matching import text_of_node
from spanloom.plans.mapping import Plan


def _strings(values: list[str | None]) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values]) if values else F.array().cast("array<string>")


def note_urn(plan: Plan) -> Column:
    return F.coalesce("note_uri", F.lit(plan.note_uri).cast("string"), uuid_urn(F.col("note_id"), F.lit(0)))


def item_urn(index: Column, plan: Plan) -> Column:
    """The id of the item with that order index; 0 is the note."""
    return F.when(index == 0, note_urn(plan)).when(index.isNotNull(), uuid_urn(F.col("note_id"), index))


def item_fields(i: Column, plan: Plan) -> Column:
    """An entry of a note's items, with ids of what it refers to and its selector in its container."""
    types = F.array(*[_strings(list(r.types)) for r in plan.rules]) if plan.rules else F.array(F.array().cast("array<string>"))
    scalar = F.array(*[F.lit(r.scalar) for r in plan.rules]) if plan.rules else F.array(F.lit(False))
    regex, xpaths = _strings([r.regex for r in plan.rules]), _strings(list(plan.xpaths))
    selector = F.struct(i["start"].alias("start"), i["end"].alias("end"), i["prefix"].alias("prefix"), i["suffix"].alias("suffix"), F.get(xpaths, i["xp"]).alias("xpath"), F.get(regex, i["rule"]).alias("regex"))
    same = lambda *names: [i[n].alias(n) for n in names]
    urns = [item_urn(i[c], plan).alias(f"{c}_id") for c in ("structure", "locator", "quotation", "doc")]
    return F.struct(
        *same("order_index", "tree_index", "cls"), item_urn(i["order_index"], plan).alias("id"), F.get(types, i["rule"]).alias("types"), F.get(scalar, i["rule"]).alias("types_scalar"), *same("text", "level"),
        note_urn(plan).alias("note_urn"), *urns, *same("structure", "locator", "quotation", "doc", "same_as", "html"), selector.alias("selector"),
    )


def in_row(resolved: DataFrame, plan: Plan, make: Callable[[Column], Column]) -> Column:
    """What `make` gives for each item's fields, as an array in the note's row."""
    return F.transform(F.transform("items", lambda i: item_fields(i, plan)), make)


def items(resolved: DataFrame, plan: Plan) -> DataFrame:
    """One row an item. Fields are made behind the explode, so that those which nobody asks for aren't made."""
    rows = resolved.select("note_id", "note_uri", F.explode("items").alias("i"))
    return rows.select("note_id", item_fields(F.col("i"), plan).alias("i")).select("note_id", "i.*")


def note_items(trees: DataFrame, plan: Plan) -> DataFrame:
    """The root item of each note; it needs the tree and no match."""
    return trees.select("note_id", note_urn(plan).alias("id"), _strings(list(plan.types)).alias("types"), F.lit(plan.types_scalar).alias("types_scalar"), text_of_node(F.col("raw"), F.get("nodes", F.lit(0))).alias("text"), F.col("ser").alias("html"))


def variant_of(types: Column, scalar: Column) -> Column:
    """Types as they were written in the mapping: one string, or an array."""
    return F.parse_json(F.when(scalar, F.to_json(F.array(F.get(types, F.lit(0)))).substr(F.lit(2), F.length(F.to_json(F.array(F.get(types, F.lit(0))))) - 2)).otherwise(F.to_json(types)))


def literal(value: object) -> Column:
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def _merged(fields: dict[str, Column], metadata: str | None, last: dict[str, Column]) -> Column:
    """A struct of fields; metadata overwrites them, and `last` overwrites metadata."""
    own = fields | {k: literal(v) for k, v in (json.loads(metadata) if metadata else {}).items()} | last
    return F.struct(*[c.alias(k) for k, c in own.items()])


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def item_json(i: Column, plan: Plan) -> Column:
    """item_fields() as a JSON-LD object."""
    fields = {
        "@type": variant_of(i["types"], i["types_scalar"]), "@id": i["id"], "generatedAtTime": now(), "text": i["text"], "orderIndex": i["order_index"], "treeIndex": i["tree_index"],
        "note": i["note_urn"], "structure": i["structure_id"], "locator": i["locator_id"], "quotation": i["quotation_id"], "doc": i["doc_id"], "sameAs": i["same_as"], "html": i["html"],
    }
    return F.to_json(_merged(fields, plan.metadata, {"level": i["level"]}))


def note_json(plan: Plan, has_uri: Column) -> Column:
    fields = {"@type": variant_of(F.col("types"), F.col("types_scalar")), "@id": F.col("id"), "generatedAtTime": now(), "text": F.col("text"), "html": F.col("html")}
    over = json.loads(plan.metadata).get("@id") if plan.metadata else None
    last = {"@id": F.when(has_uri, F.col("id")).otherwise(F.lit(over))} if over else {}
    return F.to_json(_merged(fields, plan.metadata, last))


def jsonld(resolved: DataFrame, plan: Plan) -> DataFrame:
    """note_id, json: the graph of each note, made where its items are."""
    uri = F.coalesce("note_uri", F.lit(plan.note_uri).cast("string")).isNotNull()
    rows = resolved.withColumns({"id": note_urn(plan), "types": _strings(list(plan.types)), "types_scalar": F.lit(plan.types_scalar), "text": F.col("note_text"), "html": F.col("ser"), "_uri": uri})
    graph = F.array_join(F.concat(F.array(note_json(plan, F.col("_uri"))), in_row(rows, plan, lambda i: item_json(i, plan))), ",")
    return rows.select("note_id", F.concat(F.lit('{"@context":' + plan.context + ',"@graph":['), graph, F.lit("]}")).alias("json"))
