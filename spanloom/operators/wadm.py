"""Web annotations of items: motivation, target, selectors, scope and bodies. All of it is made in the note's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import uuid_urn
from spanloom.operators.items import _merged, in_row
from spanloom.plans.mapping import Plan


def selectors(i: Column) -> Column:
    """array(struct) of the quote, position and XPath selectors of an item."""
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    make = lambda kind, exact=none_s, prefix=none_s, suffix=none_s, start=none_i, end=none_i, value=none_s: F.struct(F.lit(kind).alias("type"), exact.alias("exact"), prefix.alias("prefix"), suffix.alias("suffix"), start.alias("start"), end.alias("end"), value.alias("value"))
    s = i["selector"]
    return F.array(make("TextQuoteSelector", exact=i["text"], prefix=s["prefix"], suffix=s["suffix"]), make("TextPositionSelector", start=s["start"], end=s["end"]), make("XPathSelector", value=s["xpath"]))


def bodies(i: Column) -> Column:
    """The item itself as an identifying resource, and a tagging body for each type."""
    none = F.lit(None).cast("string")
    make = lambda kind, source=none, value=none, purpose="tagging", form=none: F.struct(F.lit(kind).alias("type"), source.alias("source"), value.alias("value"), F.lit(purpose).alias("purpose"), form.alias("format"))
    return F.concat(F.array(make("SpecificResource", source=i["id"], purpose="identifying")), F.transform(i["types"], lambda t: make("TextualBody", value=t, form=F.lit("text/plain"))))


def annotation(i: Column) -> Column:
    """An item's annotation: order_index, id, motivation, source, scope, selectors, bodies."""
    motivation = F.when(i["doc_id"].isNotNull(), F.lit("identifying")).otherwise(F.lit("describing"))
    scope = F.array_compact(F.array(i["note_urn"], i["structure_id"], i["locator_id"]))
    return F.struct(i["order_index"].alias("order_index"), uuid_urn(F.col("note_id"), i["order_index"], F.lit("wadm")).alias("id"), motivation.alias("motivation"), F.coalesce(i["doc_id"], i["note_urn"], i["id"]).alias("source"), scope.alias("scope"), selectors(i).alias("selectors"), bodies(i).alias("bodies"))


def annotations(resolved: DataFrame, plan: Plan) -> DataFrame:
    """One row an item: note_id and the fields of annotation()."""
    return resolved.select("note_id", F.explode(in_row(resolved, plan, annotation)).alias("a")).select("note_id", "a.*")


def annotation_json(a: Column, plan: Plan) -> Column:
    """An annotation as a JSON object."""
    many = F.to_json(a["scope"])
    one = F.to_json(F.array(F.get(a["scope"], F.lit(0))))
    scoped = F.parse_json(F.when(F.size(a["scope"]) == 1, one.substr(F.lit(2), F.length(one) - 2)).otherwise(many))
    target = F.struct(a["source"].alias("source"), F.struct(F.lit("Choice").alias("type"), a["selectors"].alias("items")).alias("selector"), scoped.alias("scope"))
    fields = {"@type": F.lit("Annotation"), "@id": a["id"], "created": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "motivation": a["motivation"]}
    return F.to_json(_merged(fields, plan.wadm_metadata, {"target": target, "body": a["bodies"]}))


def wadm(resolved: DataFrame, plan: Plan) -> DataFrame:
    """note_id, json: the annotations of each note with items."""
    graph = F.array_join(F.transform(in_row(resolved, plan, annotation), lambda a: annotation_json(a, plan)), ",")
    return resolved.where(F.size("items") > 0).select("note_id", F.concat(F.lit('{"@context":' + plan.wadm_context + ',"@graph":['), graph, F.lit("]}")).alias("json"))
