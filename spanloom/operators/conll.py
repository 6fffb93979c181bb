"""Token labels (BIO) from annotations, and CoNLL text.

Each of an annotation's labels is put on the tokens of each of its selectors: its position, and the first place of its
quoted text. Later ones overwrite earlier ones. A note's own annotations and texts are in its row, so they are labelled
there, in one Arrow pass. Annotations from elsewhere are grouped by the text that they point to and joined to it.

Annotations and graphs from elsewhere that can't be read don't stop the others: they are rows of errors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import plain
from spanloom.functions.text import token_spans
from spanloom.plans.mapping import Plan

SENTENCE = pa.struct([("source", pa.int32()), ("first_seq", pa.int32()), ("tokens", pa.list_(pa.string())), ("labels", pa.list_(pa.string()))])
SENTENCES_DDL = "array<struct<source:int,first_seq:int,tokens:array<string>,labels:array<string>>>"


def placed(text: str, labels: list[str], selectors: list[dict], first: dict[str, int]) -> list[tuple[str, int, int]]:
    """Spans of one annotation in a text. first: where quoted texts were found so far."""
    places = []
    for s in selectors:
        start, end, exact = s["start"], s["end"], s["exact"]
        if s["type"] != "TextPositionSelector":
            start = first.setdefault(exact, text.find(exact)) if s["type"] == "TextQuoteSelector" and exact else -1
            start, end = (start, start + len(exact)) if start >= 0 else (None, None)
        if start is not None and end is not None:
            places.append((start, end))
    return [(label, *place) for label in labels for place in places]


def _kept(labels: list[str], whitelist: list[str] | None, blacklist: list[str] | None) -> list[str]:
    return [x for x in labels if (not whitelist or x in whitelist) and (not blacklist or x not in blacklist)]


def own_sentences(resolved: DataFrame, plan: Plan, most: int | None = None, whitelist: list[str] | None = None, blacklist: list[str] | None = None, type_whitelist: list[str] | None = None) -> DataFrame:
    """note_id, sentences (source, first_seq, tokens, labels): the texts that a note's items stand in, by order index, 0 for the note, with their labels.

    type_whitelist: types of which a text's own item must have one; blacklist: also annotation types left out.
    """
    types = [list(r.types) for r in plan.rules]
    labels = [_kept(t, whitelist, blacklist) for t in types]
    allowed = [not type_whitelist or not set(t).isdisjoint(type_whitelist) for t in types]

    def one(note_text: str, items: list[dict]) -> list[dict]:
        by_source: dict[int, list[dict]] = {}
        for item in items:
            by_source.setdefault(item["doc"], []).append(item)
        out = []
        for source, own in by_source.items():
            text = items[source - 1]["text"] if source else note_text
            if not text or type_whitelist and not (source and allowed[items[source - 1]["rule"]]):
                continue
            spans, first = [], {}
            for i in own:
                both = [{"type": "TextQuoteSelector", "exact": i["text"], "start": None, "end": None}, {"type": "TextPositionSelector", "exact": None, "start": i["start"], "end": i["end"]}]
                spans += placed(text, labels[i["rule"]], both, first)
            tokens, marks = plain.bio(text, spans, most)
            out.append({"source": source, "first_seq": own[0]["order_index"], "tokens": tokens, "labels": marks})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(text, items) for text, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(SENTENCE))], ["note_id", "sentences"])

    rows = resolved.select("note_id", "note_text", F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ("order_index", "rule", "doc", "text", "start", "end")])).alias("items"))
    if blacklist and "Annotation" in blacklist:
        rows = rows.where(F.lit(False))
    return rows.mapInArrow(run, f"note_id {dict(resolved.dtypes)['note_id']}, sentences {SENTENCES_DDL}")


def labelled(sentences: DataFrame) -> DataFrame:
    """One row a token: note_id, source, tok_ix, token, label."""
    rows = sentences.select("note_id", F.explode("sentences").alias("s")).select("note_id", "s.source", F.posexplode(F.arrays_zip(F.col("s.tokens").alias("token"), F.col("s.labels").alias("label"))).alias("tok_ix", "t"))
    return rows.select("note_id", "source", "tok_ix", "t.token", "t.label")


def conll(sentences: DataFrame) -> DataFrame:
    """note_id, text: tokens and labels of each note's texts, in order of their first annotation, with an empty line behind each."""
    return sentences.select("note_id", _lines("sentences").alias("text")).where(F.col("text") != "")


def _lines(sentences: str) -> Column:
    ordered = F.array_sort(F.transform(F.filter(sentences, lambda s: F.size(s["tokens"]) > 0), lambda s: F.struct(s["first_seq"].alias("first_seq"), s["tokens"].alias("tokens"), s["labels"].alias("labels"))))
    lines = F.transform(ordered, lambda s: F.concat(F.array_join(F.zip_with(s["tokens"], s["labels"], lambda t, m: F.concat_ws("\t", t, m)), "\n"), F.lit("\n")))
    return F.array_join(lines, "\n")


#: Selectors that are kept as they are, and where others hold their parts.
PLAIN = ("TextQuoteSelector", "TextPositionSelector")
PARTS = {"Choice": "items", "List": "members"}


def flatten_selector(value: object) -> list[dict]:
    """Plain selectors of a foreign annotation and those that are refined, in the order in which they are met: choices and lists are entered, refinements too, what is anything else is left out."""
    met, ahead = [], [value]
    while ahead:
        one = ahead.pop()
        if isinstance(one, dict):
            plain, refined = one.get("type") in PLAIN, "refinedBy" in one
            met += [one] if plain or refined else []
            below = [] if plain else [one["refinedBy"]] if refined else one.get(PARTS.get(one.get("type")), [])
            ahead += reversed(below)
    return met


_SELECTOR = pa.struct([("type", pa.string()), ("exact", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_PARSED = pa.struct([("types", pa.list_(pa.string())), ("source", pa.string()), ("labels", pa.list_(pa.string())), ("selectors", pa.list_(_SELECTOR)), ("error", pa.string())])
_PARSED_DDL = "struct<types:array<string>,source:string,labels:array<string>,selectors:array<struct<type:string,exact:string,start:int,end:int>>,error:string>"


def _many(x: object) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _typed(value: object, kind: type, name: str) -> object:
    """A value of a kind, or null; others are an error."""
    if value is None or isinstance(value, kind) and not isinstance(value, bool):
        return value
    raise ValueError(f"{name} is no {'number' if kind is int else 'string'}: {json.dumps(value, ensure_ascii=False)[:60]}")


def read_annotation(text: str | None) -> dict:
    """An annotation's JSON as its types, source, labels and selectors; or its error."""
    none = {"types": None, "source": None, "labels": None, "selectors": None}
    try:
        if text is None:
            raise ValueError("annotation is null")
        a = json.loads(text)
        if not isinstance(a, dict):
            raise ValueError("annotation is no object")
        bodies = [b for b in _many(a.get("body")) if isinstance(b, str) or isinstance(b, dict) and b.get("purpose") == "tagging" and b.get("value")]
        labels = [_typed(b["value"], str, "a body's value") if isinstance(b, dict) else b.split("/")[-1] for b in bodies]
        targets = [t for t in _many(a.get("target")) if isinstance(t, dict)]
        flat = [s for t in targets for x in _many(t.get("selector")) for s in flatten_selector(x)]
        selectors = [{"type": _typed(s.get("type"), str, "type"), "exact": _typed(s.get("exact"), str, "exact")} | {k: _offset(s.get(k), k) for k in ("start", "end")} for s in flat]
        source = _typed(next((t["source"] for t in targets if t.get("source")), None), str, "source")
        return {"types": [_typed(t, str, "@type") for t in _many(a.get("@type"))], "source": source, "labels": labels, "selectors": selectors, "error": None}
    except RecursionError:
        return none | {"error": "annotation is nested too deeply"}
    except ValueError as e:  # of json as well
        return none | {"error": str(e)}


def _offset(value: object, name: str) -> int | None:
    if _typed(value, int, name) is not None and not -(2**31) <= value < 2**31:
        raise ValueError(f"{name} is beyond 32 bits: {value}")
    return value


def parse_annotations(json_text: Column) -> Column:
    """A foreign annotation's JSON to struct(types, source, labels, selectors, error)."""
    return F.arrow_udf(lambda texts: pa.array([read_annotation(x) for x in texts.to_pylist()], _PARSED), _PARSED_DDL)(json_text)


def tokens(texts: DataFrame) -> DataFrame:
    """One row a token: note_id, source, tok_ix, token, start, end."""
    return texts.select("note_id", "source", F.explode(token_spans(F.col("text"))).alias("t")).select("note_id", "source", F.col("t.ix").alias("tok_ix"), F.col("t.token").alias("token"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))


def foreign_annotations(rows: DataFrame, blacklist: list[str] | None = None) -> DataFrame:
    """note_id, source, seq, labels, selectors of annotations from elsewhere (note_id, seq, json) that can be read. blacklist: annotations of one of these types are left out."""
    out = rows.select("note_id", "seq", parse_annotations(F.col("json")).alias("a")).where("a.error is null").select("note_id", "a.source", "seq", "a.types", "a.labels", "a.selectors")
    if blacklist:
        out = out.where(~F.coalesce(F.arrays_overlap("types", F.lit(blacklist)), F.lit(False)))
    return out.drop("types")


def annotation_errors(rows: DataFrame) -> DataFrame:
    """note_id, seq, error of the annotations that can't be read: no JSON, no object, or a part of a wrong type."""
    return rows.select("note_id", "seq", parse_annotations(F.col("json"))["error"].alias("error")).where("error is not null")


def _graph(json_text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(json_text), "$['@graph']", "array<variant>")


def graph_errors(graphs: DataFrame) -> DataFrame:
    """note_id, error of the JSON-LD documents that can't be read or have no list of resources."""
    wrong = F.when(graphs["json"].isNull(), F.lit("graph is null")).when(F.try_parse_json(graphs["json"]).isNull(), F.lit("graph is no JSON")).when(_graph(graphs["json"]).isNull(), F.lit("graph has no list of resources in @graph"))
    return graphs.select(graphs["note_id"], wrong.alias("error")).where("error is not null")


def _resource() -> tuple[Column, Column, Column]:
    """source, text, types of a resource r."""
    get = lambda field, kind: F.try_variant_get("r", f"$['{field}']", kind)
    return get("@id", "string"), get("text", "string"), F.coalesce(get("@type", "array<string>"), F.array(get("@type", "string")))


def foreign_texts(graphs: DataFrame, annotations: DataFrame, type_whitelist: list[str] | None = None) -> DataFrame:
    """note_id, source, text, first_seq of texts that annotations point to: resources of JSON-LD graphs (note_id, json), by their id.

    Of resources with one id the last with a text counts. type_whitelist: resources without one of these types are left out.
    """
    source, text, types = _resource()
    found = graphs.select("note_id", F.posexplode(_graph(F.col("json"))).alias("ix", "r")).select("note_id", "ix", source.alias("source"), text.alias("text"), types.alias("types"))
    if type_whitelist:
        found = found.where(F.arrays_overlap("types", F.lit(type_whitelist)))
    texts = found.where("text is not null").groupBy("note_id", "source").agg(F.max_by("text", "ix").alias("text"))
    return texts.join(annotations.groupBy("note_id", "source").agg(F.min("seq").alias("first_seq")), ["note_id", "source"])


def foreign_sentences(annotations: DataFrame, texts: DataFrame, most: int | None = None, whitelist: list[str] | None = None, blacklist: list[str] | None = None) -> DataFrame:
    """note_id, source, first_seq, tokens, labels of each text. annotations and texts: as foreign_annotations() and foreign_texts() give them. A text's annotations meet in its row."""
    of_text = annotations.groupBy("note_id", "source").agg(F.array_sort(F.collect_list(F.struct("seq", "labels", "selectors"))).alias("own"))
    rows = texts.where(F.length("text") > 0).join(of_text, ["note_id", "source"], "left").select("note_id", "source", "first_seq", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, own in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                first: dict[str, int] = {}
                spans = [s for a in own or () for s in placed(text, _kept(a["labels"], whitelist, blacklist), a["selectors"], first)]
                made.append(plain.bio(text, spans, most))
            columns = [pa.array([m[i] for m in made], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["note_id", "source", "first_seq", "tokens", "labels"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"note_id {kinds['note_id']}, source {kinds['source']}, first_seq {kinds['first_seq']}, tokens array<string>, labels array<string>")


def gathered(sentences: DataFrame) -> DataFrame:
    """A note's sentences as one array, for labelled() and conll()."""
    return sentences.groupBy("note_id").agg(F.collect_list(F.struct("source", "first_seq", "tokens", "labels")).alias("sentences"))


def foreign_notes(rows: DataFrame, graphs: DataFrame, most: int | None = None, whitelist: list[str] | None = None, blacklist: list[str] | None = None, type_whitelist: list[str] | None = None) -> DataFrame:
    """note_id, errors, text: annotations (note_id, seq, json) and graphs (note_id, json) that can't be read, counted, and the CoNLL text of the others, null without any.

    Annotations and graphs are read once each: errors are counted where texts and their annotations are grouped.
    """
    counts = F.col("a.error").isNull()
    if blacklist:
        counts &= ~F.coalesce(F.arrays_overlap("a.types", F.lit(blacklist)), F.lit(False))
    read = rows.select("note_id", "seq", parse_annotations(F.col("json")).alias("a"))
    own = read.groupBy("note_id", F.col("a.source").alias("source")).agg(F.count("a.error").alias("bad"), F.min(F.when(counts, F.col("seq"))).alias("first_seq"), F.array_sort(F.collect_list(F.when(counts, F.struct("seq", "a.labels", "a.selectors")))).alias("own"))
    source, text, types = _resource()
    if type_whitelist:
        text = F.when(F.arrays_overlap(types, F.lit(type_whitelist)), text)
    # What can't be read is a null resource of its own; a list in a graph has none.
    listed = graphs.select("note_id", F.posexplode(F.coalesce(F.transform(_graph(F.col("json")), lambda r: F.struct(r.alias("r"), F.lit(0).alias("bad"))), F.array(F.struct(F.lit(None).cast("variant").alias("r"), F.lit(1).alias("bad"))))).alias("ix", "x"))
    found = listed.select("note_id", "ix", "x.r", "x.bad").select("note_id", "ix", source.alias("source"), text.alias("text"), "bad")
    texts = found.groupBy("note_id", "source").agg(F.max_by("text", F.when(F.col("text").isNotNull(), F.col("ix"))).alias("text"), F.sum("bad").alias("bad_graphs"))
    both = own.join(texts, ["note_id", "source"], "full").select("note_id", "first_seq", "text", "own", (F.coalesce("bad", F.lit(0)) + F.coalesce("bad_graphs", F.lit(0))).alias("errors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for first_seq, text, own in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if not text or first_seq is None:
                    made.append(None)
                    continue
                first: dict[str, int] = {}
                spans = [s for a in own for s in placed(text, _kept(a["labels"], whitelist, blacklist), a["selectors"], first)]
                made.append(plain.bio(text, spans, most))
            columns = [pa.array([m and m[i] for m in made], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(1), *columns], ["note_id", "errors", "first_seq", "tokens", "labels"])

    kinds = dict(both.dtypes)
    labelled = both.mapInArrow(run, f"note_id {kinds['note_id']}, errors long, first_seq {kinds['first_seq']}, tokens array<string>, labels array<string>")
    sentence = F.when(F.col("tokens").isNotNull(), F.struct("first_seq", "tokens", "labels"))
    return labelled.groupBy("note_id").agg(F.sum("errors").alias("errors"), F.collect_list(sentence).alias("sentences")).select("note_id", "errors", F.nullif(_lines("sentences"), F.lit("")).alias("text")).where("errors > 0 or text is not null")
