"""The engine: a mapping compiled once, applied to DataFrames of notes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import conll as conll_ops
from spanloom.operators import items as item_ops
from spanloom.operators import matching, rdfa, resolve, tei, wadm
from spanloom.plans.mapping import Plan, compile_mapping
from spanloom.operators.structural import programs
from spanloom.sources.html_tree import COMMENT
from spanloom.sources.notes import ELEMENT, Source, check_xpaths, html_source, node_source, trees


@dataclass(frozen=True)
class Conll:
    """Options of token labels."""

    max_span_tokens: int | None = None
    whitelist: list[str] = field(default_factory=list)
    blacklist: list[str] = field(default_factory=list)
    type_whitelist: list[str] = field(default_factory=list)


class Result:
    """Lazy outputs of a run; what isn't asked for isn't computed."""

    def __init__(self, source: Source, plan: Plan):
        self.source, self.plan = source, plan

    @cached_property
    def trees(self) -> DataFrame:
        return trees(self.source, self.plan)

    @cached_property
    def seeds(self) -> DataFrame:
        return matching.seeds(self.trees, self.plan)

    @cached_property
    def resolved(self) -> DataFrame:
        if programs(self.plan):
            return resolve.resolve_source(self.source, self.plan)
        return resolve.resolve(self.seeds, self.plan)

    @cached_property
    def items(self) -> DataFrame:
        return item_ops.items(self.resolved, self.plan)

    @cached_property
    def roots(self) -> DataFrame:
        return item_ops.note_items(self.trees, self.plan)

    @property
    def errors(self) -> DataFrame:
        """note_id, error of notes that can't be read: null or blank markup, nodes that are no tree. They give no rows elsewhere and don't stop the others."""
        return self.source.errors

    def matches(self, *columns: str) -> DataFrame:
        """note_id and some of xp, pos, node, tree_index, tag, text, prefix, suffix, html, same_as: one row a match."""
        if unknown := [c for c in columns if c not in matching.COLUMNS]:
            raise ValueError(f"matches have no {', '.join(unknown)}")
        if programs(self.plan):
            return matching.matched_source(self.source, self.plan, columns)
        return matching.matched_nodes(self.trees, self.plan).select("note_id", *columns)

    @property
    def dropped(self) -> DataFrame:
        return resolve.dropped_matches(self.resolved)

    @property
    def offsets(self) -> DataFrame:
        """note_id, order_index, note_start, note_end: where each item stands in its note's text."""
        return resolve.note_offsets(self.source, self.plan)

    @property
    def placed(self) -> DataFrame:
        """offsets, with each item's class and text, and what its note has there (found): one pass, so that no text is repeated or joined."""
        return resolve.note_offsets(self.source, self.plan, texts=True)

    @property
    def mapping(self) -> str:
        """The mapping as it was applied, as JSON."""
        return self.plan.echo

    def jsonld(self) -> DataFrame:
        return item_ops.jsonld(self.resolved, self.plan)

    def annotations(self) -> DataFrame:
        return wadm.annotations(self.resolved, self.plan)

    def wadm(self) -> DataFrame:
        return wadm.wadm(self.resolved, self.plan)

    def rdfa(self) -> DataFrame:
        return rdfa.rdfa(self.trees, self.plan)

    def tei(self) -> DataFrame:
        return tei.tei(self.resolved, self.plan)

    def tokens(self, options: Conll | None = None) -> DataFrame:
        """BIO labels: note_id, source (order index of the text's item, 0 for the note), tok_ix, token, label."""
        return conll_ops.labelled(self._sentences(options or Conll()))

    def conll(self, options: Conll | None = None) -> DataFrame:
        return conll_ops.conll(self._sentences(options or Conll()))

    def _sentences(self, o: Conll) -> DataFrame:
        return conll_ops.own_sentences(self.resolved, self.plan, o.max_span_tokens, o.whitelist, o.blacklist, o.type_whitelist)


def label_foreign(annotations: DataFrame, texts: DataFrame, options: Conll | None = None) -> DataFrame:
    """Labelled sentences of annotations and texts as operators.conll.foreign_annotations and foreign_texts give them."""
    o = options or Conll()
    return conll_ops.gathered(conll_ops.foreign_sentences(annotations, texts, o.max_span_tokens, o.whitelist, o.blacklist))


def foreign_errors(annotations: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """note_id, seq (null for a graph), error of what foreign_conll leaves out because it can't be read."""
    out = conll_ops.annotation_errors(annotations)
    return out if graphs is None else out.unionByName(conll_ops.graph_errors(graphs), allowMissingColumns=True)


def foreign_conll(annotations: DataFrame, graphs: DataFrame, options: Conll | None = None) -> DataFrame:
    """note_id, text: CoNLL of web annotations from elsewhere (note_id, seq, json), whose texts are in JSON-LD graphs (note_id, json). What can't be read is left out; foreign_errors has it."""
    o = options or Conll()
    rows = conll_ops.foreign_annotations(annotations, o.blacklist)
    return conll_ops.conll(label_foreign(rows, conll_ops.foreign_texts(graphs, rows, o.type_whitelist), o))


def foreign_notes(annotations: DataFrame, graphs: DataFrame, options: Conll | None = None) -> DataFrame:
    """note_id, errors, text: how many rows foreign_errors has of a note, and its text by foreign_conll (null: none), with each annotation and graph read once."""
    o = options or Conll()
    return conll_ops.foreign_notes(annotations, graphs, o.max_span_tokens, o.whitelist, o.blacklist, o.type_whitelist)


def conll_of(spark: SparkSession, annotations: dict | list, options: Conll | None = None, jsonld: dict | None = None) -> str:
    """CoNLL of {"text", "annotations"}, whatever these point to, or of a list of annotations with the JSON-LD that holds their texts."""
    import json

    def table(values: list) -> DataFrame:
        return spark.createDataFrame([(0, i, json.dumps(v)) for i, v in enumerate(values)], "note_id long, seq int, json string")

    if isinstance(annotations, list):
        if not jsonld:
            raise ValueError("a list of annotations needs the JSON-LD that holds their texts")
        out = foreign_conll(table(annotations), table([jsonld]), options)
    elif isinstance(annotations, dict) and {"text", "annotations"} <= annotations.keys():
        rows = conll_ops.foreign_annotations(table(annotations["annotations"])).withColumn("source", F.lit(""))
        texts = spark.createDataFrame([(0, "", annotations["text"], 0)], "note_id long, source string, text string, first_seq int")
        out = conll_ops.conll(label_foreign(rows, texts, options))
    else:
        raise ValueError("annotations must be a list, or a dictionary with 'text' and 'annotations'")
    return next((r["text"] for r in out.collect()), "")


class Engine:
    """Applies one mapping. Errors of the mapping, its patterns and its XPaths are raised here, before any note is read."""

    def __init__(self, mapping: dict, metadata: dict | None = None, remove_empty_tags: bool = True, structural: bool = True):
        """structural: whether XPaths may be evaluated by structural joins; else, and where these can't, the JVM's XPath does it."""
        self.plan = compile_mapping(mapping, metadata, remove_empty_tags, structural)

    def parse(self, notes: DataFrame) -> Result:
        """notes: note_id, html, and note_uri if there is one."""
        return self._result(notes, html_source)

    def parse_nodes(self, nodes: DataFrame) -> Result:
        """nodes: parsed documents, one row a node, as spanloom.sources.notes.elements() gives them: note_id, id, parent, tag, attrs, text, tail, and note_uri if there is one."""
        return self._result(nodes, node_source)

    def _result(self, notes: DataFrame, source: Callable[[DataFrame], Source]) -> Result:
        if not isinstance(notes, DataFrame):
            raise TypeError(f"'notes' must be a DataFrame, got {type(notes).__name__}")
        check_xpaths(notes.sparkSession, self.plan)
        return Result(source(notes), self.plan)


def note_table(spark: SparkSession, note: object, uri: str | None) -> tuple[DataFrame, bool]:
    """One note as a table, and whether it is one of nodes: a string is markup, an element of xml.etree is taken as it was parsed, without the text behind it."""
    if isinstance(note, ElementTree.Element):
        rows, todo = [], [(note, None)]
        while todo:
            element, parent = todo.pop()
            comment = element.tag is ElementTree.Comment
            if comment or isinstance(element.tag, str):
                rows.append((0, uri, len(rows), parent, COMMENT if comment else element.tag, dict(element.attrib), element.text, element.tail if parent is not None else None))
                todo += [(c, len(rows) - 1) for c in reversed(element)]
            elif element.tail and rows:  # instructions go, what stands behind them stays
                raise ValueError("'html' has a processing instruction with text behind it")
        return spark.createDataFrame(rows, f"note_id long, note_uri string, {ELEMENT}"), True
    if not isinstance(note, str):
        raise TypeError(f"'html' must be a string or an element, got {type(note).__name__}")
    if not note.strip():
        raise ValueError("'html' is empty")
    return spark.createDataFrame([(0, note, uri)], "note_id long, html string, note_uri string"), False


def parse_note(spark, html: str | ElementTree.Element, mapping: dict, note_uri: str | None = None, metadata: dict | None = None, rdfa: bool = False, wadm: bool = False, tei: bool = False, conll: bool | dict | Conll = False, remove_empty_tags: bool = True) -> dict:
    """One note, for interactive use: the outputs asked for as a dictionary. A corpus goes through Engine.parse."""
    import json

    table, parsed = note_table(spark, html, note_uri)
    engine = Engine(mapping, metadata, remove_empty_tags)
    run = engine.parse_nodes(table) if parsed else engine.parse(table)
    one = lambda df, column: next(iter(df.select(column).collect()), [None])[0]
    out = {"MAP": json.loads(run.mapping), "JSON-LD": json.loads(one(run.jsonld(), "json"))}
    if wadm or conll:
        out["WADM"] = json.loads(one(run.wadm(), "json") or json.dumps({"@context": json.loads(engine.plan.wadm_context), "@graph": []}))
    if rdfa:
        out["RDFa"] = one(run.rdfa(), "html")
    if tei:
        out["TEI"] = one(run.tei(), "xml")
    if conll:
        out["CoNLL"] = one(run.conll(conll if isinstance(conll, Conll) else Conll(**conll) if isinstance(conll, dict) else Conll()), "text") or ""
    return out
