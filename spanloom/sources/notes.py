"""Notes (note_id, html, note_uri), or parsed documents as a table of nodes, to trees: one row per note with its streams and an array of nodes.

The tree builder runs in Arrow batches. A mapping whose XPaths are all within spanloom.operators.structural is evaluated
there, on the tree that has just been built: IGNORE paths before nodes leave and the others after. Otherwise XPaths run
in the JVM, on the tree's XML, as foldable expressions; IGNORE paths then take a first pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import structural
from spanloom.plans.mapping import Plan, anchored, branches, kind_of
from spanloom.sources.html_tree import Node, Row, Streams, clean, parse, wrap_matches

NODE = pa.struct(
    [("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("href", pa.string())]
    + [(f"{s}_{e}", pa.int32()) for s in ("raw", "ser", "xml") for e in ("start", "end")]
)
NODE_DDL = "struct<id:int,parent:int,last:int,depth:int,tag:string,href:string,raw_start:int,raw_end:int,ser_start:int,ser_end:int,xml_start:int,xml_end:int>"
SEEDS = pa.list_(pa.struct([("order", pa.int32()), ("xp", pa.int32()), ("pos", pa.int32()), ("owner", pa.int32()), ("value", pa.string())]))
SEEDS_DDL = "array<struct<order:int,xp:int,pos:int,owner:int,value:string>>"
TREE = ["raw", "ser", "xml", "nodes", "seeds", "linked"]
TREE_DDL = f"raw string, ser string, xml string, nodes array<{NODE_DDL}>, seeds {SEEDS_DDL}, linked array<string>"
#: What str.strip() leaves.
NOT_SPACE = r"(?U)[^\s\x1C-\x1F]"
#: Notes of an Arrow batch: a batch's markup, not its rows, is what fills memory.
BATCH_ROWS = 256


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as notes; only the columns read reach the scan."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("note_id"), "html", F.col("url").alias("note_uri"))


def bound(spark: SparkSession) -> None:
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@dataclass(frozen=True)
class Source:
    """Notes that can be read: rows with note_id, note_uri and payload, what makes (root, document) of a payload, and note_id, error of the others."""

    rows: DataFrame
    parsed: Callable[[Any], tuple[Node, Node]]
    errors: DataFrame


def _uri(notes: DataFrame) -> F.Column:
    return (notes["note_uri"].cast("string") if "note_uri" in notes.columns else F.lit(None).cast("string")).alias("note_uri")


def html_source(notes: DataFrame) -> Source:
    """note_id, html, and note_uri if there is one."""
    bound(notes.sparkSession)
    rows = notes.select(notes["note_id"], _uri(notes), notes["html"].alias("payload")).where(has_markup(F.col("payload")))
    return Source(rows, parse, blank(notes))


ELEMENT = "id int, parent int, tag string, attrs map<string,string>, text string, tail string"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
    for batch in batches:
        at, rows = [], []
        for n, markup in enumerate(batch.column(2).to_pylist()):
            number: dict[int, int] = {}
            for node in parse(markup)[0].walk():
                number[id(node)] = len(number)
                at.append(n)
                rows.append((len(number) - 1, number.get(id(node.parent)), node.tag, list(node.attrs.items()), node.text, node.tail))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["note_id", "note_uri", "id", "parent", "tag", "attrs", "text", "tail"])


def elements(notes: DataFrame) -> DataFrame:
    """Notes parsed to a table, one row a node: note_id, note_uri, id (from 0, in document order), parent, tag, attrs, text, tail. What node_source() reads."""
    source = html_source(notes)
    return source.rows.mapInArrow(_elements, f"note_id {dict(notes.dtypes)['note_id']}, note_uri string, {ELEMENT}")


def tree_of(nodes: list[dict]) -> tuple[Node, Node]:
    """A note's nodes, in order, as a tree; its first node is the root and the document."""
    made: dict[int, Node] = {}
    for n in nodes:
        node = made[n["id"]] = Node(n["tag"], dict(n["attrs"] or ()), n["text"] or "", n["tail"] or "")
        if n["parent"] is not None:
            made[n["parent"]].add(node)
    root = made[nodes[0]["id"]]
    root.tail = ""
    return root, root


def node_source(nodes: DataFrame) -> Source:
    """Parsed documents: note_id, id, parent (null for the root), tag, attrs, text, tail, and note_uri if there is one. A comment's tag is COMMENT.

    A note's nodes meet in one row, which is what a note is. Notes whose rows are no tree in document order are errors.
    """
    bound(nodes.sparkSession)
    field = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in ELEMENT.split(", "))])
    rows = nodes.select(nodes["note_id"], _uri(nodes), field.alias("n")).groupBy("note_id").agg(F.max("note_uri").alias("note_uri"), F.array_sort(F.collect_list("n"), lambda a, b: F.coalesce(a["id"], F.lit(-1)) - F.coalesce(b["id"], F.lit(-1))).alias("payload"))
    ids, parents = F.col("payload.id"), F.array_compact(F.col("payload.parent"))
    none = lambda n: n["id"].isNull() | n["tag"].isNull()
    error = (
        F.when(F.exists("payload", none), F.lit("a node has no id or tag"))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("two nodes have the same id"))
        .when((F.size(parents) != F.size(ids) - 1) | F.col("payload")[0]["parent"].isNotNull(), F.lit("not one node, the first, is the root"))
        .when((F.size(F.array_except(parents, ids)) > 0) | F.exists("payload", lambda n: F.coalesce(n["parent"] >= n["id"], F.lit(False))), F.lit("a node's parent is not before it"))
    )
    checked = rows.withColumn("error", error)
    return Source(checked.where("error is null").select("note_id", "note_uri", "payload"), tree_of, checked.where("error is not null").select("note_id", "error"))


def _first_pass(batches: Iterator[pa.RecordBatch], plan: Plan, parsed: Callable[[Any], tuple[Node, Node]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xml = []
        for payload in batch.column(2).to_pylist():
            root, document = parsed(payload)
            wrap_matches(root, plan.wraps)
            xml.append(Streams(root, document).xml)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(xml, pa.string())], [*batch.schema.names, "xml"])


@dataclass
class Built:
    """A note's cleaned tree: streams, and the seeds of its XPaths with the results of a custom sameAs path, where these were evaluated on it."""

    streams: Streams
    seeds: list[tuple[int, int, int, int, str | None]] | None = None
    linked: list[str | None] | None = None


def build(root: Node, document: Node, plan: Plan, drop: set[int] | None = None) -> Built:
    """A parsed note, cleaned, numbered and matched. drop: ids of nodes that IGNORE paths found in the JVM."""
    wrap_matches(root, plan.wraps)
    own = structural.programs(plan)
    gone = own.ignored(document, root) if own and own.ignore else [n for i, n in enumerate(root.walk()) if i in drop] if drop else []
    clean(root, gone, plan.ignore_patterns, plan.remove_empty)
    made = Built(Streams(root, document, with_xml=own is None))
    if own:
        tree = structural.Tree(document)
        base = tree.number[id(root)]
        made.seeds = own.seeds(tree, base)
        made.linked = [None if x[3] < 0 else own.linked(tree, base + x[3]) for x in made.seeds] if own.same_as else None
    return made


def _nodes(rows: list[list[Row]]) -> pa.Array:
    flat = [r for own in rows for r in own]
    columns = [[r.id for r in flat], [r.parent for r in flat], [r.last for r in flat], [r.depth for r in flat], [r.tag for r in flat], [r.href for r in flat]]
    columns += [[getattr(r, s)[e] for r in flat] for s in ("raw", "ser", "xml") for e in (0, 1)]
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE, strict=True)], fields=list(NODE))
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), structs)


def _trees(built: list[Built]) -> list[pa.Array]:
    """Columns raw, ser, xml, nodes, seeds, linked."""
    streams = [[getattr(b.streams, x) for b in built] for x in ("raw", "ser", "xml")]
    seeds = [b.seeds and [dict(zip(("order", "xp", "pos", "owner", "value"), x, strict=True)) for x in b.seeds] or b.seeds for b in built]
    return [*(pa.array(x, pa.string()) for x in streams), _nodes([b.streams.rows for b in built]), pa.array(seeds, SEEDS), pa.array([b.linked for b in built], pa.list_(pa.string()))]


def _build(batches: Iterator[pa.RecordBatch], plan: Plan, parsed: Callable[[Any], tuple[Node, Node]]) -> Iterator[pa.RecordBatch]:
    """note_id, note_uri, payload, drop (ids of nodes) to note_id, note_uri, raw, ser, xml, nodes, seeds, linked."""
    for batch in batches:
        made = [build(*parsed(m), plan, set(d or ())) for m, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_trees(made)], ["note_id", "note_uri", *TREE])


def ids_of(xml: str, xpath: str) -> F.Column:
    """The ids of the nodes that an XPath selects, in document order. Operands of a union are anchored one by one."""
    parts = [anchored(b, "//*[@__root]") for b in branches(xpath)]
    path = " | ".join(f"({p})/@__nid" for p in parts)
    return F.transform(F.xpath(F.col(xml), F.lit(path)), lambda x: x.cast("int"))


def check_xpaths(spark: SparkSession, plan: Plan) -> None:
    """Raises ValueError for an XPath that can't be evaluated, before any note is read."""
    if structural.programs(plan):
        return
    probe = spark.range(1).select(F.lit('<html __nid="0" __root="1"/>').alias("xml"))
    values = [b for x in plan.xpaths for b in branches(x) if kind_of(b) == "value"]
    paths = [x for x in (*plan.xpaths, *plan.ignore_xpaths) if x not in values]

    def error(some: list[str]) -> Exception | None:
        try:
            probe.select(*[F.xpath_string("xml", F.lit(x)) if x in values else ids_of("xml", x) for x in some]).collect()
        except Exception as e:
            return e
        return None

    if paths + values and error(paths + values):
        for path in paths + values:
            if e := error([path]):
                raise ValueError(f"Invalid XPath '{path}': {str(e).splitlines()[0]}") from e


def has_markup(html: F.Column) -> F.Column:
    """Neither null nor white space only; the first other character ends the search."""
    return F.coalesce(html.rlike(NOT_SPACE), F.lit(False))


def blank(notes: DataFrame) -> DataFrame:
    """note_id, error of the notes that have no markup and so no tree."""
    html = notes["html"]
    return notes.where(~has_markup(html)).select(notes["note_id"], F.when(html.isNull(), F.lit("'html' is null")).otherwise("'html' is empty").alias("error"))


def trees(source: Source, plan: Plan) -> DataFrame:
    """note_id, note_uri, raw, ser, xml, nodes, seeds, linked of every note that can be read. xml, or else seeds, is null: see build()."""
    rows, parsed = source.rows, source.parsed
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if plan.ignore_xpaths and not structural.programs(plan):
        rows = rows.mapInArrow(lambda b: _first_pass(b, plan, parsed), f"note_id {kinds['note_id']}, note_uri string, payload {kinds['payload']}, xml string")
        drop = F.array_distinct(F.flatten(F.array(*[ids_of("xml", x) for x in plan.ignore_xpaths])))
        rows = rows.select("note_id", "note_uri", "payload", drop.alias("drop"))
    else:
        rows = rows.withColumn("drop", F.lit(None).cast("array<int>"))
    return rows.mapInArrow(lambda b: _build(b, plan, parsed), f"note_id {kinds['note_id']}, note_uri string, {TREE_DDL}")


def nodes(trees_: DataFrame) -> DataFrame:
    """One row per node, with its text stream's slice."""
    return trees_.select("note_id", F.explode("nodes").alias("n")).select("note_id", "n.*")
