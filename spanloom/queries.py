"""Queries of the markup operators over all of `pages`, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.api import Conll, Engine, Result, foreign_notes
from spanloom.functions import text as text_functions
from spanloom.operators import conll
from spanloom.sources.notes import elements, nodes, read_pages

#: The pages' own markup: every class, a regex rule, split and find.
MAPPING = {
    "Document": {"xpath": "//p", "types": ["Doc"]},
    "Structure": {"xpath": "//h1"},
    "Locator": {"xpath": "//title"},
    "Quotation": {"xpath": "//article"},
    "Annotation": {"Lead": {"xpath": "//b", "types": ["Lead", "Key"]}, "Link": {"xpath": "//li/a"}, "Ad": {"xpath": "//div[@class='ad']"}},
    "IGNORE": {"xpath": ["//script | //style", "//comment()"]},
}
PARAGRAPHS = {"Document": {"xpath": "//p", "types": ["Doc"]}, "IGNORE": {"xpath": ["//head", "//comment()"]}}
LEADS = {"Document": {"xpath": "//p", "types": ["Doc"]}, "Annotation": {"Lead": {"xpath": "//b", "types": ["Lead", "Key"]}}, "IGNORE": {"xpath": ["//head", "//comment()"]}}


def _run(spark: SparkSession, sf_dir: str, mapping: dict) -> Result:
    return Engine(mapping).parse(read_pages(spark, sf_dir))


def _items(cls: str, *columns: str, mapping: dict = MAPPING) -> Callable[[SparkSession, str], DataFrame]:
    """A class' items in order, numbered within the class and note."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _run(spark, sf_dir, mapping).items.where(F.col("cls") == cls)
        k = F.row_number().over(Window.partitionBy("note_id").orderBy("order_index"))
        return rows.select("note_id", k.alias("k"), *map(F.expr, columns))

    return query


def note_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as read: nothing but the columns asked for reaches the scan."""
    return read_pages(spark, sf_dir).select("note_id", "note_uri", F.length("html").alias("n_chars"))


def note_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PARAGRAPHS).roots.select("note_id", "text")


def ignore_regex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, {"Document": {"xpath": "//h1"}, "IGNORE": {"regex": ["[aeiou]+", "[%$#*&]+"]}})
    return rows.items.select("note_id", "order_index", "text")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: paragraphs of all pages as ordered Document items."""
    return _run(spark, sf_dir, PARAGRAPHS).items.select("note_id", "order_index", "text")


def node_counts_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = _run(spark, sf_dir, PARAGRAPHS).trees
    return nodes(trees).where(F.col("tag").isin("p", "b", "li", "a", "h1", "br")).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("note_id").alias("notes"))


def link_same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, {"Annotation": {"Link": {"xpath": "//li/a"}}, "Structure": {"xpath": "//nav"}}).items
    return rows.where("cls = 'Annotation'").select("note_id", F.row_number().over(Window.partitionBy("note_id").orderBy("order_index")).alias("k"), "text", "same_as")


def regex_mark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex hits in headings as items of their own."""
    rows = _run(spark, sf_dir, {"Annotation": {"Th": {"regex": r"\b[Tt]h\w*"}}, "IGNORE": {"xpath": ["//head", "//comment()", "//nav", "//p", "//footer", "//div"]}})
    found = rows.matches("node", "text")
    return found.select("note_id", F.row_number().over(Window.partitionBy("note_id").orderBy("node")).alias("k"), "text")


def regex_mark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex hits in all text of whole pages, counted."""
    rows = _run(spark, sf_dir, {"Annotation": {"Th": {"regex": r"\b[Tt]h\w*"}}, "IGNORE": {"xpath": ["//head", "//comment()"]}})
    return rows.matches("text").groupBy("note_id", "text").agg(F.count("*").alias("n"))


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What structure, locator and quotation each lead carries: by class numbers, all from one running pass."""
    rows = _run(spark, sf_dir, MAPPING).items
    names = rows.select("note_id", F.col("order_index").alias("o"), F.col("text").alias("t"))
    one = lambda column: names.select("note_id", F.col("o").alias(column), F.col("t").alias(f"{column}_text"))
    leads = rows.where("cls = 'Document'").select("note_id", "order_index", "structure", "locator")
    out = leads.join(one("structure"), ["note_id", "structure"], "left").join(one("locator"), ["note_id", "locator"], "left")
    k = F.row_number().over(Window.partitionBy("note_id").orderBy("order_index"))
    return out.select("note_id", k.alias("k"), "structure_text", "locator_text")


def structure_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, MAPPING).items.where("cls = 'Structure'")
    return rows.select("note_id", "text", "level", F.col("structure").isNull().alias("top"))


def container_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's container, by its class; the note is 'Note'."""
    rows = _run(spark, sf_dir, MAPPING).items
    classes = rows.select("note_id", F.col("order_index").alias("doc"), F.col("cls").alias("in_cls"))
    return rows.join(classes, ["note_id", "doc"], "left").groupBy("note_id", "cls", F.coalesce("in_cls", F.lit("Note")).alias("container")).agg(F.count("*").alias("n"))


def offset_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's text and the slice of its container that its selector names."""
    container = lambda i: F.when(i["doc"] == 0, F.col("note_text")).otherwise(F.get("items", i["doc"] - 1)["text"])
    checked = F.transform("items", lambda i: F.struct(i["cls"].alias("cls"), (text_functions.cut(container(i), i["start"], i["end"]) == i["text"]).alias("same")))
    rows = _run(spark, sf_dir, MAPPING).resolved.select(F.explode(checked).alias("i"))
    return rows.groupBy("i.cls").agg(F.count("*").alias("n"), F.count_if("i.same").alias("aligned"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, PARAGRAPHS).items
    return rows.select("note_id", "order_index", F.col("selector.start").alias("start"), F.col("selector.end").alias("end"), F.col("selector.prefix").alias("prefix"), F.col("selector.suffix").alias("suffix"))


def dropped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a second XPath over paragraphs that are containers themselves."""
    rows = _run(spark, sf_dir, {"Document": {"xpath": "//p"}, "Annotation": {"Again": {"xpath": "//p[1]"}}, "IGNORE": {"xpath": ["//head", "//comment()"]}})
    return rows.dropped.groupBy("xp").agg(F.count("*").alias("n"))


def split_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, {"Document": {"xpath": "//h1", "split": " "}, "IGNORE": {"xpath": "//comment()"}}).items
    return rows.select("note_id", "order_index", "text", (F.col("selector.start") - F.min("selector.start").over(Window.partitionBy("note_id"))).alias("at"))


def find_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, {"Document": {"xpath": "//h1", "find": "[a-z]+"}, "IGNORE": {"xpath": "//comment()"}}).items
    return rows.select("note_id", "order_index", "text")


def element_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, {"Structure": {"xpath": "//h1"}, "IGNORE": {"xpath": "//comment()"}})
    return rows.items.select("note_id", "html", text_functions.shorten(F.col("html"), 12).alias("short"))


def node_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix and suffix of links within their list entries, and of headings within their articles."""
    result = _run(spark, sf_dir, {"Annotation": {"Link": {"xpath": "//li/a"}}, "Structure": {"xpath": "//h1"}, "IGNORE": {"xpath": "//comment()"}})
    rows = result.matches("tag", "prefix", "suffix")
    return rows.groupBy("note_id", "tag").agg(F.count("*").alias("n"), F.max(F.length("prefix")).alias("prefix"), F.max(F.length("suffix")).alias("suffix"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _run(spark, sf_dir, PARAGRAPHS).items.select("note_id", F.col("order_index").alias("source"), "text")
    return conll.tokens(texts).select("note_id", "source", "tok_ix", "token")


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's slice is the token. Slices are compared where the text is, so no text meets its tokens by a join."""
    texts = _run(spark, sf_dir, PARAGRAPHS).items.select("note_id", "text")
    rows = texts.select("note_id", "text", text_functions.token_spans(F.col("text")).alias("found"))
    exact = F.filter("found", lambda t: text_functions.cut(F.col("text"), t["start"], t["end"]) == t["token"])
    return rows.groupBy("note_id").agg(F.sum(F.size("found")).alias("n"), F.sum(F.size(exact)).alias("exact")).where("n > 0")


def _bio(options: Conll) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _run(spark, sf_dir, LEADS).tokens(options)
        return rows.groupBy("note_id", "label").agg(F.count("*").alias("n"))

    return query


def wadm_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, PARAGRAPHS).annotations().select("note_id", "order_index", F.explode("selectors").alias("s"))
    return rows.select("note_id", "order_index", F.col("s.type").alias("type"), F.coalesce("s.exact", F.lit("")).alias("exact"), F.coalesce(F.col("s.end") - F.col("s.start"), F.lit(-1)).alias("span"), F.coalesce("s.value", F.lit("")).alias("value"))


def wadm_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, LEADS).annotations().select("note_id", F.explode("bodies").alias("b"))
    return rows.groupBy("note_id", F.col("b.type").alias("type"), F.col("b.purpose").alias("purpose"), F.col("b.value").alias("value")).agg(F.count("*").alias("n"))


def wadm_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, MAPPING).annotations()
    return rows.groupBy("note_id", "motivation", F.size("scope").alias("scopes")).agg(F.count("*").alias("n"))


def jsonld_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MAPPING).jsonld()


def wadm_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MAPPING).wadm()


def rdfa_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MAPPING).rdfa()


def tei_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MAPPING).tei()


def conll_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MAPPING).conll(Conll(max_span_tokens=10, type_whitelist=["Doc"], blacklist=["Key"]))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of headings of three levels, made of each page's title, links and leads."""
    pages = read_pages(spark, sf_dir)
    heads = lambda tag, pattern: F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")))
    made = F.concat(heads("h1", "<h1>([^<]*)</h1>"), heads("h2", "<li><a href=\"[^\"]*\">([^<]*)<"), heads("h3", "<p><b>([^<]*)<"), heads("h2", "<div class=\"ad\">([^<]*)<"))
    return pages.select("note_id", F.array_join(made, "").alias("html"), "note_uri")


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of three levels, with the text of the heading above."""
    rows = Engine({"Structure": {"xpath": "//h1 | //h2 | //h3"}}).parse(_headings(spark, sf_dir)).items
    above = rows.select("note_id", F.col("order_index").alias("structure"), F.col("text").alias("above"))
    out = rows.select("note_id", "order_index", "level", "text", "structure").join(above, ["note_id", "structure"], "left")
    return out.select("note_id", "order_index", "level", "text", "above")


def _graph(rows: DataFrame) -> DataFrame:
    """note_id, ix, r: the resources of each note's JSON, parsed back."""
    return rows.select("note_id", F.posexplode(F.variant_get(F.parse_json("json"), "$['@graph']", "array<variant>")).alias("ix", "r"))


def _at(path: str, kind: str = "string") -> Column:
    return F.variant_get("r", f"$.{path}", kind)


def jsonld_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON-LD of paragraphs says; the note is the first resource."""
    rows = _graph(_run(spark, sf_dir, PARAGRAPHS).jsonld())
    note = F.variant_get("r", "$.note", "string")
    items = rows.where("ix > 0").select("note_id", _at("orderIndex", "int").alias("order_index"), _at("text").alias("text"), F.variant_get("r", "$['@type'][0]", "string").alias("type"), note.alias("note"))
    root = rows.where("ix = 0").select("note_id", F.variant_get("r", "$['@id']", "string").alias("root"))
    return items.join(root, "note_id").select("note_id", "order_index", "text", "type", (F.col("note") == F.col("root")).alias("of_note"))


def wadm_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the web annotations of paragraphs say."""
    rows = _graph(_run(spark, sf_dir, PARAGRAPHS).wadm())
    start, end = _at("target.selector.items[1].start", "int"), _at("target.selector.items[1].end", "int")
    return rows.select("note_id", (F.col("ix") + 1).alias("order_index"), _at("target.selector.items[0].exact").alias("exact"), (end - start).alias("span"), _at("target.selector.items[2].value").alias("xpath"), _at("body[1].value").alias("tag"))


def conll_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the CoNLL text of leads."""
    rows = _run(spark, sf_dir, LEADS).conll(Conll(type_whitelist=["Doc"]))
    lines = rows.select("note_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line", "t"))
    return lines.select("note_id", "line", F.split("t", "\t")[0].alias("token"), F.split("t", "\t")[1].alias("label"))


def rdfa_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each type in the RDFa of leads."""
    rows = _run(spark, sf_dir, LEADS).rdfa().select("note_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-z0-9]+ [^>]*typeof=\"[^\"]*)\""), F.lit(1))).alias("t"))
    return rows.groupBy("note_id", F.split("t", " ")[0].alias("tag"), F.regexp_extract("t", "typeof=\"([^\"]*)$", 1).alias("types")).agg(F.count("*").alias("n"))


def _unescaped(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def tei_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the paragraphs of the TEI, read back."""
    rows = _run(spark, sf_dir, PARAGRAPHS).tei().select("note_id", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<tei:p [^>]*>(.*?)</tei:p>"), F.lit(1))).alias("k", "t"))
    return rows.select("note_id", (F.col("k") + 1).alias("order_index"), _unescaped(F.regexp_replace("t", "<[^>]*>", "")).alias("text"))


def parsed_nodes_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_items of pages that come as a table of parsed nodes instead of markup."""
    run = Engine(PARAGRAPHS).parse_nodes(elements(read_pages(spark, sf_dir)))
    return run.items.select("note_id", "order_index", "text")


def attribute_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of attributes as matches, and the text of the element around each."""
    run = _run(spark, sf_dir, {"Annotation": {"Href": {"xpath": "//li/a/@href"}}})
    found = run.matches("pos", "text", "tag", "tree_index")
    return found.select("note_id", (F.col("pos") + 1).alias("k"), "text", "tag", F.col("tree_index").isNull().alias("placeless"))


def scalar_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XPaths that give one value: a string and numbers put together."""
    run = _run(spark, sf_dir, {"Locator": {"xpath": "string(//title)"}, "Annotation": {"N": {"xpath": "concat(count(//li/a), '/', count(//h1), ' ', normalize-space(//h1))"}}})
    return run.matches("xp", "text")


def scalar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of a string value stands in the note, where its text is first found."""
    rows = _run(spark, sf_dir, {"Locator": {"xpath": "string(//title)"}, "Structure": {"xpath": "//h1"}}).items
    return rows.where("cls = 'Locator'").select("note_id", "text", "doc", F.col("selector.start").alias("start"), F.col("html").isNull().alias("placeless"))


def foreign_conll_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web annotations of paragraphs, read back as from elsewhere, every second one damaged in one of three ways: which are errors, and what labels the others give."""
    run = _run(spark, sf_dir, PARAGRAPHS)
    seq = F.col("ix").cast("int") + 1
    whole = F.to_json("r")
    damaged = F.when(seq % 6 == 1, F.concat(F.lit("{"), whole)).when(seq % 6 == 3, F.concat(F.lit("["), whole, F.lit("]"))).when(seq % 6 == 5, F.lit('{"target": {"source": 5, "selector": []}}')).otherwise(whole)
    given = _graph(run.wadm()).select("note_id", seq.alias("seq"), damaged.alias("json"))
    tokens = F.size(F.split("text", "\n")) - F.size(F.split("text", "\n\n"))
    return foreign_notes(given, run.jsonld()).select("note_id", "errors", F.when(F.col("text").isNull(), 0).otherwise(tokens).alias("tokens"), F.coalesce(F.contains("text", F.lit("\tB-Doc\n")), F.lit(False)).alias("labelled"))


def tei_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the TEI of headings of three levels, with how many divisions are around them."""
    rows = Engine({"Structure": {"xpath": "//h1 | //h2 | //h3"}}).parse(_headings(spark, sf_dir)).tei()
    # Divisions lie below TEI, text and body, two blanks a level.
    pattern = r"(?m)^( *)<tei:div[^>]*>\n *<tei:head [^>]*>([^<]*)</tei:head>"
    both = F.arrays_zip(F.regexp_extract_all("xml", F.lit(pattern), F.lit(1)).alias("blanks"), F.regexp_extract_all("xml", F.lit(pattern), F.lit(2)).alias("text"))
    heads = rows.select("note_id", F.posexplode(both).alias("k", "h"))
    return heads.select("note_id", (F.length("h.blanks") / 2 - 2).cast("int").alias("depth"), _unescaped(F.col("h.text")).alias("text")).groupBy("note_id", "depth", "text").agg(F.count("*").alias("n"))


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the pages' own markup, with all that it refers to by order index."""
    rows = _run(spark, sf_dir, MAPPING).items
    return rows.select("note_id", "order_index", "cls", F.concat_ws(",", "types").alias("types"), "text", "doc", "structure", "locator", "quotation", "level")


def two_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as documents and as annotations by one XPath: the annotation stands in the document that it made."""
    rows = _run(spark, sf_dir, PARAGRAPHS | {"Annotation": {"Para": {"xpath": "//p", "types": ["Para", "Block"]}}}).items
    return rows.select("note_id", "order_index", "cls", "text", "doc", (F.col("selector.end") - F.col("selector.start")).alias("span"), F.when(F.col("cls") == "Annotation", F.col("selector.start")).alias("start"), F.concat_ws(",", "types").alias("types"))


def tei_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the TEI of the pages' own markup holds, in its order: heads, paragraphs with names in them, milestones and quotes."""
    pattern = r"(?s)<tei:(?:(head) [^>]*>([^<]*)</tei:head>|(p) [^>]*>(.*?)</tei:p>|(milestone) [^>]*?n=\"([^\"]*)\"[^>]*/>|(quote) [^>]*>([^<]*)</tei:quote>)"
    found = F.filter(F.split(F.regexp_replace("xml", pattern, "\x01$1$3$5$7\x02$2$4$6$8\x01"), "\x01"), lambda x: F.contains(x, F.lit("\x02")))
    rows = _run(spark, sf_dir, MAPPING).tei().select("note_id", F.posexplode(found).alias("k", "e"))
    inner = F.split("e", "\x02")[1]
    text = F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), "&#10;", "\n")
    return rows.select("note_id", "k", F.split("e", "\x02")[0].alias("kind"), F.regexp_replace(_unescaped(text), r"^\s+|\s+$", "").alias("text"), F.size(F.regexp_extract_all(inner, F.lit("<tei:name "), F.lit(0))).alias("names"))


def cleaned_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markup of notes of headings, without those of one level, printed again."""
    rows = Engine({"Structure": {"xpath": "//h1"}, "IGNORE": {"xpath": "//h3"}}).parse(_headings(spark, sf_dir)).roots
    return rows.select("note_id", "html")


def note_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where paragraphs, and the leads that stand in them, are in their note's text, and whether they are what is there."""
    run = _run(spark, sf_dir, LEADS)
    return run.placed.select("note_id", "order_index", "cls", "note_start", "note_end", (F.col("found") == F.col("text")).alias("same"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "note_scan": note_scan,
    "note_text": note_text,
    "ignore_regex_text": ignore_regex_text,
    "document_items": document_items,
    "structure_items": _items("Structure", "text", "level"),
    "locator_items": _items("Locator", "text"),
    "quotation_items": _items("Quotation", "doc"),
    "annotation_items": _items("Annotation", "concat_ws(',', types) AS types"),
    "node_counts_by_tag": node_counts_by_tag,
    "link_same_as": link_same_as,
    "regex_mark_items": regex_mark_items,
    "current_state": current_state,
    "structure_parent": structure_parent,
    "container_of": container_of,
    "offset_alignment": offset_alignment,
    "context_window": context_window,
    "dropped_matches": dropped_matches,
    "split_fragments": split_fragments,
    "find_fragments": find_fragments,
    "element_html": element_html,
    "node_context": node_context,
    "tokens": tokens,
    "token_spans": token_spans,
    "bio_labels": _bio(Conll(type_whitelist=["Doc"])),
    "bio_span_cap": _bio(Conll(type_whitelist=["Doc"], max_span_tokens=5)),
    "type_whitelist": _bio(Conll(type_whitelist=["Nothing"])),
    "label_blacklist": _bio(Conll(type_whitelist=["Doc"], blacklist=["Key", "Doc"])),
    "wadm_selectors": wadm_selectors,
    "wadm_bodies": wadm_bodies,
    "wadm_scope": wadm_scope,
    "jsonld_graph": jsonld_graph,
    "wadm_graph": wadm_graph,
    "rdfa_html": rdfa_html,
    "tei_xml": tei_xml,
    "conll_text": conll_text,
    "regex_mark_words": regex_mark_words,
    "heading_levels": heading_levels,
    "jsonld_items": jsonld_items,
    "wadm_items": wadm_items,
    "conll_lines": conll_lines,
    "rdfa_types": rdfa_types,
    "tei_paragraphs": tei_paragraphs,
    "parsed_nodes_items": parsed_nodes_items,
    "attribute_matches": attribute_matches,
    "scalar_matches": scalar_matches,
    "scalar_items": scalar_items,
    "foreign_conll_errors": foreign_conll_errors,
    "tei_divisions": tei_divisions,
    "item_rows": item_rows,
    "two_classes": two_classes,
    "tei_content": tei_content,
    "cleaned_html": cleaned_html,
    "note_offsets": note_offsets,
}
