"""Hand-derived notes: one test for each rule of the semantics that is easy to get wrong."""

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from spanloom.api import Conll, Engine, conll_of, parse_note


def run(spark, html, mapping, **options):
    return Engine(mapping, **options).parse(spark.createDataFrame([(1, html, None)], "note_id long, html string, note_uri string"))


def items(spark, html, mapping, *columns, **options):
    df = run(spark, html, mapping, **options).items.orderBy("order_index")
    return [tuple(r) for r in df.select(*(columns or ("order_index", "cls", "text", "selector.start", "selector.end", "doc", "quotation"))).collect()]


def note_text(spark, html, mapping, **options):
    return run(spark, html, mapping, **options).roots.first()["text"]


def test_containers_order_and_offsets(spark):
    html = "<div><p>P1</p><blockquote><p>quote <em>Emphasis</em></p></blockquote></div>"
    mapping = {"Document": {"xpath": "//p"}, "Annotation": {"C": {"xpath": "//em"}}, "Quotation": {"xpath": "//blockquote"}}
    assert note_text(spark, html, mapping) == "P1\nquote Emphasis"
    assert items(spark, html, mapping) == [
        (1, "Document", "P1", 0, 2, 0, None),
        (2, "Quotation", "quote Emphasis", 3, 17, 0, None),
        (3, "Document", "quote Emphasis", 0, 14, 2, 2),
        (4, "Annotation", "Emphasis", 6, 14, 3, 2),
    ]
    assert [r[0] for r in items(spark, html, mapping, "tree_index")] == [1, 2, 3, 4]


def test_regex_hit_that_fills_its_text_is_not_wrapped(spark):
    html = "<div><p>#a</p><p>see #b now</p></div>"
    found = items(spark, html, {"Document": {"xpath": "//p"}, "Annotation": {"T": {"regex": r"#\w+"}}})
    assert found == [(1, "Document", "#a", 0, 2, 0, None), (2, "Document", "see #b now", 3, 13, 0, None), (3, "Annotation", "#b", 4, 6, 2, None)]


def test_heading_levels_are_never_cleared(spark):
    html = "<div><h1>A</h1><h2>B</h2><h1>C</h1><h3>D</h3></div>"
    assert items(spark, html, {"Structure": {"xpath": ["//h1", "//h2", "//h3"]}}, "text", "level", "structure") == [("A", 1, None), ("B", 2, 1), ("C", 1, None), ("D", 3, 2)]


def test_ignored_nodes_take_the_text_behind_them(spark):
    assert note_text(spark, "<div><p>a</p><pre>x</pre>tail<p>b</p></div>", {"Document": {"xpath": "//p"}, "IGNORE": {"xpath": "//pre"}}) == "a\nb"


def test_ignored_patterns_leave_every_text(spark):
    assert note_text(spark, "<div><p>a 12 b</p><p>7c</p></div>", {"Document": {"xpath": "//p"}, "IGNORE": {"regex": [r"\d+", "z"]}}) == "a b\nc"


def test_split_offsets(spark):
    mapping = {"Document": {"xpath": "//p"}, "Annotation": {"K": {"xpath": "//strong", "split": r"\s*(?:,|\band\b)\s*"}}}
    found = items(spark, "<div><p><strong>x, y and z</strong></p></div>", mapping)
    assert found[1:] == [(2, "Annotation", "x", 0, 1, 1, None), (3, "Annotation", "y", 3, 4, 1, None), (4, "Annotation", "z", 9, 10, 1, None)]


def test_find_without_a_hit_takes_the_whole_text(spark):
    assert items(spark, "<div><p>abc</p></div>", {"Document": {"xpath": "//p", "find": r"\d+"}}, "text") == [("abc",)]
    assert items(spark, "<div><p>a1b22</p></div>", {"Document": {"xpath": "//p", "find": r"\d+"}}, "text", "selector.start") == [("1", 1), ("22", 3)]


def test_context_is_that_of_the_first_occurrence(spark):
    found = items(spark, "<div><p>Paris and <b>Paris</b></p></div>", {"Document": {"xpath": "//p"}, "Annotation": {"E": {"xpath": "//b"}}})
    assert found[1] == (2, "Annotation", "Paris", 0, 5, 1, None)


QUOTED = "<div><p>Paris x <i>in <b>Paris</b></i></p></div>"
QUOTED_MAPPING = {"Document": {"xpath": "//p", "types": ["Doc"]}, "Annotation": {"E": {"xpath": "//b", "types": ["E"]}}}


def test_quote_and_position_both_label(spark):
    result = run(spark, QUOTED, QUOTED_MAPPING)
    assert result.items.where("cls = 'Annotation'").select("selector.start", "selector.end").first()[:] == (11, 16)
    text = result.conll(Conll(type_whitelist=["Doc"])).first()["text"]
    assert text == "Paris\tB-E\nx\tO\nin\tO\nParis\tB-E\n"


def test_blacklisted_labels_leave_their_sentence(spark):
    text = run(spark, QUOTED, QUOTED_MAPPING).conll(Conll(type_whitelist=["Doc"], blacklist=["E"])).first()["text"]
    assert {line.split("\t")[1] for line in text.splitlines() if line} == {"O"}


def test_spans_over_the_cap_are_left_out(spark):
    mapping = {"Document": {"xpath": "//p", "types": ["Doc"]}, "Annotation": {"E": {"xpath": "//b", "types": ["E"]}}}
    html = "<div><p>z <b>one two three</b></p></div>"
    assert "B-E" in run(spark, html, mapping).conll(Conll(type_whitelist=["Doc"])).first()["text"]
    assert "B-E" not in run(spark, html, mapping).conll(Conll(type_whitelist=["Doc"], max_span_tokens=2)).first()["text"]


def test_an_element_of_two_xpaths(spark):
    html = '<div><p class="k">a</p><p>b</p></div>'
    other = {"Document": {"xpath": "//p"}, "Annotation": {"K": {"xpath": "//p[@class='k']"}}}
    assert items(spark, html, other, "cls", "text") == [("Document", "a"), ("Document", "b")]
    assert run(spark, html, other).dropped.select("text").collect()[0][0] == "a"
    same = {"Document": {"xpath": "//p"}, "Annotation": {"K": {"xpath": "//p"}}}
    assert items(spark, html, same, "cls", "text", "selector.start", "doc") == [("Document", "a", 0, 0), ("Annotation", "a", 0, 1), ("Document", "b", 2, 0), ("Annotation", "b", 0, 3)]


def test_comments_are_text(spark):
    assert items(spark, "<div><p>a<!--c-->b</p></div>", {"Document": {"xpath": "//p"}}, "text") == [("acb",)]
    assert items(spark, "<div><p>a<!--c-->b</p></div>", {"Document": {"xpath": "//p"}, "IGNORE": {"xpath": "//comment()"}}, "text") == [("a",)]


def test_same_as(spark):
    html = '<div><p>See <b><a href="wd:Paris">Paris</a></b></p></div>'
    mapping = {"Document": {"xpath": "//p"}, "Annotation": {"E": {"xpath": "//b"}}}
    assert items(spark, html, mapping, "same_as") == [(None,), ("wd:Paris",)]
    assert items(spark, html, mapping | {"sameAs": ".//a/@href"}, "same_as") == [(None,), ("wd:Paris",)]
    assert items(spark, html, mapping | {"sameAs": "@title"}, "same_as") == [(None,), (None,)]


def test_locators_carry_on(spark):
    html = "<div><p><code>p.1</code></p><p>t</p></div>"
    assert items(spark, html, {"Document": {"xpath": "//p"}, "Locator": {"xpath": "//code"}}, "cls", "locator") == [("Document", None), ("Locator", None), ("Document", 2)]


def test_line_feeds_collapse_before_blanks(spark):
    assert note_text(spark, "<div>a\n \n \nb</div>", {"Document": {"xpath": "//p"}}) == "a\n\n\nb"


def test_attribute_matches(spark):
    html = '<div><p>x <a href="u" title="Some  title">x</a></p></div>'
    assert items(spark, html, {"Annotation": {"T": {"xpath": "//a/@title"}}}, "text") == []
    assert items(spark, '<div><p><a title="x">x</a></p></div>', {"Annotation": {"T": {"xpath": "//a/@title"}}}, "text", "tree_index") == [("x", None)]


def test_empty_elements_leave_but_breaks_stay(spark):
    html = "<div><p>a<br>b</p><p><img src='x'> </p><p><b> </b></p><ul><li></li></ul></div>"
    assert note_text(spark, html, {"Document": {"xpath": "//p"}}) == "a\nb"
    assert run(spark, html, {"Document": {"xpath": "//p"}}).trees.select(F.expr("transform(nodes, n -> n.tag)")).first()[0] == ["div", "p", "br"]
    assert len(run(spark, html, {"Document": {"xpath": "//p"}}, remove_empty_tags=False).trees.select("nodes").first()[0]) > 3


@pytest.mark.parametrize(
    ("mapping", "error"),
    [({}, ValueError), ([], TypeError), ({"Document": {"xpath": "//p["}}, ValueError), ({"Annotation": {"xpath": "//p"}}, ValueError)],
)
def test_mapping_errors(spark, mapping, error):
    with pytest.raises(error):
        run(spark, "<p>a</p>", mapping)


def test_html_errors(spark):
    with pytest.raises(ValueError, match="empty"):
        parse_note(spark, " ", {"Document": {"xpath": "//p"}})
    with pytest.raises(TypeError):
        parse_note(spark, 3, {"Document": {"xpath": "//p"}})


def test_all_outputs_of_one_note(spark):
    html = "<html><body><h1>Title</h1><p>See <a href='wd:1'>one</a>, <em>two</em>.</p><blockquote>q</blockquote></body></html>"
    mapping = {
        "@type": ["Note", "X"], "@id": "urn:n", "@context": {"ex": "http://e.x/", "@vocab": "http://v/", "n": {"@id": "inNote"}}, "metadata": {"by": "me", "n": {"a": [1]}}, "wadm": {"metadata": {"creator": "c"}},
        "Document": {"xpath": "//p", "types": "Doc"}, "Structure": {"xpath": "//h1"}, "Quotation": {"xpath": "//blockquote"}, "Annotation": {"E": {"xpath": "//a | //em", "types": ["E", "F"]}},
    }
    before = json.dumps(mapping)
    out = parse_note(spark, html, mapping, rdfa=True, wadm=True, tei=True, conll={"type_whitelist": ["Doc"]})
    assert json.dumps(mapping) == before
    graph = out["JSON-LD"]["@graph"]
    assert [g.get("orderIndex") for g in graph] == [None, 1, 2, 3, 4, 5]
    assert graph[0]["@id"] == "urn:n" and graph[0]["@type"] == ["Note", "X"] and graph[0]["by"] == "me" and graph[0]["n"] == {"a": [1]}
    assert graph[1]["@type"] == "Structure" and graph[1]["level"] == 1 and graph[1]["doc"] == "urn:n"
    assert graph[2]["@type"] == "Doc" and graph[2]["structure"] == graph[1]["@id"]
    assert graph[3]["sameAs"] == "wd:1" and graph[3]["doc"] == graph[2]["@id"] and graph[3]["@type"] == ["E", "F"] and "sameAs" not in graph[4]
    first = out["WADM"]["@graph"][0]
    assert first["creator"] == "c" and first["motivation"] == "identifying" and first["target"]["scope"] == "urn:n"
    assert [s["type"] for s in first["target"]["selector"]["items"]] == ["TextQuoteSelector", "TextPositionSelector", "XPathSelector"]
    assert first["target"]["selector"]["items"][1] == {"type": "TextPositionSelector", "start": 0, "end": 5}
    assert [b["purpose"] for b in out["WADM"]["@graph"][2]["body"]] == ["identifying", "tagging", "tagging"]
    assert len(out["WADM"]["@graph"][2]["target"]["scope"]) == 2
    assert '<html xmlns:ex="http://e.x/" vocab="http://v/">' in out["RDFa"] and '<p typeof="Doc">' in out["RDFa"] and '<a typeof="E F" href="wd:1">' in out["RDFa"]
    assert "<tei:head" in out["TEI"] and 'target="wd:1">one</tei:name>' in out["TEI"] and "<tei:quote" in out["TEI"]
    assert "one\tB-F" in out["CoNLL"] and out["CoNLL"].startswith("See\tO\n")


def test_foreign_annotations(spark):
    from spanloom.operators import conll as c

    ann = {"@type": "Annotation", "body": ["http://x/Per", {"purpose": "tagging", "value": "P2"}], "target": {"source": "s", "selector": {"type": "Choice", "items": [{"type": "TextQuoteSelector", "exact": "Ann"}, {"type": "List", "members": [{"type": "TextPositionSelector", "start": 8, "end": 11}]}, {"type": "X", "refinedBy": {"type": "TextQuoteSelector", "exact": "met"}}]}}}
    df = spark.createDataFrame([(1, json.dumps(ann), 1)], "note_id long, j string, seq int").select("note_id", "seq", c.parse_annotations(F.col("j")).alias("a"))
    rows = df.select("note_id", "a.source", "seq", "a.labels", "a.selectors")
    texts = spark.createDataFrame([(1, "s", "Ann met Bob.", 1)], "note_id long, source string, text string, first_seq int")
    labels = c.gathered(c.foreign_sentences(rows, texts, whitelist=["Per"]))
    assert c.conll(labels).first()["text"] == "Ann\tB-Per\nmet\tB-Per\nBob\tB-Per\n.\tO\n"


def test_parsed_elements(spark):
    top = ElementTree.fromstring("<div><p>A &amp; B<br/>C</p> tail<section><p>D <b>E</b></p>behind</section></div>")
    mapping = {"Document": {"xpath": "//p"}, "Annotation": {"X": {"xpath": "//b"}}}
    texts = lambda note: [r["text"] for r in parse_note(spark, note, mapping)["JSON-LD"]["@graph"]]
    assert texts(top) == texts("<div><p>A &amp; B<br>C</p> tail<section><p>D <b>E</b></p>behind</section></div>")
    assert texts(top[1]) == ["D E\nbehind", "D E", "E"] and texts(top[0]) == ["A & B\nC"] * 2
    with pytest.raises(TypeError):
        parse_note(spark, b"<p>x</p>", mapping)


def test_conll_of_foreign_annotations(spark):
    quote = lambda source, value, exact, kind="Annotation": {"@type": kind, "body": {"purpose": "tagging", "value": value}, "target": {"source": source, "selector": {"type": "TextQuoteSelector", "exact": exact}}}
    given = [quote("b", "Place", "Rome"), quote("a", "Per", "Ann"), quote("a", "Not", "met", ["Note", "Draft"]), quote("c", "Per", "Ann")]
    graph = {"@graph": [{"@id": "a", "@type": "Doc", "text": "Ann met"}, {"@id": "b", "@type": ["Page", "Doc"], "text": "In Rome"}, {"@id": "d", "text": "unasked"}]}
    assert conll_of(spark, given, jsonld=graph) == "In\tO\nRome\tB-Place\n\nAnn\tB-Per\nmet\tB-Not\n"
    assert conll_of(spark, given, Conll(blacklist=["Draft"], type_whitelist=["Doc"]), graph) == "In\tO\nRome\tB-Place\n\nAnn\tB-Per\nmet\tO\n"
    assert conll_of(spark, given, Conll(type_whitelist=["Page"]), graph) == "In\tO\nRome\tB-Place\n"
    assert conll_of(spark, {"text": "Ann met Rome", "annotations": given}, Conll(whitelist=["Per", "Place"])) == "Ann\tB-Per\nmet\tO\nRome\tB-Place\n"
    assert conll_of(spark, {"text": "Ann", "annotations": []}) == "Ann\tO\n"
    assert conll_of(spark, [], jsonld=graph) == ""
    for wrong in (given, "text", {"text": "x"}):
        with pytest.raises(ValueError):
            conll_of(spark, wrong)


def test_notes_without_markup_stop_nobody(spark):
    rows = [(1, None, None), (2, " \n \x1c", None), (3, "<p>a</p>", None), (None, "", None)]
    run = Engine({"Document": {"xpath": "//p"}, "IGNORE": {"xpath": "//i"}}).parse(spark.createDataFrame(rows, "note_id long, html string, note_uri string"))
    assert [tuple(r) for r in run.items.select("note_id", "text").collect()] == [(3, "a")]
    assert [r["note_id"] for r in run.roots.collect()] == [3] and run.jsonld().count() == 1
    assert {tuple(r) for r in run.errors.collect()} == {(1, "'html' is null"), (2, "'html' is empty"), (None, "'html' is empty")}


def test_opening_texts_with_hits_move_behind_the_children(spark):
    from spanloom.sources.html_tree import Streams, Wrap, parse, wrap_matches

    root, document = parse("<div>a #x b <i>#y</i> c #z d</div>")
    wrap_matches(root, (Wrap(r"#\w", "T", "r"),))
    span = lambda t: f'<span class="T" data-rw-uuid="r">{t}</span>'
    assert Streams(root, document).ser == f"<div><i>#y</i> c {span('#z')} da {span('#x')} b </div>"


def test_selectors_nest():
    from spanloom.operators.conll import flatten_selector

    quote, position = {"type": "TextQuoteSelector", "exact": "a"}, {"type": "TextPositionSelector", "start": 1, "end": 2}
    refined = {"type": "X", "refinedBy": {"type": "Choice", "items": [quote, 3, position]}}
    assert flatten_selector({"type": "List", "members": [position, refined, quote]}) == [position, refined, quote, position, quote]
    assert flatten_selector([quote]) == [] and flatten_selector({"type": "X", "items": [quote]}) == []


def test_long_texts_are_cut_into_tokens_in_one_pass():
    from spanloom.functions.plain import token_spans

    found = token_spans("ab, c " * 50_000)
    assert len(found) == 150_000 and found[-1] == {"ix": 149_999, "token": "c", "start": 299_998, "end": 299_999}
