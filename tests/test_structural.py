"""Structural joins against the JVM's XPath; parsed nodes, single values, errors, and linear work on long notes."""

import json
import random
import time
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from spanloom.api import Conll, Engine, conll_of, foreign_conll, foreign_errors, parse_note
from spanloom.functions import plain
from spanloom.operators import matching, resolve, structural
from spanloom.queries import LEADS, MAPPING, PARAGRAPHS
from spanloom.sources.html_tree import parse
from spanloom.sources.notes import elements, read_pages

PATHS = [
    "//p", "//*", ".//b", "/html/body/div", "div/p", "//div//p", "//div/p[1]", "//p[last()]", "//p[position()<3]", "//li[2]/a", "//p[@class]", "//p[@class='x']", "//p[@class!='x']", "//p[not(@class)]",
    "//div[p]", "//p[b and @class]", "//p[b or @class]", "//p[contains(@class,'x')]", "//p[starts-with(@class, 'y')]", "//b/..", "//b/ancestor::div", "//b/parent::p", "//p/following-sibling::p", "//p/preceding-sibling::*",
    "//div/descendant::b", "//p[b][2]", "//b | //i | //p[1]", "//p[text()='two']", "//p[.='two']", "//p[contains(., 'w')]", "self::div", "//body", "//div[@id='d']/descendant-or-self::div", "//p[b='x']", "//nosuch", "//ul/li/a[@href]",
]
VALUES = ["//a/@href", "//div/@id", "string(//p)", "count(//p)", "concat(string(//p), '-', count(//b))", "normalize-space(//div)", "string-length(//p)", "boolean(//b)", "name(//div)", "string(//a/@href)"]


def odd_notes(spark):
    draw = random.Random(7)
    tags = ["div", "p", "b", "i", "ul", "li", "a", "span"]

    def some(depth: int) -> str:
        if depth == 0 or draw.random() < 0.25:
            return draw.choice(["one", "two", "w ", "x", "", " &amp; "])
        tag = draw.choice(tags)
        own = draw.choice(["", " class='x'", " class='yx'", " id='d'", " href='/h?a&amp;b'"])
        return f"<{tag}{own}>" + "".join(some(depth - 1) for _ in range(draw.randrange(4))) + f"</{tag}>"

    rows = [(i, "<html><body>" + "".join(some(4) for _ in range(3)) + "</body></html>") for i in range(40)]
    rows += [(100 + i, f"<div>{some(4)}{some(3)}</div>") for i in range(20)] + [(200, "<p>two</p>"), (201, "plain")]
    return spark.createDataFrame(rows, "note_id long, html string")


def seeds_of(spark, notes, xpath, how):
    run = Engine({"Annotation": {"X": {"xpath": xpath}}}, structural=how).parse(notes)
    assert (structural.programs(run.plan) is not None) == how
    return sorted(tuple(r) for r in run.seeds.select("note_id", F.explode("seeds").alias("s")).select("note_id", "s.*").collect())


@pytest.mark.parametrize("some", [PATHS[i : i + 9] for i in range(0, len(PATHS), 9)])
def test_paths_equal_the_jvms(spark, some):
    notes = odd_notes(spark)
    mapping = {"Annotation": {f"X{i}": {"xpath": x} for i, x in enumerate(some)}}
    got = {}
    for how in (True, False):
        run = Engine(mapping, structural=how).parse(notes)
        assert (structural.programs(run.plan) is not None) == how
        got[how] = sorted(tuple(r) for r in run.seeds.select("note_id", F.explode("seeds").alias("s")).select("note_id", "s.xp", "s.pos", "s.owner").collect())
    assert got[True] == got[False]


def test_values_equal_the_jvms(spark):
    notes = odd_notes(spark)
    for xpath in VALUES:
        assert seeds_of(spark, notes, xpath, True) == seeds_of(spark, notes, xpath, False), xpath


def test_texts_have_their_own_owners():
    root, document = parse("<div><p>a<b>b</b>c</p><p>d</p></div>")
    tree = structural.Tree(document)
    base = tree.number[id(root)]
    assert [(i - base, v) for i, v in structural.compile_branch("//p/text()").values(tree, base)] == [(1, "a"), (1, "c"), (3, "d")]
    assert structural.compile_branch("//*[2]").nodes(tree, base) == [base + 3]


@pytest.mark.parametrize("xpath", ["//p[1][@a]/following::b", "//p[count(b)=2]", "id('x')", "//p[position() mod 2 = 1]", "//@*", "substring(//p, 2)", "//x:p", "//p["])
def test_other_paths_are_left_to_the_jvm(xpath):
    assert structural.compile_branch(xpath) is None


@pytest.mark.parametrize("mapping", [MAPPING, PARAGRAPHS, LEADS], ids=["all", "paragraphs", "leads"])
def test_items_equal_on_pages(spark, mapping):
    pages = read_pages(spark, "/root/testdata/sf0.001")
    one, other = (Engine(mapping, structural=how).parse(pages) for how in (True, False))
    for of in (lambda r: r.items, lambda r: r.rdfa(), lambda r: r.roots):
        assert sorted(map(str, of(one).collect())) == sorted(map(str, of(other).collect()))


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_plans_have_no_xpath_and_no_exchange(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001")
    run = Engine(MAPPING).parse(pages)
    for df in (run.items, run.jsonld(), run.wadm(), run.tokens(Conll(type_whitelist=["Doc"])), run.tei()):
        plan = plan_of(df)
        assert "xpath(" not in plan
        assert "Exchange" not in plan
    assert plan_of(run.items).count("MapInArrow") == 1
    assert "container_text" not in run.items.columns


def test_custom_same_as_by_joins(spark):
    notes = spark.createDataFrame([(1, "<div><p><cite title='u1'>A</cite></p><p>B</p></div>")], "note_id long, html string")
    mapping = {"Annotation": {"P": {"xpath": "//p"}}, "sameAs": ".//cite/@title"}
    for how in (True, False):
        assert [r["same_as"] for r in Engine(mapping, structural=how).parse(notes).items.orderBy("order_index").collect()] == ["u1", None]


def test_parsed_nodes_equal_markup(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001")
    for mapping, how in ((MAPPING, True), (PARAGRAPHS, False)):
        a, b = Engine(mapping, structural=how).parse(pages), Engine(mapping, structural=how).parse_nodes(elements(pages))
        assert sorted(map(str, a.items.collect())) == sorted(map(str, b.items.collect()))
        assert sorted(map(str, a.roots.collect())) == sorted(map(str, b.roots.collect()))


def test_nodes_that_are_no_tree_are_errors(spark):
    schema = "note_id long, id int, parent int, tag string, attrs map<string,string>, text string, tail string"
    good = [(1, 0, None, "div", {"id": "a"}, None, "x"), (1, 1, 0, "p", None, "one ", None), (1, 2, 1, "b", {}, "two", "!")]
    bad = [(2, 0, None, "p", None, "a", None), (2, 1, None, "p", None, "b", None), (3, 0, None, "p", None, "a", None), (3, 1, 5, "p", None, "b", None), (4, 0, None, None, None, "a", None), (5, 0, None, "p", None, "a", None), (5, 0, None, "p", None, "a", None), (6, 0, 1, "p", None, "", None), (6, 1, None, "p", None, "", None)]
    run = Engine({"Document": {"xpath": "//p"}}).parse_nodes(spark.createDataFrame(good + bad, schema))
    assert [(r["note_id"], r["text"]) for r in run.items.collect()] == [(1, "one two!")]
    assert sorted(r["note_id"] for r in run.errors.collect()) == [2, 3, 4, 5, 6]
    assert Engine({"Document": {"xpath": "//p"}}).parse_nodes(spark.createDataFrame([], schema)).items.collect() == []


def test_element_notes(spark):
    top = ElementTree.fromstring("<section><!-- c --><p>A <b>B</b> tail</p></section>")
    out = parse_note(spark, top, {"Document": {"xpath": "//p"}})
    assert [r["text"] for r in out["JSON-LD"]["@graph"]] == ["A B tail", "A B tail"]


def test_values_are_items_without_a_place(spark):
    notes = spark.createDataFrame([(1, "<div><h1>Some  title</h1><p title='a &lt;b&gt;x&lt;/b&gt; c'>ax</p><p>and Some title</p></div>")], "note_id long, html string")
    run = Engine({"Structure": {"xpath": "string(//h1)"}, "Annotation": {"T": {"xpath": "//p/@title"}}}).parse(notes)
    assert [(r["text"], r["level"], r["doc"], r["html"], r["selector"]["start"]) for r in run.items.collect()] == [("Some title", 1, 0, None, 0)]
    assert [r["text"] for r in matching.matched_nodes(run.trees, run.plan).orderBy("xp").collect()] == ["Some title", "a x c"]


def test_unreadable_annotations_and_graphs_are_errors(spark):
    good = {"@type": "Annotation", "body": [{"purpose": "tagging", "value": "Per"}], "target": {"source": "s", "selector": [{"type": "TextPositionSelector", "start": 0, "end": 3}]}}
    bad = ["{oops", "[1]", json.dumps(good | {"body": [{"purpose": "tagging", "value": 5}]}), None, "5", json.dumps(good | {"target": {"source": "s", "selector": [{"type": "TextPositionSelector", "start": "0", "end": 3}]}}), json.dumps(good | {"target": {"source": "s", "selector": {"type": "TextPositionSelector", "start": 2**40, "end": 3}}}), json.dumps(good | {"@type": [1]}), "[" * 100_000]
    annotations = spark.createDataFrame([(1, i, j) for i, j in enumerate([json.dumps(good), *bad])], "note_id long, seq int, json string")
    graphs = spark.createDataFrame([(1, json.dumps({"@graph": [{"@id": "s", "text": "Ann met"}, 7, {"@id": 3, "text": "x"}]})), (1, "{"), (2, "[]"), (3, None), (4, '{"@graph": 5}')], "note_id long, json string")
    assert [r["text"] for r in foreign_conll(annotations, graphs).collect()] == ["Ann\tB-Per\nmet\tO\n"]
    found = foreign_errors(annotations, graphs).collect()
    assert sorted(r["seq"] for r in found if r["seq"] is not None) == list(range(1, 1 + len(bad)))
    assert sorted(r["note_id"] for r in found if r["seq"] is None) == [1, 2, 3, 4]
    assert conll_of(spark, {"text": "Ann met", "annotations": [good, 5, {"body": 7}]}) == "Ann\tB-Per\nmet\tO\n"


def test_labels_overwrite_in_order():
    draw = random.Random(5)
    for _ in range(300):
        text = " ".join(draw.choice(["a", "bb", "c,", "d"]) for _ in range(draw.randrange(12)))
        spans = [(draw.choice("XYZ"), draw.randrange(-1, 20), draw.randrange(22)) for _ in range(draw.randrange(6))]
        most = draw.choice([None, 1, 3])
        places = plain.token_spans(text)
        want = ["O"] * len(places)
        for label, start, end in spans:
            hit = [t["ix"] for t in places if t["end"] > start and t["start"] < end]
            if most is None or len(hit) <= most:
                for i in hit:
                    want[i] = f"{'B' if i == hit[0] else 'I'}-{label}"
        assert plain.bio(text, spans, most) == ([t["token"] for t in places], want)


def test_many_spans_over_many_tokens_in_linear_time():
    text, begun = "word " * 100_000, time.time()
    tokens, labels = plain.bio(text, [("X", i, 500_000 - i) for i in range(10_000)])
    assert len(tokens) == 100_000 and "O" in labels[-1:] + labels[:1] or labels[0] == "B-X"
    assert time.time() - begun < 5


def test_places_equal_locate():
    draw = random.Random(6)
    for _ in range(500):
        within = "".join(draw.choice("ab \n") for _ in range(draw.randrange(60)))
        text = "".join(draw.choice("ab ") for _ in range(draw.randrange(3)))
        at = draw.randrange(len(within) + 1)
        prefix, suffix = draw.choice([("", ""), (within[max(0, at - 5) : at], within[at + len(text) : at + len(text) + 12]), ("b", ""), ("", "a b")])
        assert resolve.Places(text, within).first(prefix, suffix) == resolve.locate(text, prefix, suffix, within)


def test_many_equal_links_in_linear_time():
    n = 10_000
    within = " ".join(f"{i} link {i}" for i in range(n))
    begun = time.time()
    places = resolve.Places("link", within)
    assert all(places.first(f" {i} ", f" {i} {i + 1} link") > 0 for i in range(n - 1))
    assert time.time() - begun < 5


def test_kept_places():
    draw = random.Random(9)
    for _ in range(500):
        raw = "".join(draw.choice("ab \t\n\r\x0b") for _ in range(draw.randrange(30)))
        text, places = plain.kept(raw)
        assert text == plain.canonical(raw) and len(text) == len(places)
        assert all(raw[p] == c or (raw[p], c) == ("\t", " ") for p, c in zip(places, text, strict=True))


def test_offsets_in_the_note(spark):
    html = "<div>x <p>one  two\n three <b>two</b></p> <blockquote>q <i>r</i></blockquote><p title='q'>one</p></div>"
    notes = spark.createDataFrame([(1, html)], "note_id long, html string")
    mapping = {"Document": {"xpath": "//p", "split": " three "}, "Quotation": {"xpath": "//blockquote"}, "Annotation": {"A": {"xpath": "//b | //i"}}}
    for how in (True, False):
        run = Engine(mapping, structural=how).parse(notes)
        note = run.roots.first()["text"]
        rows = run.items.join(run.offsets, ["note_id", "order_index"]).collect()
        assert len(rows) > 4
        assert all(note[r["note_start"] : r["note_end"]] == r["text"] for r in rows)
