"""Tree builder, plans, streams, and the queries against their SQL."""

import os

import duckdb
import pytest

from spanloom.plans.mapping import anchored, branches, compile_mapping, kind_of
from spanloom.sources.html_tree import COMMENT, Node, Streams, parse, parse_document

SF = "/root/testdata/sf0.001"


def shape(node: Node) -> str:
    """tag(text children tail) in short."""
    if node.tag == COMMENT:
        return f"<!{node.text}>{node.tail}"
    return f"{node.tag}({node.text}{''.join(map(shape, node.children))}){node.tail}"


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<p>a<p>b", "p(a)p(b)"),
        ("<p><em>a<p>b", "p(em(ap(b)))"),
        ("<p>1<b>2<div>3", "p(1b(2div(3)))"),
        ("<a>1<p>2<a>3", "a(1p(2a(3)))"),
        ("<ul><li>1<li>2</ul>x", "ul(li(1)li(2))x"),
        ("<p><b>T<br><p>x</p>", "p(b(Tbr()))p(x)"),
        ("<b>1<div>2</b>3</div>4", "b(1div(23)4)"),
        ("<div><span>a</div>b", "div(span(a))b"),
        ("text <b>x</b>", "p(text b(x))"),
        ("<i>x<p>y</i>z", "i(x)p(yz)"),
        ("<p>a<section>b</section>c", "p(asection(b)c)"),
        ("<h1>a<h2>b", "h1(ah2(b))"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "table(tr(td(1)td(2))tr(td(3)))"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt(a)dd(b)dt(c))"),
        ("<p>a</i></div>b</p>", "p(ab)"),
        ("&lt;a&gt; &copy &unknown; &#65;&#x42;", "p(<a> &copy &unknown; AB)"),
        ("<p title='x>y' hidden>a<!--c-->b</p>", "p(a<!c>b)"),
        ("<p>a<br/>b<img src=x>c</p>", "p(abr()bimg()c)"),
        ("<p>cut<a hre", "p(cut)"),
    ],
)
def test_recovery(markup, want):
    body = next(c for c in parse_document(markup).children if c.tag == "body")
    assert "".join(map(shape, body.children)) == want


def test_heads_and_raw_text():
    top = parse_document("<!DOCTYPE html><title>t</title><script>if (a<b) x='<p>';</script>body text")
    head, body = top.children
    assert [c.tag for c in head.children] == ["title", "script"] and head.children[1].text == "if (a<b) x='<p>';"
    assert shape(body) == "body(p(body text))"


def test_roots():
    assert parse("<p>a</p>")[0].tag == "p"
    assert parse("<p>a</p><p>b</p>")[0].tag == "div"
    assert parse("<b>a</b> and <i>b</i>")[0].tag == "span"
    assert parse("a <i>b</i>")[0].tag == "p"
    assert parse("<b>a</b><i>b</i>")[0].tag == "span"
    assert parse("<html><p>a</p></html>")[0].tag == "html"


def test_streams():
    root, document = parse('<div><p id="a&quot;b">x &amp; y</p><!--c-->t<br></div>')
    s = Streams(root, document)
    assert s.raw == "x & y\nct\n\n"
    assert s.ser == '<div><p id="a&quot;b">x &amp; y</p><!--c-->t<br></div>'
    assert [(r.tag, r.id, r.parent, r.last) for r in s.rows] == [("div", 0, -1, 3), ("p", 1, 0, 1), (COMMENT, 2, 0, 2), ("br", 3, 0, 3)]
    assert all(s.xml[a:b].startswith("<") for r in s.rows for a, b in [r.xml])
    deep = Streams(*parse("<div>" * 3000 + "x"))
    assert len(deep.rows) == 3000 or deep.rows


def test_xpath_parts():
    assert branches("//a[contains(., '|')] | .//b") == ["//a[contains(., '|')]", ".//b"]
    assert [kind_of(x) for x in ("//a/@href", "//p/text()", "//a[@href='/x']", "//p[a/@x]")] == ["attribute", "text", "node", "node"]
    assert anchored(".//span", "//*[@__root]") == "//*[@__root]//span"
    assert anchored("p", "/*") == "/*/p" and anchored("self::a/@href", "/*") == "/*[self::a]/@href" and anchored("//comment()", "") == "//__comment__"


def test_plans_are_immutable_and_repeatable():
    mapping = {"metadata": {"a": 1}, "Annotation": {"T": {"regex": ["x", "y"]}}, "Document": {"xpath": ["//p", "//p"]}}
    one, two = compile_mapping(mapping), compile_mapping(mapping)
    assert one == two and "metadata" in mapping and "rw_uuid" in one.echo
    assert len(one.wraps) == 2 and one.xpaths[1:] == ("//p",)
    assert '"metadata"' in compile_mapping(mapping, {"b": 2}).echo


def test_stream_of_notes(spark, tmp_path):
    from spanloom.api import Engine
    from spanloom.streaming.notes import parse_stream

    spark.createDataFrame([(1, "<p>a</p>", "u"), (2, "<p>b</p><p>c</p>", None)], "note_id long, html string, note_uri string").write.parquet(f"file://{tmp_path}/in")
    notes = spark.readStream.schema("note_id long, html string, note_uri string").parquet(f"file://{tmp_path}/in")
    sink = lambda result, n: result.items.select("note_id", "text").write.parquet(f"file://{tmp_path}/out/{n}")
    query = parse_stream(notes, Engine({"Document": {"xpath": "//p"}}), sink).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/out").collect()} == {(1, "a"), (2, "b"), (2, "c")}


def test_queries_against_sql(spark):
    from spanloom.oracles import ORACLES
    from spanloom.queries import QUERIES

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert set(ORACLES) <= set(QUERIES)
    key = lambda rows, columns: sorted(repr([r[c] for c in sorted(columns)]) for r in rows)
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF)
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
        assert sorted(got.columns) == sorted(columns), name
        assert key(got.collect(), columns) == key(want, columns), name


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for file in (root / "spanloom").rglob("*.py"):
        if "llm" not in file.parts:
            assert "spanloom.llm" not in file.read_text()
