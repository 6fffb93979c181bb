"""How often notes are read, and what meets by a join: plans, and results of odd inputs."""

import json
import random
import re

import pytest

from spanloom import queries as q
from spanloom.api import Conll, Engine, foreign_conll, foreign_errors, foreign_notes
from spanloom.functions import plain
from spanloom.operators import matching

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_offsets_are_checked_where_the_note_is(spark):
    assert "Join" not in plan_of(q.note_offsets(spark, SF))
    notes = spark.createDataFrame([(1, "<div><p>ab <b>cd</b></p><p>ab <b>cd</b></p></div>")], "note_id long, html string")
    run = Engine({"Document": {"xpath": "//p"}, "Annotation": {"B": {"xpath": "//b"}}}).parse(notes)
    rows = [(r["order_index"], r["note_start"], r["note_end"], r["text"], r["found"]) for r in run.placed.orderBy("order_index").collect()]
    assert rows == [(1, 0, 5, "ab cd", "ab cd"), (2, 3, 5, "cd", "cd"), (3, 0, 5, "ab cd", "ab cd"), (4, 9, 11, "cd", "cd")]
    assert [tuple(r) for r in run.offsets.orderBy("order_index").collect()] == [(1, *r[:3]) for r in rows]


def test_token_slices_are_compared_where_the_text_is(spark):
    assert "Join" not in plan_of(q.token_spans(spark, SF))


@pytest.mark.parametrize("query", [q.regex_mark_words, q.node_context, q.attribute_matches, q.scalar_matches])
def test_matches_come_out_of_one_pass(spark, query):
    assert plan_of(query(spark, SF)).count("MapInArrow") == 1


def test_matches_are_those_of_the_trees(spark):
    notes = spark.createDataFrame([(1, "<div><h1>t</h1><ul><li><a href='/x y'>one</a> two</li><li><a>b</a></li></ul></div>"), (2, "<p>only</p>"), (3, " ")], "note_id long, html string")
    run = Engine({"Annotation": {"L": {"xpath": "//li/a"}, "H": {"xpath": "//a/@href"}, "N": {"xpath": "count(//li)"}}, "Structure": {"xpath": "//h1 | //p"}}).parse(notes)
    rows = lambda df: sorted(map(str, df.collect()))
    for columns in (tuple(matching.COLUMNS), ("text",), ("tag", "prefix"), ("html", "same_as", "node")):
        assert rows(run.matches(*columns)) == rows(matching.matched_nodes(run.trees, run.plan).select("note_id", *columns))
    with pytest.raises(ValueError, match="nothing"):
        run.matches("nothing")


def test_item_rows_make_no_ids(spark):
    assert "md5" not in plan_of(q.item_rows(spark, SF))


def test_white_space_as_patterns_have_it():
    one = random.Random(4)
    for _ in range(20_000):
        t = "".join(one.choice(" \n\t\xa0\x1c\u2028\ra") for _ in range(one.randrange(12)))
        assert plain.collapse(t) == re.sub(r"\s+", " ", t).strip()
        assert plain.canonical(t) == re.sub(" *\n *", "\n", re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", t))).strip() == plain.kept(t)[0]


def test_foreign_notes_are_read_once_and_as_by_parts(spark):
    assert plan_of(q.foreign_conll_errors(spark, SF)).count("MapInArrow") == 3  # annotations, graphs, labels
    mark = lambda source, label, exact, kind="X": json.dumps({"@type": kind, "body": [{"purpose": "tagging", "value": label}], "target": {"source": source, "selector": {"type": "TextQuoteSelector", "exact": exact}}})
    given = [(1, 2, mark("a", "P", "b c")), (1, 1, mark("a", "Q", "b", "Y")), (1, 3, "{"), (1, 4, None), (1, 5, mark("none", "P", "x")), (1, 6, mark(None, "P", "x")), (2, 1, "[]"), (3, 1, mark("a", "P", "z")), (4, 1, mark("a", "P", "z"))]
    graph = lambda *r: json.dumps({"@graph": r})
    text = lambda i, t, kind="Doc": {"@id": i, "text": t, "@type": kind}
    graphs = [(1, graph(text("a", "old"), text("a", "a b c d"), {"@id": "a"}, text("e", ""))), (2, graph()), (3, "no"), (3, None), (4, graph(text("a", "z y", "Other"))), (5, "{}"), (6, graph(text("a", "z")))]
    given, graphs = spark.createDataFrame(given, "note_id long, seq int, json string"), spark.createDataFrame(graphs, "note_id long, json string")
    errors = {r[0]: r[1] for r in foreign_errors(given, graphs).groupBy("note_id").count().collect()}
    assert errors == {1: 2, 2: 1, 3: 2, 5: 1}
    for options in (Conll(), Conll(blacklist=["Y"]), Conll(whitelist=["P"]), Conll(type_whitelist=["Doc"])):
        texts = {r["note_id"]: r["text"] for r in foreign_conll(given, graphs, options).collect()}
        assert {r["note_id"]: (r["errors"], r["text"]) for r in foreign_notes(given, graphs, options).collect()} == {n: (errors.get(n, 0), texts.get(n)) for n in errors.keys() | texts}


def test_a_block_s_pairs_and_texts_as_made_at_once():
    import numpy as np
    import pyarrow as pa

    from spanloom.llm import alignment

    one = np.random.default_rng(3)
    linked = [one.integers(0, 50, n).astype("i4") for n in (7, 0, 40)]
    names, numbers = np.unique(np.concatenate(linked), return_inverse=True)
    made = alignment.numbered_pairs(linked, "i4")
    assert made[0].tolist() == names.tolist() and made[1].tolist() == numbers.tolist()
    assert [x.tolist() for x in alignment.numbered_pairs([], "i4")] == [[], []]
    values = [b"ab", None, b"", b"cdef", b"gh"]
    column = pa.chunked_array([pa.array(values[:2], pa.binary()), pa.array([b"zz", *values[2:]], pa.binary()).slice(1), pa.array([], pa.binary())])
    assert alignment.joined(column, np.dtype("u2")).tobytes() == b"abcdefgh"
    assert not len(alignment.joined(pa.chunked_array([], pa.binary()), np.dtype("u2")))
    codes, ends = np.array([0, 1, 1, 2]), np.array([0, 2, 2, 4])
    for together in (1, 2, 64):
        assert [x.as_py() for x in alignment.composed(pa.array(["x", "y|z", ""]), codes, ends, together)] == ["x;y|z", "", "y|z;"]
