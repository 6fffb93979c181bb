"""Operators 11 to 13 against brute force: both tokenizers on whole texts, pages of known parts, and counts of all n-grams."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from spanloom.llm import alignment, collocations, main_text

ODD = ["a", "b", "the", "ing", " ", "  ", "\n", "\n ", "\t", "▁", " ", "é", "ß", "日本", "<s>", "<|endoftext|>", "'s", "1", "23", "...", "\x00", "\x1c", "\x85", " ", ".", "🎉", " x"]


def brute_alignment(rows):
    a, a_bytes, _, b, b_bytes, _ = alignment.compile(alignment.A_NAME, alignment.B_NAME)
    per, held = [], Counter()
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        a_ids = a.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        if not text or b"".join(a_bytes[i] for i in a_ids) != whole or b"".join(b_bytes[i] for i in b_ids) != whole:
            per.append((key, None))
            continue

        def ends(ids, sizes):
            out, at = [], 0
            for i in ids:
                at += len(sizes[i])
                out.append(at)
            return out

        ends_a, ends_b = ends(a_ids, a_bytes), ends(b_ids, b_bytes)
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a_ids, ends_a, strict=True) if last < e <= cut], [i for i, e in zip(b_ids, ends_b, strict=True) if last < e <= cut]))
            last = cut
        links = [(x, y) for g, h in groups for x in g for y in h]
        held.update(set(links))
        per.append((key, (len(a_ids), len(b_ids), groups, links)))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for key, found in per:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((key, n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def by_all(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_alignment_equals_whole_texts(spark):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice(ODD) for _ in range(draw.randrange(14)))) for i in range(800)]
    rows += [(None, None), (5, ""), (6, " "), (7, "   "), (8, "the the"), (8, "the the"), (9, "x" * 3000), (10, " " * 3000 + "a"), (11, "a" + "\n" * 900 + " b")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block long, segment string")
    got = alignment.align_corpus(docs.repartition(5), "doc_id", block=3000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_all(got.collect()) == by_all(brute_alignment(rows))


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id").collect() == []


def test_segments_join_to_the_text():
    draw = random.Random(2)
    for _ in range(2000):
        text = "".join(draw.choice(ODD) for _ in range(draw.randrange(12)))
        assert "".join(" " + s for s in alignment.segments(text)) == (" " + text if text else "")


def test_larger_vocabularies_take_wider_streams():
    sizes = [1] * 70_000
    for made in (alignment.Groups([1, 2, 3], [1, 2, 3]), alignment.Groups(sizes, sizes)):
        stream = made.align([[0, 1], [2]] if made.kind == "u2" else [[69_999, 1], [2]], [[1, 0], [2]] if made.kind == "u2" else [[1, 0], [2]])
        import numpy as np

        flat = np.frombuffer(b"".join(stream), made.kind)
        edges = np.concatenate([[0], np.cumsum([len(x) // made.kind.itemsize for x in stream])])
        assert made.as_text(flat, edges) == (["0,1|1,0", "2|2"] if made.kind == "u2" else ["69999|1;1|0", "2|2"])
        n_a, n_b, n_groups, first, pairs = made.links(flat, edges)
        assert (n_a.tolist(), n_b.tolist(), n_groups.tolist()) == ([2, 1], [2, 1], [1, 1] if made.kind == "u2" else [2, 1])
        assert first.tolist() == [0, len(pairs) - 1, len(pairs)]
        assert pairs[-1] == 2 * made.wide + 2


def sql_phrases(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["lang", "text"]))
    return sorted(con.sql(collocations.OP13_SQL).fetchall())


@pytest.mark.parametrize(("block", "hot"), [(1500, 1 << 18), (1500, 20), (1 << 25, 1)])
def test_phrases_equal_all_counts(spark, block, hot):
    draw = random.Random(3)
    words = [*"abcdefgh", "A", "B.", "c,", "d\n", " ", "é", "f!", "\x0bg", "\t"]
    rows = [(draw.choice(["en", "de", None, "und"]), " ".join(draw.choice(words) for _ in range(draw.randrange(40)))) for _ in range(400)]
    rows += [("en", None), ("en", ""), ("x", "z z z z y z z z z z z z")] + [("x", "z z z z y z z z z z z z")] * 4
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n long, id long").repartition(4)
    got = sorted(tuple(r) for r in collocations.phrases(docs, block=block, hot=hot).collect())
    assert got
    assert got == sql_phrases(rows)


def test_phrases_of_empty_and_sparse_tables(spark):
    assert collocations.phrases(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.phrases(spark.createDataFrame([("en", "one two three"), ("en", None)], "lang string, text string")).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 9_000_000_000_001, 9_000_000_000_003, 9_100_000_000_000
    row = spark.range(1).select(collocations.score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_fragments_own_each_ngram_once():
    import numpy as np

    draw = random.Random(4)
    for _ in range(300):
        codes = np.array([draw.randrange(-1, 4) for _ in range(draw.randrange(12))], "i4")
        rank = np.array([2, 0, -1, 1, -1])
        rows, counts = collocations.counted(collocations.cut_fragments(codes, rank), 3)
        met: Counter = Counter()
        for (p, l1, r1, l2, r2), n in zip(rows.T.tolist(), counts.tolist(), strict=True):
            for gram in ((l1, p), (p, r1), (l2, l1, p), (l1, p, r1), (p, r1, r2)):
                if min(gram) >= 0:
                    met[gram] += n
        words = [int(rank[c]) for c in codes]
        assert met == Counter(tuple(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1) if min(words[i : i + k]) >= 0)


def texts_of(spark, rows, **more):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {r["page_id"]: r["text"] for r in main_text.main_text(pages, "page_id", "url", "html", **more).collect()}


def test_main_text_of_parts_by_name(spark):
    html = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><article>no";</script></head><body class="with-sidebar">
    <header>no</header><nav><ul><li><a href=/>no</a></ul></nav><div class="cookie-notice">no</div>
    <main><article><header><h1>A &amp; B</h1></header><p>One <b>bold</b>\n\t and<br>two&nbsp;x &am &lt;</p><div class="ad">no</div>
    <ul><li>three<li>four <i>4</i></ul><table><tr><td>five<td>six</table><blockquote><p>seven</blockquote><aside>no</aside>
    <form>no<input value=no></form><section id=comments><article><p>no</p></article></section>eight</article></main>
    <div id="sidebar">no</div><div class="cookieNotice">no</div><div class="top ads_2">no</div><footer>no</footer><noscript>no</noscript><p>no</p></body></html>"""
    assert texts_of(spark, [(1, "http://a/1", html)]) == {1: "A & B\nOne bold and two x &am <\nthree\nfour 4\nfive\nsix\nseven\neight"}


def test_words_of_classes():
    for own in ("ad1", "box-ads", "cookieNotice", "SideBar", "reader_comments", "x share"):
        assert main_text.kind_of("div", f' class="{own}"', None) == (True, False), own
    for own in ("with-sidebar", "hasComments", "content", "adage header-less", "shadow", "loading"):
        assert main_text.kind_of("div", f" id='{own}'", None) == (False, False), own


def test_recurring_subtrees_go(spark):
    page = lambda i, host: (i, f"https://user@{host}:8080/{i}", f"<body><div><span>Home</span> <a href=/{i}>About</a></div><div><p>Text {i} of some length.</p></div><div><p>All rights reserved by us.</p></div>")
    got = texts_of(spark, [page(i, "Big.org" if i % 2 else "big.org") for i in range(8)] + [page(100 + i, "few.org") for i in range(3)] + [(200, None, page(0, "x")[2])])
    assert all(got[i] == f"Text {i} of some length." for i in range(8))
    assert all(got[100 + i] == f"Home About\nText {100 + i} of some length.\nAll rights reserved by us." for i in range(3))
    assert got[200].startswith("Home About\n")


def test_copied_articles_stay(spark):
    copy = "<article><h1>Same</h1><div><p>The same article on all of these pages.</p></div></article>"
    rows = [(i, "http://h/x", f"<nav><a>{i}</a></nav>{copy}<div><a>all</a> <a>tags</a></div>") for i in range(9)]
    rows += [(20 + i, "http://g/x", f"<p>A passage that a third of pages share.</p><p>Own {i}</p>" if i < 7 else f"<p>Own {i}</p>") for i in range(21)]
    got = texts_of(spark, rows)
    assert all(got[i] == "Same\nThe same article on all of these pages." for i in range(9))
    assert all(got[20 + i] == f"A passage that a third of pages share.\nOwn {i}" for i in range(7))


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</p>" * 10
    rows = [(1, None, None), (2, "", ""), (3, "u", " \n "), (4, "//h", "a<b>b<p>c<!-- x"), (5, "//h", "<p>x<p>y</div>z<3 <"), (6, "//h", deep), (7, "//h", "<p>q <a title='>'>l</a> r<textarea><p>no</textarea></p><script>no"), (7, "//h", "<td>t1<td>t2")]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(1, ""), (2, ""), (3, ""), (4, "ab\nc"), (5, "x\nyz<3 <"), (6, "deep"), (7, "q l r"), (7, "t1\nt2")]


def test_no_pages(spark):
    assert texts_of(spark, []) == {}


def test_given_pages_keep_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in main_text.op12_main_text(spark, "/root/testdata/sf0.001").collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in blocks if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))
