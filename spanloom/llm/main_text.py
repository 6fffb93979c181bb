"""Main text of web pages: subtrees that recur across a site's pages are found by hash and deleted.

A page is read in an Arrow batch by a tolerant reader of tags; it becomes blocks of text, and the hashes of the
elements around them. An element's hash covers its tag, its text and its children, not its attributes, so the
same menu is the same subtree wherever links to the present page are marked. Spark counts, per host, the pages that
hold a subtree, and joins the counts back to pages; a page then loses every block that lies in a subtree which recurs.
The counts are salted on the way back, as a host, and so its menu, may hold a third of all pages.

What recurs: a subtree without running text on MANY pages of its host, and one with running text (paragraphs, most of
whose letters aren't links) on MANY pages and more than half of the host's, because articles and their passages are
copied too. Where a page marks its article (article, main, role=main, itemprop=articleBody, but no comment), the text
is taken from there, and neither the article as a whole nor a paragraph of it counts as a template, only sections,
lists, tables and the like in it; these recur in MANY different articles and more than half of the host's, copies of an
article counting once. A page that would lose all text of its article keeps that.

What can't be told by recurrence, on a host of few pages or where it differs from page to page, goes by what it is: menus,
sidebars, forms, scripts, styles, page headers and footers by their tags or roles, and adverts, notices, sharing bars
and reader comments by words of their class or id, listed below.

Defined results: null and blank html give an empty text; a page whose url has no host has no site and is read by its
own marks alone; repeated rows count as pages of their own and each get their text; unclosed and misnested tags end
where HTML lets them; a comment or tag that never ends takes the rest of the page; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, stage, table, text_of

MANY, SALTS = 5, 16
#: Fixed values, by HTML: elements without content, with content that is no markup, and what is no part of a text.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that start a line of their own.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Blocks of running text; others are containers.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th figcaption caption address summary".split())
#: Never main text, by tag, by role, and by a word of class or id.
BOILERPLATE = frozenset("nav aside form script style noscript template button select option textarea input label fieldset iframe noembed noframes object svg canvas audio video head title dialog menu".split())
PAGE_EDGES = frozenset(("header", "footer"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle banner banners sponsor sponsored promo promos promotion comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets share sharing social related recommended recommendations popup modal overlay toolbar pagination pager footer masthead copyright adbox cookiebar".split()
)
#: A name with one of these says what a page has around its text, and not what the element is.
AROUND = frozenset("has have with without no not hide layout".split())
_WORD, _PART = re.compile("[a-z]+"), re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Elements that a start tag ends when they are open, up to the nearest element that holds them together.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Open paragraphs end before these, but don't reach into these.
ENDS_P = BLOCK - frozenset("body html option select button td th tr tbody thead tfoot caption legend".split())
P_SCOPE = frozenset("table td th caption button object template body html".split())
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    tag: str
    boilerplate: bool
    #: The article, or within it.
    root: bool
    inside: bool
    begin: int
    digest: bytearray = field(default_factory=bytearray)
    letters: int = 0
    linked: int = 0
    prose: bool = False
    holds_root: bool = False


@dataclass(slots=True)
class Page:
    """blocks: text, and whether it is boilerplate and in the article; marks: of elements that may recur the hash, whether they are running text and in the article, and the blocks from .. to; article: its hash."""

    blocks: list[tuple[str, bool, bool]]
    marks: list[tuple[int, bool, bool, int, int]]
    article: int


def kind_of(tag: str, attrs: str, around: Element | None) -> tuple[bool, bool]:
    """(boilerplate, article) of an element by its tag, role, class and id."""
    inside = around is not None and around.inside
    boilerplate = tag in BOILERPLATE or tag in PAGE_EDGES and not inside
    root = tag in ("article", "main")
    if attrs:
        for m in _ATTRIBUTE.finditer(attrs):
            name, plain = m[1].lower(), m[2] or m[3] or m[4] or ""
            value = plain.lower()
            if name == "role":
                boilerplate |= value in ROLES
                root |= value in ("main", "article")
            elif name == "itemprop":
                root |= value == "articlebody"
            elif tag not in ("html", "body"):
                names = [{*_WORD.findall(x.lower()), *map(str.lower, _PART.findall(x))} for x in plain.split()]
                boilerplate |= any(not WORDS.isdisjoint(words) and AROUND.isdisjoint(words) for words in names)
    return boilerplate, root and not boilerplate


def read(markup: str) -> Page:
    """One page. Iterative, as markup can be nested deeply."""
    open_: list[Element] = [Element("", False, False, False, 0)]
    blocks: list[tuple[str, bool, bool]] = []
    marks: list[tuple[int, bool, bool, int, int]] = []
    article = blake2b(digest_size=8)
    line: list[str] = []
    count: Counter[str] = Counter()

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            top = open_[-1]
            blocks.append((text, top.boilerplate, top.inside))

    def close() -> None:
        if open_[-1].tag in BLOCK:
            flush()
        e = open_.pop()
        count[e.tag] -= 1
        digest = blake2b(e.tag.encode() + (b"\0" if e.inside else b"\3") + e.digest, digest_size=8).digest()
        parent = open_[-1]
        parent.digest += b"\1" + digest
        parent.letters += e.letters
        parent.linked += e.letters if e.tag == "a" else e.linked
        parent.prose |= e.prose or e.tag in PROSE and not e.boilerplate and 2 * e.linked < e.letters
        parent.holds_root |= e.holds_root or e.root
        may = e.tag in BLOCK and e.letters and not e.root and not e.holds_root and not (e.inside and e.tag in PROSE) and e.tag not in ("html", "body")
        if may and e.begin < len(blocks):
            own = e.prose or e.tag in PROSE and 2 * e.linked < e.letters
            marks.append((int.from_bytes(digest, "big", signed=True), own and not e.boilerplate, e.inside, e.begin, len(blocks)))
        if e.root:
            article.update(digest)

    def unwind(tags: Container[str], scope: Container[str] = ()) -> bool:
        """Ends the innermost open element of these tags, with all in it; none beyond one of the scope."""
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in tags:
                while len(open_) > i:
                    close()
                return True
            if open_[i].tag in scope:
                break
        return False

    def text(raw: str) -> None:
        if not raw:
            return
        top = open_[-1]
        plain = html.unescape(raw) if "&" in raw else raw
        line.append(plain)
        words = " ".join(plain.split())
        if words:
            top.digest += b"\2" + words.encode("utf-8", "replace")
            top.letters += len(words)

    at, end = 0, len(markup)
    while at < end:
        begin = markup.find("<", at)
        m = _TAG.match(markup, begin) if begin >= 0 else None
        if begin < 0:
            text(markup[at:])
            break
        if m is None:
            text(markup[at : begin + 1])
            at = begin + 1
            continue
        text(markup[at:begin])
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            if tag in ("html", "body"):
                continue
            if not (count[tag] and unwind((tag,))) and tag == "p":
                flush()
        elif m["start"]:
            tag, attrs = m["start"].lower(), m["attrs"]
            if tag in ENDS_P and count["p"]:
                unwind(("p",), P_SCOPE)
            if tag in ENDS:
                ended, scope = ENDS[tag]
                if any(count[x] for x in ended):
                    unwind(ended, scope)
            if tag in BLOCK:
                flush()
            if tag in VOID:
                line.append(" " if tag in ("br", "wbr") else "")
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(markup, at)
                at = stop.end() if stop else end
                continue
            around = open_[-1]
            boilerplate, root = kind_of(tag, attrs, around)
            inside = (around.inside or root) and not (around.boilerplate or boilerplate)
            count[tag] += 1
            open_.append(Element(tag, around.boilerplate or boilerplate, root and not around.boilerplate, inside, len(blocks)))
    while len(open_) > 1:
        close()
    flush()
    return Page(blocks, marks, int.from_bytes(article.digest(), "big", signed=True))


MARKS = "host string, key long, article long, marks array<struct<hash:bigint,prose:boolean,inside:boolean>>"
_MARKS = pa.list_(pa.struct([("hash", pa.int64()), ("prose", pa.bool_()), ("inside", pa.bool_())]))


def read_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key, html to MARKS."""
    for batch in batches:
        pages = [read(m) for m in batch.column(2).to_pylist()]
        marks = [[{"hash": h, "prose": p, "inside": i} for h, p, i in dict.fromkeys(m[:3] for m in page.marks)] for page in pages]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([p.article for p in pages], pa.int64()), pa.array(marks, _MARKS)], ["host", "key", "article", "marks"])


def text_without(page: Page, gone: set[int]) -> str:
    """The text of a page without the subtrees of these hashes."""
    article = any(inside for _, _, inside in page.blocks)
    own = [not boilerplate and (inside or not article) for _, boilerplate, inside in page.blocks]
    left = own.copy()
    for digest, _, _, first, behind in page.marks:
        if digest in gone:
            left[first:behind] = [False] * (behind - first)
    kept = own if article and not any(left) else left
    return "\n".join(text for (text, _, _), keep in zip(page.blocks, kept, strict=True) if keep)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, packed html, gone (hashes, or null) to page_id, url, text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = [text_without(read(unpack(m).decode()), set(g or ())) for m, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def packed(markup: pa.Array) -> pa.Array:
    """Pages as they move: one zstandard frame each."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack(x) for x in markup.cast(pa.binary()).to_pylist()], pa.binary())


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(url.cast("string")), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(host != "", host)


def templates(pages: DataFrame, many: int = MANY) -> DataFrame:
    """host, hash, n of subtrees on that many pages of their host, those in an article in so many different articles; hash 0 has each such host's pages, hash 1 its articles."""
    sited = pages.where("host is not null")
    hashes = lambda inside: F.array_distinct(F.transform(F.filter("marks", lambda m: m["inside"] == inside), lambda m: m["hash"]))
    each = lambda inside: F.explode(F.concat(F.array(F.lit(int(inside)).cast("long")), hashes(inside))).alias("hash")
    on_pages = sited.select("host", each(False)).groupBy("host", "hash").agg(F.count("*").alias("n"))
    in_articles = sited.select("host", "article", each(True)).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    return on_pages.unionByName(in_articles).where(F.col("n") >= many)


def recurring(marks: DataFrame, many: int = MANY, salts: int = SALTS) -> DataFrame:
    """host, key, gone: of each page the hashes of its subtrees that recur."""
    counts = templates(marks, many).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pages = marks.where("host is not null").dropDuplicates(["host", "key"]).select("host", "key", "marks", F.pmod("key", F.lit(salts)).cast("int").alias("salt"))
    asked = F.concat(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), F.array_distinct("marks.hash"))
    # Of each page at most its own subtrees.
    met = pages.select("host", "key", "salt", F.explode(asked).alias("hash")).join(counts, ["host", "hash", "salt"])
    met = met.groupBy("host", "key").agg(F.map_from_entries(F.collect_list(F.struct("hash", "n"))).alias("met"))
    of_host = lambda m: F.col("met")[F.when(m["inside"], F.lit(1)).otherwise(F.lit(0)).cast("long")]
    recurs = lambda m: F.col("met")[m["hash"]].isNotNull() & (~m["prose"] & ~m["inside"] | (2 * F.col("met")[m["hash"]] > of_host(m)))
    return pages.join(met, ["host", "key"]).select("host", "key", F.transform(F.filter("marks", recurs), lambda m: m["hash"]).alias("gone"))


def main_text(pages: DataFrame, page: str, url: str, markup: str, many: int = MANY, salts: int = SALTS) -> DataFrame:
    """page, url, text of every row. Pages are read twice: only the hashes of their subtrees are kept in between, by host and a hash of the page."""
    bound_batches(pages.sparkSession)
    html_ = text_of(pages, markup)
    rows = pages.select(pages[page].alias("page_id"), pages[url].alias("url"), host_of(pages[url]).alias("host"), F.xxhash64(html_).alias("key"), html_.alias("html"))
    kinds = dict(rows.dtypes)
    gone = recurring(stage(rows.select("host", "key", "html").mapInArrow(read_marks, MARKS), "pages-marks"), many, salts)
    moved = rows.select("page_id", "url", "host", "key", F.arrow_udf(packed, "binary")("html").alias("packed")).join(gone, ["host", "key"], "left")
    out = moved.select("page_id", "url", "packed", "gone").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.select(F.col("page_id").alias(page), F.col("url").alias(url), "text")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page from its whole html."""
    out = main_text(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return out.withColumn("n_chars", F.length("text").cast("long"))
