"""DuckDB SQL for the queries of spanloom.queries that regular markup lets SQL express.

All of it cuts `pages` with regular expressions: heads, comments and leads have one form there. Paragraphs end at the
next block tag; texts resolve the entities that the pages use.
"""

from __future__ import annotations


def _decoded(sql: str) -> str:
    """Entities resolved."""
    for name, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        sql = f"replace({sql}, '{name}', '{char}')"
    return sql


def _text(sql: str) -> str:
    """Entities resolved, then blanks and line feeds canonical, as in spanloom.functions.text.canonical."""
    sql = _decoded(sql)
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({sql}, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), ' *\n *', E'\n', 'g'), E' \n\t\r')"


_BODY = r"regexp_replace(regexp_replace(html, '(?s)^.*</head>', ''), '(?s)<!--.*?-->', '', 'g')"
_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
#: Paragraphs of each page: k counts from 1, lead if it holds a b.
_P = rf"""a AS (SELECT page_id AS note_id, {_ARTICLE} AS a FROM pages),
l AS (SELECT note_id, regexp_extract_all(a, '(?s)<p>((?:<b>)?[^<]*)(?:<br>|</p>)', 1) AS l FROM a),
q AS (SELECT note_id, generate_subscripts(l, 1) AS k, unnest(l) AS raw FROM l),
p AS (SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY k) AS k, starts_with(raw, '<b>') AS lead, {_text("regexp_replace(raw, '^<b>', '')")} AS t FROM q WHERE length(trim(regexp_replace(raw, '^<b>', ''))) > 0)"""
_P1 = f"WITH {_P} "
_LINKS = """len(regexp_extract_all(html, '<li><a '))"""
_STRIPPED = """regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>([^<]*)</h1>', 1), '&amp;', '', 'g'), '[aeiou]+', '', 'g'), '[%$#*&]+', '', 'g')"""


def _one(tag: str, column: str = "html") -> str:
    return _text(f"regexp_extract({column}, '(?s)<{tag}[^>]*>([^<]*)</{tag}>', 1)")




def _note(html: str) -> str:
    """Text of some markup: a lead's paragraph ends where the next one, or the article's end, follows its break."""
    marked = rf"regexp_replace({html}, '<br>(<p>|</article>)', E'\n\n\\1', 'g')"
    return _text(rf"regexp_replace(regexp_replace(regexp_replace({marked}, '<br>', E'\n', 'g'), '</(?:li|div|h1|p|article)>', E'\n', 'g'), '<[^>]*>', '', 'g')")


#: Headings of three levels as spanloom.queries makes them: g and i give their order, last_a is the last link.
_HEADS = rf"""h AS (SELECT page_id AS note_id, {_one('h1')} AS h1, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)<', 1) AS a, regexp_extract_all(html, '<p><b>([^<]*)<', 1) AS b, regexp_extract_all(html, '<div class="ad">([^<]*)<', 1) AS d FROM pages),
r AS (SELECT note_id, h1, a[-1] AS last_a, 1 AS level, [h1] AS l, 1 AS g FROM h UNION ALL SELECT note_id, h1, a[-1], 2, a, 2 FROM h UNION ALL SELECT note_id, h1, a[-1], 3, b, 3 FROM h UNION ALL SELECT note_id, h1, a[-1], 2, d, 4 FROM h),
u AS (SELECT note_id, h1, last_a, level, g, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM r), t AS (SELECT note_id, h1, {_text("last_a")} AS last_a, level, g, i, {_text("x")} AS x FROM u)"""
_TOKENS = r"regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"

ORACLES: dict[str, str] = {
    "note_scan": "SELECT page_id AS note_id, url AS note_uri, length(html)::INT AS n_chars FROM pages",
    "note_text": f"SELECT page_id AS note_id, {_note(_BODY)} AS text FROM pages",
    "document_items": _P1 + "SELECT note_id, k::INT AS order_index, t AS text FROM p",
    "structure_items": f"SELECT page_id AS note_id, 1 AS k, {_one('h1')} AS text, 1 AS level FROM pages",
    "locator_items": f"SELECT page_id AS note_id, 1 AS k, {_one('title')} AS text FROM pages",
    "quotation_items": "SELECT page_id AS note_id, 1 AS k, 0 AS doc FROM pages",
    "annotation_items": _P1 + f""", c AS (SELECT page_id AS note_id, {_LINKS} AS links, (SELECT count(*) FROM p WHERE p.note_id = page_id AND lead)::INT AS leads FROM pages)
SELECT note_id, k::INT AS k, CASE WHEN k <= links THEN 'Link' WHEN k = links + 1 THEN 'Ad' ELSE 'Lead,Key' END AS types FROM (SELECT note_id, links, unnest(range(1, links + leads + 2)) AS k FROM c)""",
    "node_counts_by_tag": rf"""WITH b AS (SELECT page_id, {_BODY} AS b FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(b, '<(p|b|li|a|h1|br)[ >]', 1)) AS tag FROM b)
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS notes FROM t GROUP BY tag""",
    "link_same_as": rf"""WITH l AS (SELECT page_id AS note_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)<', 1) AS x FROM pages),
u AS (SELECT note_id, generate_subscripts(h, 1) AS k, unnest(h) AS h, unnest(x) AS x FROM l WHERE len(h) > 0)
SELECT note_id, k::INT AS k, {_text("x")} AS text, {_text("h")} AS same_as FROM u""",
    "ignore_regex_text": f"SELECT page_id AS note_id, 1 AS order_index, {_text(_STRIPPED)} AS text FROM pages",
    "regex_mark_items": f"""WITH h AS (SELECT page_id AS note_id, {_one("h1")} AS t FROM pages), m AS (SELECT note_id, t, regexp_extract_all(t, '\\b[Tt]h[\\p{{L}}\\p{{N}}_]*') AS m FROM h)
SELECT note_id, generate_subscripts(m, 1)::INT AS k, unnest(m) AS text FROM m WHERE NOT (len(m) = 1 AND m[1] = t)""",
    "current_state": _P1 + f"SELECT p.note_id, p.k::INT AS k, {_one('h1')} AS structure_text, {_one('title')} AS locator_text FROM p JOIN pages ON pages.page_id = p.note_id",
    "regex_mark_words": rf"""WITH t AS (SELECT page_id AS note_id, unnest(regexp_extract_all({_BODY}, '>([^<]+)', 1)) AS x FROM pages), w AS (SELECT note_id, x, unnest(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+')) AS text FROM t)
SELECT note_id, text, count(*) AS n FROM w WHERE regexp_matches(text, '^[Tt]h') AND trim(x) <> text GROUP BY ALL""",
    "heading_levels": rf"""WITH {_HEADS}
SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY g, i)::INT AS order_index, level, x AS text, CASE level WHEN 2 THEN h1 WHEN 3 THEN coalesce(last_a, h1) END AS above FROM t""",
    "jsonld_items": _P1 + "SELECT note_id, k::INT AS order_index, t AS text, 'Doc' AS type, true AS of_note FROM p",
    "wadm_items": _P1 + "SELECT note_id, k::INT AS order_index, t AS exact, length(t)::INT AS span, '//p' AS xpath, 'Doc' AS tag FROM p",
    "conll_lines": _P1 + f""", w AS (SELECT note_id, k, {_TOKENS} AS w FROM p WHERE lead), u AS (SELECT note_id, k, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM w)
SELECT note_id, (row_number() OVER (PARTITION BY note_id ORDER BY k, i) - 1)::INT AS line, token, CASE WHEN i = 1 THEN 'B-Key' ELSE 'I-Key' END AS label FROM u""",
    "rdfa_types": rf"""WITH {_P}, c AS (SELECT note_id, count(*) AS n FROM p GROUP BY 1), m AS (SELECT note_id, count(*) AS n FROM p WHERE lead GROUP BY 1)
SELECT note_id, 'p' AS tag, 'Doc' AS types, n FROM c UNION ALL SELECT note_id, 'b', 'Lead Key', n FROM m""",
    "tei_paragraphs": _P1 + "SELECT note_id, k::INT AS order_index, t AS text FROM p",
    "structure_parent": f"SELECT page_id AS note_id, {_one('h1')} AS text, 1 AS level, true AS top FROM pages",
    "container_of": _P1 + f""", n AS (SELECT note_id, count(*) AS p, count(*) FILTER (lead) AS leads FROM p GROUP BY 1), c AS (SELECT page_id AS note_id, {_LINKS} + 1 AS free FROM pages)
SELECT note_id, cls, container, n FROM (SELECT note_id, unnest([{{'cls': 'Locator', 'container': 'Note', 'n': 1}}, {{'cls': 'Quotation', 'container': 'Note', 'n': 1}}, {{'cls': 'Structure', 'container': 'Quotation', 'n': 1}},
  {{'cls': 'Document', 'container': 'Quotation', 'n': p}}, {{'cls': 'Annotation', 'container': 'Note', 'n': free}}, {{'cls': 'Annotation', 'container': 'Document', 'n': leads}}], recursive := true) FROM c JOIN n USING (note_id)) WHERE n > 0""",
    "offset_alignment": _P1 + f""", c AS (SELECT count(*) AS n, sum({_LINKS} + 1) AS free FROM pages), d AS (SELECT count(*) AS p, count(*) FILTER (lead) AS leads FROM p)
SELECT cls, k::BIGINT AS n, k::BIGINT AS aligned FROM (SELECT unnest([{{'cls': 'Locator', 'k': n}}, {{'cls': 'Quotation', 'k': n}}, {{'cls': 'Structure', 'k': n}}, {{'cls': 'Document', 'k': p}}, {{'cls': 'Annotation', 'k': free + leads}}], recursive := true) FROM c, d)""",
    "context_window": rf"""WITH {_P}, n AS (SELECT page_id AS note_id, {_note(_BODY)} AS note, {_note("regexp_extract(html, '(?s)<article>.*</article>')")} AS art FROM pages),
o AS (SELECT note_id, k, note, instr(note, art) + instr(art, t) - 2 AS s, length(t) AS len FROM p JOIN n USING (note_id))
SELECT note_id, k::INT AS order_index, s::INT AS start, (s + len)::INT AS end, note[greatest(s - 30, 0) + 1:s] AS prefix, note[s + len + 1:s + len + 30] AS suffix FROM o""",
    "dropped_matches": "SELECT 1 AS xp, count(*) AS n FROM pages",
    "split_fragments": f"""WITH h AS (SELECT page_id AS note_id, {_one('h1')} AS t FROM pages), w AS (SELECT note_id, list_filter(string_split(t, ' '), lambda x: trim(x) <> '') AS w FROM h)
SELECT note_id, i::INT AS order_index, w[i] AS text, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0)::INT AS at FROM (SELECT note_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)""",
    "find_fragments": f"""WITH h AS (SELECT page_id AS note_id, {_one('h1')} AS t FROM pages), w AS (SELECT note_id, t, regexp_extract_all(t, '[a-z]+') AS w FROM h), f AS (SELECT note_id, CASE WHEN len(w) = 0 THEN [t] ELSE w END AS w FROM w)
SELECT note_id, generate_subscripts(w, 1)::INT AS order_index, unnest(w) AS text FROM f""",
    "element_html": r"SELECT page_id AS note_id, h AS html, CASE WHEN length(h) > 12 THEN rtrim(h[1:12]) || '…' ELSE h END AS short FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>[^<]*</h1>'), '\s+', ' ', 'g')) AS h FROM pages)",
    "node_context": rf"""WITH c AS (SELECT page_id AS note_id, {_LINKS} AS links, {_note("regexp_extract(html, '(?s)<article>.*</article>')")} AS art, {_one('h1')} AS h FROM pages)
SELECT note_id, 'a' AS tag, links::BIGINT AS n, 0 AS prefix, 0 AS suffix FROM c UNION ALL SELECT note_id, 'h1', 1, 0, least(30, length(art) - length(h))::INT FROM c""",
    "tokens": _P1 + f"""SELECT note_id, k::INT AS source, (generate_subscripts(w, 1) - 1)::INT AS tok_ix, unnest(w) AS token FROM (SELECT note_id, k, {_TOKENS} AS w FROM p)""",
    "token_spans": _P1 + f"SELECT note_id, sum(len({_TOKENS}))::BIGINT AS n, sum(len({_TOKENS}))::BIGINT AS exact FROM p GROUP BY note_id",
    "bio_labels": _P1 + f""", w AS (SELECT note_id, len({_TOKENS}) AS n FROM p WHERE lead)
SELECT note_id, 'B-Key' AS label, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT note_id, 'I-Key', sum(n - 1)::BIGINT FROM w GROUP BY 1 HAVING sum(n - 1) > 0""",
    "bio_span_cap": _P1 + f""", w AS (SELECT note_id, len({_TOKENS}) AS n FROM p WHERE lead), x AS (SELECT note_id, n, n <= 5 AS fits FROM w)
SELECT note_id, 'B-Key' AS label, count(*) AS n FROM x WHERE fits GROUP BY 1 UNION ALL SELECT note_id, 'I-Key', sum(n - 1)::BIGINT FROM x WHERE fits GROUP BY 1 HAVING sum(n - 1) > 0 UNION ALL SELECT note_id, 'O', sum(n)::BIGINT FROM x WHERE NOT fits GROUP BY 1""",
    "type_whitelist": "SELECT page_id AS note_id, '' AS label, 0::BIGINT AS n FROM pages WHERE false",
    "label_blacklist": _P1 + f""", w AS (SELECT note_id, len({_TOKENS}) AS n FROM p WHERE lead)
SELECT note_id, 'B-Lead' AS label, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT note_id, 'I-Lead', sum(n - 1)::BIGINT FROM w GROUP BY 1 HAVING sum(n - 1) > 0""",
    "wadm_selectors": _P1 + """SELECT note_id, k::INT AS order_index, x.s AS type, CASE WHEN x.i = 1 THEN t ELSE '' END AS exact, CASE WHEN x.i = 2 THEN length(t)::INT ELSE -1 END AS span, CASE WHEN x.i = 3 THEN '//p' ELSE '' END AS value FROM p, (VALUES (1, 'TextQuoteSelector'), (2, 'TextPositionSelector'), (3, 'XPathSelector')) x(i, s)""",
    "wadm_bodies": _P1 + """, i AS (SELECT note_id, unnest(CASE WHEN lead THEN [NULL, 'Doc', NULL, 'Lead', 'Key'] ELSE [NULL, 'Doc'] END) AS value FROM p)
SELECT note_id, CASE WHEN value IS NULL THEN 'SpecificResource' ELSE 'TextualBody' END AS type, CASE WHEN value IS NULL THEN 'identifying' ELSE 'tagging' END AS purpose, value, count(*) AS n FROM i GROUP BY note_id, value""",
    "wadm_scope": _P1 + f""", n AS (SELECT note_id, count(*) + count(*) FILTER (lead) AS deep FROM p GROUP BY 1), c AS (SELECT page_id AS note_id, {_LINKS} + 3 AS two FROM pages)
SELECT note_id, 'identifying' AS motivation, scopes, n FROM (SELECT note_id, unnest([{{'scopes': 1, 'n': 1}}, {{'scopes': 2, 'n': two}}, {{'scopes': 3, 'n': deep}}], recursive := true) FROM c JOIN n USING (note_id))""",
    "parsed_nodes_items": _P1 + "SELECT note_id, k::INT AS order_index, t AS text FROM p",
    "attribute_matches": rf"""WITH l AS (SELECT page_id AS note_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h FROM pages), u AS (SELECT note_id, generate_subscripts(h, 1) AS k, unnest(h) AS h FROM l)
SELECT note_id, k::INT AS k, {_text(_text("h"))} AS text, 'a' AS tag, true AS placeless FROM u""",
    "scalar_matches": f"""SELECT page_id AS note_id, unnest([0, 1]) AS xp, unnest([{_one('title')}, trim({_LINKS} || '/1 ' || {_one('h1')})]) AS text FROM pages""",
    "scalar_items": f"SELECT page_id AS note_id, {_one('title')} AS text, 0 AS doc, 0 AS start, true AS placeless FROM pages",
    "foreign_conll_errors": _P1 + f""", w AS (SELECT note_id, k, len({_TOKENS}) AS n FROM p), x AS (SELECT note_id, max(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS good FROM p GROUP BY 1),
f AS (SELECT page_id AS note_id, len({_TOKENS.replace("(t,", "(note,")}) AS n FROM (SELECT page_id, {_note(_BODY)} AS note FROM pages))
SELECT w.note_id, count(*) FILTER (k % 2 = 1) AS errors, (CASE WHEN any_value(good) = 1 THEN any_value(f.n) ELSE 0 END)::INT AS tokens, any_value(good) = 1 AS labelled FROM w JOIN x USING (note_id) JOIN f USING (note_id) GROUP BY w.note_id""",
    "tei_divisions": rf"""WITH {_HEADS} SELECT note_id, CASE WHEN level = 3 AND last_a IS NULL THEN 2 ELSE level END AS depth, x AS text, count(*) AS n FROM t GROUP BY ALL""",
    "item_rows": rf"""WITH {_P}, c AS (SELECT page_id AS note_id, html, {_LINKS}::INT AS n, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)<', 1) AS a FROM pages),
z AS (SELECT note_id, generate_subscripts(a, 1) AS i, unnest(a) AS a FROM c),
d AS (SELECT p.*, c.n, (count(*) FILTER (lead) OVER (PARTITION BY note_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS leads FROM p JOIN c USING (note_id)),
r AS (SELECT note_id, 1 AS order_index, 'Locator' AS cls, 'Locator' AS types, {_one('title')} AS text, 0 AS doc, NULL::INT AS structure, NULL::INT AS locator, NULL::INT AS quotation, NULL::INT AS level FROM c
UNION ALL SELECT note_id, 1 + i, 'Annotation', 'Link', {_text('a')}, 0, NULL, 1, NULL, NULL FROM z
UNION ALL SELECT note_id, n + 2, 'Annotation', 'Ad', {_text("regexp_extract(html, '(?s)<div class=.ad.>([^<]*)<', 1)")}, 0, NULL, 1, NULL, NULL FROM c
UNION ALL SELECT note_id, n + 3, 'Quotation', 'Quotation', {_note("regexp_extract(html, '(?s)<article>.*</article>')")}, 0, NULL, 1, NULL, NULL FROM c
UNION ALL SELECT note_id, n + 4, 'Structure', 'Structure', {_one('h1')}, n + 3, NULL, 1, n + 3, 1 FROM c
UNION ALL SELECT note_id, n + 4 + k + leads, 'Document', 'Doc', t, n + 3, n + 4, 1, n + 3, NULL FROM d
UNION ALL SELECT note_id, n + 5 + k + leads, 'Annotation', 'Lead,Key', t, n + 4 + k + leads, n + 4, 1, n + 3, NULL FROM d WHERE lead)
SELECT note_id, order_index::INT AS order_index, cls, types, text, doc::INT AS doc, structure, locator, quotation, level FROM r""",
    "two_classes": _P1 + """SELECT note_id, (2 * k - 1 + x)::INT AS order_index, CASE x WHEN 0 THEN 'Document' ELSE 'Annotation' END AS cls, t AS text, (CASE x WHEN 0 THEN 0 ELSE 2 * k - 1 END)::INT AS doc, length(t)::INT AS span, CASE x WHEN 1 THEN 0 END AS start, CASE x WHEN 0 THEN 'Doc' ELSE 'Para,Block' END AS types FROM p, (VALUES (0), (1)) v(x)""",
    "tei_content": _P1 + f""", n AS (SELECT note_id, count(*)::INT AS n FROM p GROUP BY 1),
r AS (SELECT page_id AS note_id, 0 AS k, 'head' AS kind, {_one('h1')} AS text, 0 AS names FROM pages UNION ALL SELECT note_id, k, 'p', t, lead::INT FROM p
UNION ALL SELECT page_id, coalesce(n, 0) + 1, 'milestone', {_one('title')}, 0 FROM pages LEFT JOIN n ON note_id = page_id
UNION ALL SELECT page_id, coalesce(n, 0) + 2, 'quote', {_note("regexp_extract(html, '(?s)<article>.*</article>')")}, 0 FROM pages LEFT JOIN n ON note_id = page_id)
SELECT note_id, k::INT AS k, kind, text, names FROM r""",
    "cleaned_html": rf"""WITH {_HEADS}, y AS (SELECT u.note_id, u.g, u.i, u.level, CASE g WHEN 1 THEN regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1) ELSE u.x END AS y FROM u JOIN pages ON page_id = note_id),
x AS (SELECT note_id, g, i, level, replace(replace(replace({_decoded('y')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM y WHERE level < 3 AND length(trim(y)) > 0)
SELECT note_id, '<div>' || string_agg('<h' || level || '>' || x || '</h' || level || '>', '' ORDER BY g, i) || '</div>' AS html FROM x GROUP BY note_id""",
    # A document is where its text and what is around it are first found, as context_window has it; its lead is where it is: behind the k-th mark put before paragraphs.
    "note_offsets": rf"""WITH {_P}, n AS (SELECT page_id AS note_id, {_note(_BODY)} AS note, {_note("regexp_extract(html, '(?s)<article>.*</article>')")} AS art, string_split({_note("regexp_replace(" + _BODY + r", '<p>(<b>)?([^<\s])', '<p>\1' || chr(1) || '\2', 'g')")}, chr(1)) AS parts FROM pages),
o AS (SELECT note_id, k, lead, instr(note, art) + instr(art, t) - 2 AS s, list_sum(list_transform(parts[1:k], lambda x: length(x))) AS mark, length(t) AS len, (count(*) FILTER (lead) OVER (PARTITION BY note_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS leads FROM p JOIN n USING (note_id))
SELECT note_id, (k + leads + x)::INT AS order_index, CASE x WHEN 0 THEN 'Document' ELSE 'Annotation' END AS cls, CASE x WHEN 0 THEN s ELSE mark END::INT AS note_start, (CASE x WHEN 0 THEN s ELSE mark END + len)::INT AS note_end, true AS same FROM o, (VALUES (0), (1)) v(x) WHERE x = 0 OR lead""",
}
