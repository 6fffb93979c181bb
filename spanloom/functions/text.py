"""Text functions as Catalyst expressions; tokens are cut in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import plain

#: White space as the reference semantics have it: Unicode's and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1C-\x1F]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$".replace("|(?U)", "|"), "")


def collapse(text: Column) -> Column:
    """All white space to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"{SPACE}+", " "), "^ | $", "")


def canonical(raw: Column) -> Column:
    """A slice of the text stream as an item's text: blanks, then line feeds, then blanks around them, in this order."""
    text = F.regexp_replace(raw, "[ \t]+", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, " *\n *", "\n"))


def cut(stream: Column, start: Column, end: Column) -> Column:
    """The slice of code points [start, end)."""
    return F.substring(stream, start + 1, end - start)


def shorten(html: Column, most: int) -> Column:
    """At most `most` characters, without white space at the cut, and an ellipsis."""
    return F.when(F.length(html) > most, F.concat(F.regexp_replace(F.substring(html, 1, most), rf"{SPACE}+$", ""), F.lit("…"))).otherwise(html)


def context(text: Column, parent: Column, most: int = 30) -> Column:
    """struct(prefix, suffix): what stands around the first occurrence of a text in its parent's; empty if there is none."""
    at = F.instr(parent, text) - 1
    found = (F.length(text) == 0) | (at >= 0)
    at = F.when(F.length(text) == 0, F.lit(0)).otherwise(at)
    before = cut(parent, F.greatest(at - most, F.lit(0)), at)
    after = F.substring(parent, at + F.length(text) + 1, F.lit(most))
    return F.struct(F.when(found, before).otherwise("").alias("prefix"), F.when(found, after).otherwise("").alias("suffix"))


_SPANS = pa.list_(pa.struct([("ix", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def token_spans(text: Column) -> Column:
    """array(struct(ix, token, start, end)): each token and its place; null for null. In Arrow batches, one pass over the text."""
    cut = F.arrow_udf(lambda texts: pa.array([None if t is None else plain.token_spans(t) for t in texts.to_pylist()], _SPANS), "array<struct<ix:int,token:string,start:int,end:int>>")
    return cut(text)


def uuid_urn(*parts: Column) -> Column:
    """A URN that the parts determine, in the form of a UUID: retries and reruns agree."""
    h = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])
