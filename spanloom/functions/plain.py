"""Text functions on Python strings: those that the sequential step needs, which spanloom.functions.text has as expressions, and tokens."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np

_TOKEN = re.compile(r"\w+|[^\w\s]")
_RUN, _FEEDS, _AROUND = re.compile("[ \t]+"), re.compile("\n{3,}"), re.compile(" *\n *")


def collapse(text: str) -> str:
    return " ".join(text.split())


def canonical(raw: str) -> str:
    """Blanks, then line feeds, then blanks around them; each is only looked for where a plain search finds it."""
    text = _RUN.sub(" ", raw) if "\t" in raw or "  " in raw else raw
    text = _FEEDS.sub("\n\n", text) if "\n\n\n" in text else text
    if " \n" in text or "\n " in text:
        text = "\n".join(line.strip(" ") for line in text.split("\n"))
    return text.strip()


def kept(raw: str) -> tuple[str, np.ndarray]:
    """canonical(raw), and the place in raw of each of its characters: all that canonical() does is to drop some, and to write blanks for tabs."""
    text, places = raw, np.arange(len(raw))
    for pattern, new, most in ((_RUN, " ", 1), (_FEEDS, "\n\n", 2), (_AROUND, "\n", None)):
        keep = np.ones(len(text), bool)
        for m in pattern.finditer(text):
            if most is None:
                keep[m.start() : m.end()] = False
                keep[text.index("\n", m.start())] = True
            else:
                keep[m.start() + most : m.end()] = False
        text, places = pattern.sub(new, text), places[keep]
    begin = len(text) - len(text.lstrip())
    return text.strip(), places[begin : begin + len(text.strip())]


def context(text: str, parent: str, most: int = 30) -> tuple[str, str]:
    at = parent.find(text)
    end = at + len(text)
    return ("", "") if at < 0 else (parent[max(0, at - most) : at], parent[end : end + most])


def token_spans(text: str) -> list[dict]:
    """Runs of word characters, and single other characters that aren't white space, with their places; one pass."""
    return [{"ix": i, "token": m[0], "start": m.start(), "end": m.end()} for i, m in enumerate(_TOKEN.finditer(text))]


def bio(text: str, spans: list[tuple[str, int, int]], most: int | None = None) -> tuple[list[str], list[str]]:
    """Tokens and their labels. spans: (label, start, end), of which later ones overwrite earlier ones; those of more than `most` tokens are left out.

    A span's tokens are a run, found by bisection. Spans are laid from the last to the first, and what is taken is
    skipped, so each token is labelled once.
    """
    found = list(_TOKEN.finditer(text))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    labels, free = ["O"] * len(found), list(range(len(found) + 1))

    def next_free(i: int) -> int:
        while free[i] != i:
            free[i] = i = free[free[i]]
        return i

    for label, start, end in reversed(spans):
        first, last = bisect_right(ends, start), bisect_left(starts, end)
        if last <= first or most is not None and last - first > most:
            continue
        i = next_free(first)
        while i < last:
            labels[i] = f"{'B' if i == first else 'I'}-{label}"
            free[i] = i + 1
            i = next_free(i + 1)
    return [m[0] for m in found], labels
