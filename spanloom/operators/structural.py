"""XPaths as interval joins on a note's numbered tree, all paths of a mapping in one pass.

A node is an interval: its number in document order, and the last number in its subtree. Steps join sorted lists of
such intervals: descendants of a list are found by bisection below its outermost intervals, so nested ones are visited
once; children, parents and siblings by links between the numbers. Nothing is printed as XML and parsed again, and
comments are comments, not elements.

What is evaluated so: unions of location paths with the axes child, descendant(-or-self), self, parent,
ancestor(-or-self), the sibling axes, attribute and text(); predicates by position (on child steps), last(), attributes,
children, texts, contains(), starts-with(), not(), and, or; and string(), normalize-space(), string-length(), count(),
boolean(), name(), concat() of such paths and literals, which give one value. compile_branch() gives None for all else, which
then goes to the JVM's XPath on the note's XML.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from spanloom.plans.mapping import SAME_AS, Plan, branches
from spanloom.sources.html_tree import COMMENT, Node, plain_xml

#: Neither attributes nor texts nor values have a place among the nodes: they come last. Values have no owner.
LATE, NOBODY = 2**31 - 1, -1
#: Above the document's element.
TOP = -1

_SEPARATOR = re.compile(r"\s*(//?)\s*")
_STEP = re.compile(r"(?P<short>\.\.|\.)|(?:(?P<axis>[a-z-]+)\s*::\s*|(?P<at>@)\s*)?(?P<test>\*|[A-Za-z_][\w.\-]*)(?P<call>\s*\(\s*\))?")
_LITERAL = re.compile(r"\"[^\"]*\"|'[^']*'")
_CALL = re.compile(r"([a-z-]+)\s*\((.*)\)\s*\Z", re.S)
_COMPARED = re.compile(r"(.+?)\s*(!=|=)\s*(\"[^\"]*\"|'[^']*')\s*\Z", re.S)
AXES = frozenset("child descendant descendant-or-self self parent ancestor ancestor-or-self following-sibling preceding-sibling attribute".split())
FUNCTIONS = frozenset("string normalize-space string-length count boolean name concat".split())


class Tree:
    """Nodes of a document by number. A node's interval is [i, last[i]]."""

    def __init__(self, document: Node):
        self.nodes: list[Node] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.kids: list[list[int]] = []
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.number: dict[int, int] = {}
        todo: list[tuple[Node, int]] = [(document, TOP)]
        while todo:
            node, parent = todo.pop()
            i = len(self.nodes)
            self.nodes.append(node)
            self.parent.append(parent)
            self.last.append(i)
            self.kids.append([])
            self.by_tag[node.tag].append(i)
            self.number[id(node)] = i
            if parent >= 0:
                self.kids[parent].append(i)
            todo.extend((c, i) for c in reversed(node.children))
        for i in range(len(self.nodes) - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])
        self.elements = [i for i, n in enumerate(self.nodes) if n.tag != COMMENT]

    def children(self, i: int) -> list[int]:
        return [0] if i == TOP else self.kids[i]

    def of_test(self, test: str) -> list[int] | range:
        return self.elements if test == "*" else range(len(self.nodes)) if test == "node()" else self.by_tag.get(COMMENT if test == "comment()" else test, [])

    def passes(self, i: int, test: str) -> bool:
        tag = self.nodes[i].tag if i >= 0 else ""
        return test == "node()" or i >= 0 and (tag == test or test == "*" and tag != COMMENT or test == "comment()" and tag == COMMENT)

    def texts(self, i: int) -> list[str]:
        node = self.nodes[i]
        own = [] if node.tag == COMMENT else [node.text]
        return [plain_xml(t) for t in (*own, *(c.tail for c in node.children)) if t]

    def string(self, i: int) -> str:
        """All text in a node."""
        parts, todo = [], [(self.nodes[i], False)]
        while todo:
            node, tail = todo.pop()
            if tail:
                parts.append(node.tail)
                continue
            if node.tag != COMMENT:
                parts.append(node.text)
            for child in reversed(node.children):
                todo += [(child, True), (child, False)]
        return plain_xml("".join(parts))

    def attribute(self, i: int, name: str) -> str | None:
        attrs = self.nodes[i].attrs if i >= 0 else {}
        return plain_xml(attrs[name] or "") if name in attrs else None


Predicate = Callable[[Tree, int, int, int], bool]


@dataclass(frozen=True)
class Step:
    axis: str
    test: str
    predicates: tuple[Predicate, ...] = ()
    positional: bool = False


@dataclass(frozen=True)
class Path:
    """steps from the top or the context; kind: 'node', 'attribute' (with its name) or 'text'."""

    absolute: bool
    steps: tuple[Step, ...]
    kind: str = "node"
    name: str = ""

    def nodes(self, tree: Tree, context: int) -> list[int]:
        """Numbers of the nodes that the steps reach, in document order; for attributes and texts, of what may own them."""
        found = [TOP] if self.absolute else [context]
        for step in self.steps:
            found = join(tree, found, step)
        return found

    def values(self, tree: Tree, context: int) -> list[tuple[int, str]]:
        """(owner, value) of attributes or texts."""
        owners = [i for i in self.nodes(tree, context) if i >= 0]
        if self.kind == "text":
            return [(i, t) for i in owners for t in tree.texts(i)]
        return [(i, v) for i in owners if (v := tree.attribute(i, self.name)) is not None]


@dataclass(frozen=True)
class Value:
    """A function that gives one value, as its string."""

    of: Callable[[Tree, int], str]
    kind: str = "value"


def below(tree: Tree, context: list[int], sorted_: list[int] | range) -> list[int]:
    """Those of a sorted list that lie in an interval of the context, which is sorted too; only outermost intervals are looked at."""
    out: list[int] = []
    edge = -2
    for i in context:
        if i > edge:
            edge = len(tree.nodes) if i == TOP else tree.last[i]
            out += sorted_[bisect_right(sorted_, i) : bisect_right(sorted_, edge)]
    return out


def join(tree: Tree, context: list[int], step: Step) -> list[int]:
    """The nodes that stand to a sorted list of nodes as a step says, in document order."""
    test = lambda i: tree.passes(i, step.test)
    if step.axis == "descendant-by-parent":  # //x[n]: by position among its parent's
        groups: dict[int, list[int]] = defaultdict(list)
        for i in below(tree, context, tree.of_test(step.test)):
            groups[tree.parent[i]].append(i)
        return sorted(i for group in groups.values() for i in kept(tree, group, step))
    if step.axis == "child":
        if step.positional:
            return sorted(i for c in context for i in kept(tree, [k for k in tree.children(c) if test(k)], step))
        found = [k for c in context for k in tree.children(c) if test(k)]
    elif step.axis == "descendant":
        found = below(tree, context, tree.of_test(step.test))
    elif step.axis == "descendant-or-self":
        found = [*{*below(tree, context, tree.of_test(step.test)), *(i for i in context if test(i))}]
    elif step.axis == "self":
        found = [i for i in context if test(i)]
    elif step.axis == "parent":
        found = [*{p for i in context if i != TOP and test(p := tree.parent[i])}]
    elif step.axis.startswith("ancestor"):
        met: set[int] = set()
        for i in context:
            at = i if step.axis == "ancestor-or-self" or i == TOP else tree.parent[i]
            while at not in met:
                met.add(at)
                if at == TOP:
                    break
                at = tree.parent[at]
        found = [i for i in met if test(i)]
    else:
        met = set()
        ends: dict[int, int] = {}
        forward = step.axis == "following-sibling"
        for i in context:
            if i > 0:
                p = tree.parent[i]
                ends[p] = min(ends.get(p, i), i) if forward else max(ends.get(p, i), i)
        for p, i in ends.items():
            row = tree.kids[p]
            at = bisect_left(row, i)
            met.update(row[at + 1 :] if forward else row[:at])
        found = [i for i in met if test(i)]
    return sorted(kept(tree, found, step))


def kept(tree: Tree, found: list[int], step: Step) -> list[int]:
    for predicate in step.predicates:
        found = [i for n, i in enumerate(found, 1) if predicate(tree, i, n, len(found))]
    return found


def closing(text: str, at: int) -> int:
    """Behind the bracket that closes the one at `at`; -1 if none does."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            at = text.find(c, at + 1)
            if at < 0:
                return -1
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def parted(text: str, by: str) -> list[str]:
    """A text split at an operator that stands outside of quotes and brackets."""
    out, at, last = [], 0, 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            at = text.find(c, at + 1)
            if at < 0:
                break
        elif c in "[(":
            at = closing(text, at) - 1
            if at < 0:
                break
        elif text.startswith(by, at):
            out.append(text[last:at])
            last = at = at + len(by)
            continue
        at += 1
    return [*out, text[last:]]


def _strings(path: Path) -> Callable[[Tree, int], list[str]]:
    if path.kind == "node":
        return lambda tree, i: [tree.string(x) for x in path.nodes(tree, i) if x >= 0]
    return lambda tree, i: [v for _, v in path.values(tree, i)]


def predicate(text: str) -> tuple[Predicate, bool] | None:
    """A predicate and whether it asks for the position; None if it is none of those known."""
    text = text.strip()
    for by, combine in ((" or ", any), (" and ", all)):
        parts = parted(text, by)
        if len(parts) > 1:
            own = [predicate(p) for p in parts]
            if None in own:
                return None
            tests = [p[0] for p in own]
            return (lambda tree, i, n, size: combine(t(tree, i, n, size) for t in tests)), any(p[1] for p in own)
    if text.isdigit():
        return (lambda tree, i, n, size: n == int(text)), True
    if re.fullmatch(r"last\s*\(\s*\)", text):
        return (lambda tree, i, n, size: n == size), True
    if m := re.fullmatch(r"position\s*\(\s*\)\s*(<=|>=|=|<|>)\s*(\d+)", text):
        sign, most = m[1], int(m[2])
        return (lambda tree, i, n, size: n == most if sign == "=" else n < most if sign == "<" else n <= most if sign == "<=" else n > most if sign == ">" else n >= most), True
    if (m := _CALL.match(text)) and m[1] == "not":
        inner = predicate(m[2])
        return inner and ((lambda tree, i, n, size: not inner[0](tree, i, n, size)), inner[1])
    if (m := _CALL.match(text)) and m[1] in ("contains", "starts-with"):
        args = [a.strip() for a in parted(m[2], ",")]
        path = compile_path(args[0]) if len(args) == 2 and _LITERAL.fullmatch(args[1]) else None
        if path is None:
            return None
        strings, part = _strings(path), args[1][1:-1]
        first = lambda tree, i: next(iter(strings(tree, i)), "")
        return (lambda tree, i, n, size: part in first(tree, i) if m[1] == "contains" else first(tree, i).startswith(part)), False
    if m := _COMPARED.match(text):
        path = compile_path(m[1])
        if path is None:
            return None
        strings, value, same = _strings(path), m[3][1:-1], m[2] == "="
        return (lambda tree, i, n, size: any((s == value) == same for s in strings(tree, i))), False
    path = compile_path(text)
    if path is None:
        return None
    return (lambda tree, i, n, size: bool(path.nodes(tree, i) if path.kind == "node" else path.values(tree, i))), False


def compile_path(text: str) -> Path | None:
    """A location path; None if it isn't one of those that are evaluated here."""
    text = text.strip()
    absolute = text.startswith("/")
    at, steps, kind, name, first = 0, [], "node", "", True
    while at < len(text):
        deep = False
        if m := _SEPARATOR.match(text, at):
            deep, at = m[1] == "//", m.end()
            if at == len(text) and not (first and not deep):
                return None
        elif not first:
            return None
        if at == len(text):
            break
        first = False
        m = _STEP.match(text, at)
        if not m or kind != "node":
            return None
        at = m.end()
        axis, test = m["axis"] or "child", (m["test"] or "") + ("()" if m["call"] else "")
        if m["short"]:
            axis, test = ("parent" if m["short"] == ".." else "self"), "node()"
        if axis not in AXES or m["call"] and test not in ("node()", "text()", "comment()"):
            return None
        predicates, positional = [], False
        while at < len(text) and text[at : at + 1] == "[":
            end = closing(text, at)
            made = predicate(text[at + 1 : end - 1]) if end > 0 else None
            if made is None:
                return None
            predicates.append(made[0])
            positional |= made[1]
            at = end
        if m["at"] or axis == "attribute" or test == "text()":
            if predicates or axis not in ("child", "attribute") or test in ("*", "node()", "comment()"):
                return None
            kind, name = ("text", "") if test == "text()" else ("attribute", test)
            if deep:
                steps.append(Step("descendant-or-self", "node()"))
            continue
        if deep and axis == "child":
            axis = "descendant-by-parent" if positional else "descendant"
        elif deep:
            steps.append(Step("descendant-or-self", "node()"))
        if positional and axis not in ("child", "descendant-by-parent"):
            return None
        steps.append(Step(axis, test, tuple(predicates), positional))
    return Path(absolute, tuple(steps), kind, name) if text else None


def _number(n: float) -> str:
    return str(int(n)) if n == int(n) else str(n)


def compile_value(text: str) -> Value | None:
    """A function of paths and literals that gives one value; None for others."""
    text = text.strip()
    if _LITERAL.fullmatch(text):
        return Value(lambda tree, i: text[1:-1])
    m = _CALL.match(text)
    if not m or m[1] not in FUNCTIONS or closing(text, m.start(2) - 1) != len(text):
        return None
    args = [a.strip() for a in parted(m[2], ",")]
    if m[1] == "concat":
        own = [compile_value(a) or compile_value(f"string({a})") for a in args]
        return None if None in own or len(own) < 2 else Value(lambda tree, i: "".join(v.of(tree, i) for v in own))
    inner = compile_value(args[0]) if len(args) == 1 and m[1] not in ("count", "name") else None
    paths = [compile_path(b) for b in branches(args[0])] if len(args) == 1 and inner is None else []
    if inner is None and (not paths or None in paths):
        return None

    def all_of(tree: Tree, i: int) -> list[tuple[int, str | None]]:
        return sorted({x for p in paths for x in ([(n, None) for n in p.nodes(tree, i)] if p.kind == "node" else p.values(tree, i))}, key=lambda x: (x[0], x[1] or ""))

    def string(tree: Tree, i: int) -> str:
        if inner is not None:
            return inner.of(tree, i)
        found = next(iter(all_of(tree, i)), None)
        return "" if found is None else found[1] if found[1] is not None else tree.string(max(found[0], 0))

    def count(tree: Tree, i: int) -> int:
        return sum(len(p.nodes(tree, i)) if p.kind == "node" else len(p.values(tree, i)) for p in paths) if len(paths) == 1 else len(all_of(tree, i))

    made = {
        "string": string,
        "normalize-space": lambda tree, i: " ".join(re.findall(r"[^ \t\r\n]+", string(tree, i))),
        "string-length": lambda tree, i: _number(len(string(tree, i))),
        "count": lambda tree, i: _number(count(tree, i)),
        "boolean": lambda tree, i: str(bool(string(tree, i)) if inner is not None else bool(all_of(tree, i))).lower(),
        "name": lambda tree, i: next((tree.nodes[x[0]].tag for x in all_of(tree, i) if x[0] >= 0), ""),
    }
    return Value(made[m[1]])


def compile_branch(text: str) -> Path | Value | None:
    return compile_value(text) if _CALL.match(text.strip()) and not text.strip().startswith(("/", ".", "(")) and text.strip().partition("(")[0].strip() in FUNCTIONS else compile_path(text)


@dataclass(frozen=True)
class Programs:
    """What a plan's XPaths compile to, by XPath and branch."""

    rules: tuple[tuple[Path | Value, ...], ...]
    ignore: tuple[Path, ...]
    same_as: tuple[Path, ...]

    def ignored(self, document: Node, root: Node) -> list[Node]:
        tree = Tree(document)
        base = tree.number[id(root)]
        return [tree.nodes[i] for p in self.ignore if p.kind == "node" for i in p.nodes(tree, base) if base <= i <= tree.last[base]]

    def seeds(self, tree: Tree, base: int) -> list[tuple[int, int, int, int, str | None]]:
        """(order, xp, pos, owner, value) of all matches in the root, sorted; numbers count from the root."""
        out = []
        inside = lambda i: base <= i <= tree.last[base]
        for xp, own in enumerate(self.rules):
            nodes = [p for p in own if p.kind == "node"]
            found = nodes[0].nodes(tree, base) if len(nodes) == 1 else sorted({i for p in nodes for i in p.nodes(tree, base)})
            out += [(i - base, xp, n, i - base, None) for n, i in enumerate(i for i in found if inside(i))]
            for p in own:
                if p.kind == "value":
                    out.append((LATE, xp, 0, NOBODY, p.of(tree, base)))
                elif p.kind != "node":
                    out += [(LATE, xp, n, i - base, v) for n, (i, v) in enumerate(x for x in p.values(tree, base) if inside(x[0]))]
        return sorted(out, key=lambda x: (*x[:4], x[4] or ""))

    def linked(self, tree: Tree, i: int) -> str | None:
        """The first result of the sameAs path from a node."""
        met = sorted((o, v) for p in self.same_as for o, v in (p.values(tree, i) if p.kind != "node" else ()))
        return met[0][1] if met else None


@functools.lru_cache(256)
def programs(plan: Plan) -> Programs | None:
    """The plan's XPaths compiled, if all of them can be."""
    if not plan.structural:
        return None
    own = lambda xpath, make: tuple(make(b) for b in branches(xpath))
    rules = tuple(own(x, compile_branch) for x in plan.xpaths)
    ignore = tuple(p for x in plan.ignore_xpaths for p in own(x, compile_path))
    same = own(plan.same_as, compile_path) if plan.same_as and plan.same_as != SAME_AS else ()
    if any(p is None for p in (*(p for r in rules for p in r), *ignore, *same)) or any(p.kind == "node" or p.absolute for p in same):
        return None
    return Programs(rules, ignore, same)
