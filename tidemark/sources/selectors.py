"""Selectors over html_nodes: a structural join of scopes and what lies inside them, in one pass over a page.

A selector is compounds (tag, #id, .class, :not(.class), [attribute], [attribute="value"], [attribute*="part"]) joined by a space (inside) or > (a child),
with commas between alternatives; :scope stands for the scope. Nodes come in document order, so the open elements are a stack. Each keeps, as
bits, which steps of a selector it and the elements around it have fulfilled; a node needs its parent's bits only, and what follows from them is
worked out once for all pages. Time grows with the nodes of a page, not with pairs of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import accumulate, chain, count
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .html_nodes import PLAIN, ROWS, TEXT, Nodes, cut, start

PAGE = ["source_id", "url"]
COMPOUND = re.compile(r"(:scope|[a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|:not\(\.[\w-]+\)|\[[\w-]+(?:\*?=\"[^\"]*\")?\])*)")
PART = re.compile(r'(:not\(\.|[#.])([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\]')

FOUND = "source_id string, url string, row int, field string, n int, last int, depth int, attrs map<string,string>, pieces array<struct<n:int,t:string>>, lead string"
ARROW = pa.schema([("source_id", pa.string()), ("url", pa.string()), ("row", pa.int32()), ("field", pa.string()), ("n", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("pieces", pa.list_(pa.struct([("n", pa.int32()), ("t", pa.string())]))), ("lead", pa.string())])


@dataclass(frozen=True)
class Step:
    child: bool
    tag: str | None
    tests: tuple  # (attribute, how, value)

    def holds(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag and self.tag != tag:
            return False
        for name, how, value in self.tests:
            held = attrs.get(name)
            if how == "lacks":
                if held is not None and value in held.split():
                    return False
            elif held is None or (how == "=" and held != value) or (how == "*=" and value.casefold() not in held.casefold()) or (how == "has" and value not in held.split()):
                return False
        return True


@lru_cache(200)
def compiled(selector: str) -> tuple[tuple[Step, ...], ...]:
    """The steps of each alternative. Raises ValueError for what isn't such a selector."""
    out = []
    for alternative in _cut(selector, ","):
        steps, child = [], False
        for word in _cut(alternative.replace(">", " > "), " "):
            if word == ">":
                child = True
                continue
            m = COMPOUND.fullmatch(word)
            if not m or not word:
                raise ValueError(f"not a selector: {selector!r}")
            if m[1] == ":scope":
                if steps or m[2]:
                    raise ValueError(f":scope stands first and alone: {selector!r}")
                continue
            tests = tuple(("id", "=", b) if a == "#" else ("class", "has" if a == "." else "lacks", b) if a else (c.lower(), how or "any", v) for a, b, c, how, v in PART.findall(m[2]))
            steps.append(Step(child, None if m[1] in (None, "*") else m[1].lower(), tests))
            child = False
        if not steps or child:
            raise ValueError(f"not a selector: {selector!r}")
        out.append(tuple(steps))
    return tuple(out)


def _cut(text: str, at: str) -> list[str]:
    """text, cut at each character outside of brackets; empty parts of a list of words don't count."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "[") - (c == "]")
        if c == at and not depth:
            parts.append("")
        else:
            parts[-1] += c
    parts = [p.strip() for p in parts]
    return [p for p in parts if p] if at == " " else parts


class Matcher:
    """Some selectors below one scope. A state has bits by selector for an open element, its own and those of all around it; states are numbered as they come up."""

    def __init__(self, selectors: list[str]):
        self.programs = [(i, steps) for i, s in enumerate(selectors) for steps in compiled(s)]
        tests = [t for _, steps in self.programs for step in steps for t in step.tests]
        self.valued = sorted({name for name, how, _ in tests if how != "any"})
        self.present = sorted({name for name, how, _ in tests if how == "any"} - set(self.valued))
        self.none = 0
        self.states = [((0,) * len(self.programs), (0,) * len(self.programs))]
        self.numbers = {self.states[0]: 0}
        self.met: dict[tuple, tuple[int, list[int]]] = {}  # what was worked out before, by all that it hangs on

    def meet(self, parent: int, top: bool, tag: str, attrs: dict[str, str]) -> tuple[int, list[int]]:
        """The state of a node below parent, and the selectors that it fulfils. top: whether the parent is the scope."""
        told = (*map(attrs.get, self.valued), *[name in attrs for name in self.present]) if attrs else None
        key = (parent, top, tag, told)
        if (known := self.met.get(key)) is None:
            known = self.met[key] = self._meet(self.states[parent], top, tag, attrs)
        return known

    def _meet(self, parent: tuple, top: bool, tag: str, attrs: dict[str, str]) -> tuple[int, list[int]]:
        own, around, hits = [], [], []
        for p, (i, steps) in enumerate(self.programs):
            above, any_above, bits = parent[0][p], parent[1][p], 0
            for k, step in enumerate(steps):
                if (not step.child or top) if k == 0 else (above if step.child else any_above) >> (k - 1) & 1:
                    if step.holds(tag, attrs):
                        bits |= 1 << k
            own.append(bits)
            around.append(any_above | bits)
            if bits >> (len(steps) - 1) & 1:
                hits.append(i)
        state = (tuple(own), tuple(around))
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number, list(dict.fromkeys(hits))  # once where several alternatives hold


#: What matchers may remember from one page to the next.
MOST = 20_000


@lru_cache(200)
def _matcher(selectors: tuple[str, ...]) -> list[Matcher]:
    return [Matcher(list(selectors))]


def matcher(selectors: list[str]) -> Matcher:
    """One for all pages of a task; begun anew when it has remembered very much."""
    held = _matcher(tuple(selectors))
    if len(held[0].met) > MOST:
        held[0] = Matcher(selectors)
    return held[0]


class Page:
    """The scopes and matches that are open at a place of a page."""

    def __init__(self, source: str, url: str, scope: str, names: list[str], selectors: list[str]):
        self.where, self.names, self.scoped, self.inner = (source, url), names, matcher([scope]) if scope else None, matcher(selectors)
        self.stack: list[Open] = []
        self.done: list[tuple] = []
        self.matches: list[list] = []  # open ones: row, field, n, last, depth, attrs, pieces, lead, whether a lead may still come
        self.next = 0
        self.page = {-1: self.inner.none} if not scope else {}

    def node(self, n: int, last: int, depth: int, tag: str, attrs: dict[str, str], text: str | None) -> None:
        if n != self.next:
            raise ValueError("the rows of a page must come together and in order, as html_nodes gives them")
        self.next += 1
        while self.stack and self.stack[-1].last < n:
            self.stack.pop()
        while self.matches and self.matches[-1][3] < n:
            self._end()
        if tag == TEXT:
            for m in self.matches:
                m[6].append((n, text))
                if m[8]:
                    m[7] = text if m[7] is None else f"{m[7]} {text}"
            return
        for m in self.matches:
            m[8] = False
        above = self.stack[-1] if self.stack else None
        scopes: dict[int, int] = {}
        for row, state in (above.scopes if above else self.page).items():
            scopes[row], hits = self.inner.meet(state, (above.n if above else -1) == row, tag, attrs)
            for i in hits:
                self.matches.append([row, self.names[i], n, last, depth, attrs, [], None, True])
        outer = self.scoped.none if self.scoped else None
        if self.scoped:
            outer, hits = self.scoped.meet(above.outer if above else self.scoped.none, above is None, tag, attrs)
            if hits:
                scopes[n] = self.inner.none
        if last > n:
            self.stack.append(Open(n, last, scopes, outer))

    def _end(self) -> None:
        row, name, n, last, depth, attrs, pieces, lead, _ = self.matches.pop()
        self.done.append((*self.where, row, name, n, last, depth, list(attrs.items()), pieces, lead))

    def end(self) -> None:
        while self.matches:
            self._end()

    def all(self, tree: Nodes) -> list[tuple]:
        """What is found in a whole page."""
        for n, (last, depth, tag, attrs, text) in enumerate(zip(tree.last, tree.depth, tree.tag, tree.attrs, tree.text, strict=True)):
            self.node(n, last, depth, tag, dict(attrs), text)
        self.end()
        return self.done


@dataclass
class Open:
    n: int
    last: int
    scopes: dict[int, int] = field(default_factory=dict)
    outer: int | None = None


def within(nodes: DataFrame, scope: str, fields: dict[str, str]) -> DataFrame:
    """(source_id, url, row, field, n, last, depth, attrs, pieces, lead): for each element that scope selects (its number is row; -1 where scope
    is empty, for the page) and each field, the elements inside that the field's selector finds; pieces are their texts, lead is what they say before
    their first element. nodes: as html_nodes gives them, or pages (source_id, url, body), which are then read and searched in one go.
    """
    names, selectors = list(fields), list(fields.values())
    for s in [*selectors, *([scope] if scope else [])]:
        compiled(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: Page | None = None
        for b in batches:
            for source, url, n, last, depth, tag, attrs, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if page is None or page.where != (source, url) or (n == 0 and page.next):
                    if page:
                        page.end()
                        yield from _batches(page, True)
                    page = Page(source, url, scope, names, selectors)
                page.node(n, last, depth, tag, dict(attrs or ()), text)
                if len(page.done) >= ROWS:
                    yield from _batches(page)
        if page:
            page.end()
            yield from _batches(page, True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for source, url, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree, page = Nodes(), Page(source, url, scope, names, selectors)
                tree.read(body or "")
                held += page.all(tree)
                if len(held) >= ROWS:
                    yield from _rows(held)
                    held = []
        yield from _rows(held)

    if "body" in nodes.columns:
        return nodes.select(*PAGE, "body").mapInArrow(read, FOUND)
    return nodes.select(*PAGE, "n", "last", "depth", "tag", "attrs", "text").mapInArrow(run, FOUND)


class Shape(NamedTuple):
    """What searches find in a page, but for its texts and attributes: the scopes of each search; of each field, in order of searches, how many are
    found in each scope, and their numbers; the texts of all that is found, and what attributes are asked for, with the parts that fields have of these.
    """

    rows: list[list[int]]
    counts: list[list[int]]
    numbers: list[list[int]]
    texts: list[list[int]]
    parts: list[slice]
    asked: list[tuple[int, str]]
    asked_parts: list[slice]


class Shapes:
    """Searches of pages. Plain pages that differ in their texts and in attributes that no selector asks for have one shape: it is searched once, with
    the places of texts in their stead, and each further page of the shape is only cut and looked up.
    """

    def __init__(self, searches: dict[str, tuple[str, dict[str, str]]], attrs: dict[str, tuple[str, ...]]):
        self.searches, self.attrs = searches, attrs
        self.steps = sorted({step for scope, fields in searches.values() for css in (scope, *fields.values()) if css for steps in compiled(css) for step in steps}, key=repr)
        self.kinds = Kinds(self.kind)
        self.names: dict[object, int] = {}
        self.known: dict[tuple, Shape] = {}
        self.size = 0

    def kind(self, tag: str) -> int:
        """The number of a tag's kind: its name, and which steps it fulfils; 0 for what isn't plain."""
        if not PLAIN.fullmatch(f"<{tag}>"):
            return 0
        if tag[0] == "/":
            return self.names.setdefault(tag.lower(), len(self.names) + 1)
        name, attrs = start(tag)
        held = dict(attrs)
        return self.names.setdefault((name, *[step.holds(name, held) for step in self.steps]), len(self.names) + 1)

    def search(self, tree: Nodes, places: Sequence[int]) -> Shape:
        """The shape of a page; places: where a node's tag or text is to be looked up."""
        shape = Shape([], [], [], [], [], [], [])
        for scope, fields in self.searches.values():
            found: dict[int, dict[str, list]] = {}
            for _, _, row, field, n, _, _, _, pieces, _ in Page("", "", scope, list(fields), list(fields.values())).all(tree):
                found.setdefault(row, {}).setdefault(field, []).append((n, [places[t] for t, _ in pieces]))
            shape.rows.append(sorted(found))
            for field in fields:
                scopes = [sorted(found[row].get(field, [])) for row in shape.rows[-1]]
                mine = [f for each in scopes for f in each]
                shape.counts.append(list(map(len, scopes)))
                shape.numbers.append([n for n, _ in mine])
                shape.parts.append(slice(len(shape.texts), len(shape.texts) + len(mine)))
                shape.texts.extend(t for _, t in mine)
                for name in self.attrs.get(field, ()):
                    shape.asked_parts.append(slice(len(shape.asked), len(shape.asked) + len(mine)))
                    shape.asked.extend((places[n], name) for n, _ in mine)
        return shape

    def of(self, kinds: list[int], tags: list[str], texts: list[str]) -> Shape:
        """The shape of a plain page."""
        key = (*kinds, *map(bool, texts))
        if (shape := self.known.get(key)) is not None:
            return shape
        tree, places = Nodes(), []
        for i, text in enumerate(texts):
            if text:
                tree.handle_data(str(i))
            if i < len(tags):
                if tags[i][0] == "/":
                    tree.handle_endtag(tags[i][1:].lower())
                else:
                    tree.handle_starttag(*start(tags[i]))
        tree.close()
        begun = iter([i for i, tag in enumerate(tags) if tag[0] != "/"])
        shape = self.search(tree, [int(text) if tag == TEXT else next(begun) for tag, text in zip(tree.tag, tree.text, strict=True)])
        size = len(key) + len(shape.texts) + sum(map(len, shape.texts))
        if self.size + size > MOST_IN_SHAPES:
            self.known, self.size = {}, 0
        if size <= MOST_IN_SHAPES:
            self.known[key] = shape
            self.size += size
        return shape

    def find(self, body: str) -> tuple[Shape, list[str | None], list[str | None]]:
        """A page's shape, the texts of all that is found, and the attributes that are asked for."""
        if len(self.names) > MOST:
            self.names, self.known, self.size = {}, {}, 0
            self.kinds.clear()
        parts = cut(body)
        tags = parts[1::2]
        kinds = [self.kinds[tag] for tag in tags]
        if 0 in kinds or "<" in parts[-1]:
            tree = Nodes()
            tree.read(body)
            shape, texts, attrs = self.search(tree, range(len(tree.tag))), tree.text, tree.attrs.__getitem__
        else:
            texts = parts[::2]
            if "&" in body:
                texts = [unescape(t) if "&" in t else t for t in texts]
            texts = [t and " ".join(t.split()) for t in texts]
            shape, attrs = self.of(kinds, tags, texts), lambda i: start(tags[i])[1]
        return shape, [texts[p[0]] if len(p) == 1 else " ".join([texts[i] for i in p]) or None for p in shape.texts], [dict(attrs(i)).get(name) for i, name in shape.asked]


#: What the shapes of a task may hold: tags, texts and things found.
MOST_IN_SHAPES = 1_000_000


class Kinds(dict):
    """Kinds of tags that came up before; begun anew when they are very many."""

    def __init__(self, kind):
        self.kind = kind

    def __missing__(self, tag: str) -> int:
        if len(self) >= MOST:
            self.clear()
        known = self[tag] = self.kind(tag)
        return known


def gathered(nodes: DataFrame, searches: dict[str, tuple[str, dict[str, str]]], attrs: dict[str, tuple[str, ...]]) -> DataFrame:
    """(source_id, url, all further columns of pages, and one for each search): a row for each page. A search (a scope and its fields, as of within) gives
    an entry for each element that its scope selects, in order, if any field is found in it: row, and for each field what is found: n, t, and the
    attributes that attrs names for the field. t is the whole text, null where there is none. A page stays in one row from its reading on, so
    nothing is shuffled. nodes: rows of html_nodes, or pages, as of within.
    """
    if "body" not in nodes.columns:
        t = F.nullif(F.array_join(F.transform("pieces", lambda x: x["t"]), " "), F.lit(""))
        mine = lambda f: F.struct("n", t.alias("t"), *[F.element_at("attrs", a).alias(a) for a in attrs.get(f, ())])
        rows = None
        for name, (scope, fields) in searches.items():
            found = within(nodes, scope, fields).groupBy(*PAGE, "row").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == f, mine(f)))).alias(f) for f in fields])
            found = found.select(*PAGE, F.struct("row", *[F.col(f"`{f}`") for f in fields]).alias(name))
            rows = found if rows is None else rows.unionByName(found, allowMissingColumns=True)
        return rows.groupBy(*PAGE).agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in searches])
    for scope, fields in searches.values():
        for s in [*fields.values(), *([scope] if scope else [])]:
            compiled(s)
    rest = [c for c in nodes.columns if c not in (*PAGE, "body")]
    entry = lambda f: f"array<struct<{','.join(['n:int', 't:string', *[f'`{a}`:string' for a in attrs.get(f, ())]])}>>"
    columns = [f"`{name}` array<struct<{','.join(['row:int', *[f'`{f}`:{entry(f)}' for f in fields]])}>>" for name, (_, fields) in searches.items()]
    schema = StructType(nodes.select(*PAGE, *rest).schema.fields + StructType.fromDDL(",".join(columns)).fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(searches, attrs)
        for b in batches:
            held, lo, size = [], 0, 0
            for i, body in enumerate(b.column(2).to_pylist()):
                held.append(shapes.find(body or ""))
                size += len(held[-1][1])
                if size >= ROWS:
                    yield _with_found(b.slice(lo, len(held)), held, searches, attrs)
                    held, lo, size = [], i + 1, 0
            if held:
                yield _with_found(b.slice(lo, len(held)), held, searches, attrs)

    return nodes.select(*PAGE, "body", *rest).mapInArrow(read, schema)


def _lists(sizes: Iterable[int], **columns: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _flat(parts: Iterable[list], kind: pa.DataType) -> pa.Array:
    return pa.array(list(chain.from_iterable(parts)), kind)


def _with_found(pages: pa.RecordBatch, held: list[tuple], searches: dict[str, tuple[str, dict[str, str]]], attrs: dict[str, tuple[str, ...]]) -> pa.RecordBatch:
    """Pages with what was found in them, in place of their bodies."""
    out = {name: c for name, c in zip(pages.schema.names, pages.columns, strict=True) if name != "body"}
    at, asked = count(), count()
    for k, (name, (_, fields)) in enumerate(searches.items()):
        columns = {"row": _flat([shape.rows[k] for shape, _, _ in held], pa.int32())}
        for field in fields:
            i = next(at)
            found = {"n": _flat([shape.numbers[i] for shape, _, _ in held], pa.int32()), "t": _flat([texts[shape.parts[i]] for shape, texts, _ in held], pa.string())}
            for a in attrs.get(field, ()):
                j = next(asked)
                found[a] = _flat([values[shape.asked_parts[j]] for shape, _, values in held], pa.string())
            columns[field] = _lists(chain.from_iterable([shape.counts[i] for shape, _, _ in held]), **found)
        out[name] = _lists([len(shape.rows[k]) for shape, _, _ in held], **columns)
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(found), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found[lo : lo + ROWS], strict=True), ARROW, strict=True)], schema=ARROW)


def _batches(page: Page, last: bool = False) -> Iterator[pa.RecordBatch]:
    if last or len(page.done) >= ROWS:
        some, page.done = page.done, []
        yield from _rows(some)
