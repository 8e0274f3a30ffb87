"""HTML as rows: each element with its place, classes and attributes, and each piece of visible text as a row of its own.

The parser is the standard library's; what it yields is a table. An element's text isn't kept with the element: it is the pieces
between its own number and its ``last``, and selectors put together what is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg head nav".split())
#: The tag of a piece of text.
TEXT = "#text"

SCHEMA = "source_id string, url string, n int, last int, depth int, tag string, attrs map<string,string>, text string"
ARROW = pa.schema([("source_id", pa.string()), ("url", pa.string()), ("n", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
#: Rows of a page that are passed on at a time.
ROWS = 5000

# Plain markup, of which the parser makes just these pieces: text, end tags, and start tags with quoted attributes without references. Elements whose
# content is read in another way aren't plain.
OTHERWISE = "script|style|title|textarea|xmp|plaintext|iframe|noembed|noframes|noscript|svg|math"
PLAIN = re.compile(rf'[^<]+|</[a-zA-Z][a-zA-Z0-9-]*>|<(?!(?i:{OTHERWISE})\b)[a-zA-Z][a-zA-Z0-9-]*(?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_-]*(?:="[^"<>&]*")?)*>')
ATTRIBUTE = re.compile(r'[ \t\n]([a-zA-Z][a-zA-Z0-9_-]*)(?:="([^"]*)")?')
# No plain tag holds a > but at its end.
TAG = re.compile("<([^>]*)>")
BUT_MARKS = bytes(set(range(256)) - set(b"<>"))


def cut(body: str) -> list[str]:
    """A page's pieces, if its markup is plain: text and what stands between < and > by turns, from text to text. Else some tag isn't plain, or the last text holds a <."""
    marks = body.encode().translate(None, BUT_MARKS)
    return body.replace(">", "<").split("<") if marks == b"<>" * (len(marks) // 2) else TAG.split(body)


@lru_cache(10_000)
def start(tag: str) -> tuple[str, tuple]:
    """The name and the attributes of a plain start tag, given without its marks."""
    name = re.match("[a-zA-Z0-9-]+", tag)[0]
    attrs: dict[str, str] = {}
    at = len(name)
    while m := ATTRIBUTE.search(tag, at):
        attrs[m[1].lower()] = m[2] or ""
        at = m.end()
    return name.lower(), tuple(attrs.items())



class Nodes(HTMLParser):
    """Elements and texts in document order. An element's descendants are those numbered up to its ``last``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.last, self.depth, self.tag, self.attrs, self.text = [], [], [], [], []
        self.open: list[int] = []
        self.count: dict[str, int] = {}  # of open elements, by tag
        self.hidden = 0

    def read(self, body: str) -> None:
        """A whole page. Where all of it is plain markup it is cut in one go, into what feed would have found."""
        pieces = PLAIN.findall(body)
        if sum(map(len, pieces)) != len(body):
            self.feed(body)
        else:
            for p in pieces:
                if p[0] != "<":
                    self.handle_data(unescape(p) if "&" in p else p)
                elif p[1] == "/":
                    self.handle_endtag(p[2:-1].lower())
                else:
                    self.handle_starttag(*start(p[1:-1]))
        self.close()

    def _row(self, tag: str, attrs, text: str | None) -> int:
        n = len(self.last)
        self.last.append(n)
        self.depth.append(len(self.open))
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        return n

    def handle_starttag(self, tag, attrs):
        n = self._row(tag, attrs if type(attrs) is tuple else tuple((k, v or "") for k, v in dict(attrs).items()), None)
        if tag not in VOID:
            self.open.append(n)
            self.count[tag] = self.count.get(tag, 0) + 1
            self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        n = self.open.pop()
        self.last[n] = len(self.last) - 1
        tag = self.tag[n]
        self.count[tag] -= 1
        self.hidden -= tag in HIDDEN
        return tag

    def handle_data(self, data):
        if not self.hidden and (data := " ".join(data.split())):
            self._row(TEXT, (), data)

    def close(self):
        super().close()
        while self.open:
            self._close()


def nodes(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, body (text). The rows of a page come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, url, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = Nodes()
                tree.read(body or "")
                for lo in range(0, len(tree.last), ROWS):
                    part = slice(lo, lo + ROWS)
                    n = list(range(lo, min(lo + ROWS, len(tree.last))))
                    columns = [[source] * len(n), [url] * len(n), n, tree.last[part], tree.depth[part], tree.tag[part], tree.attrs[part], tree.text[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return pages.select("source_id", "url", "body").mapInArrow(run, SCHEMA)
