"""HTML to rows: a tree builder over the standard tokenizer, and the nodes table.

Filter the files before ``nodes``, and name the tags and columns that are wanted: the plan can't push a filter or a
projection through the parser, but the parser can leave out rows and fields before they are sent on.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: What belongs in the head as long as the body hasn't begun.
HEAD = frozenset("base link meta noscript script style template title".split())

#: Nodes that leave the parser at once, about.
BATCH_ROWS = 4096

NODES = "node_id int, parent_id int, ord int, depth int, kind string, tag string, attrs map<string,string>, text string, last_id int, tpl_root int, in_pre boolean, start int, end int, owner int, content string"


class Tree(HTMLParser):
    """rows: one list a node, in document order; offsets are code points of the source. A node's owner is the nearest
    element around it that conforms to a type.

    With ``whole``, the source is a document: html, head and body are put in where they are left out, as elements of
    no length, and blank text before the body's beginning is dropped unless it stands in the head.
    """

    def __init__(self, source: str, whole: bool = False):
        super().__init__(convert_charrefs=True)
        self.source, self.rows, self.open, self.whole = source, [], [], whole
        self.frame: dict[str, int] = {}  # html, head and body, where they have begun
        self.lines = [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(source)
        self.close()
        if whole and source:
            self.begin("body", len(source))
        self.pop_to(0, len(source))

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def add(self, kind: str, tag: str | None, attrs: dict | None, text: str | None, start: int, end: int) -> int:
        parent = self.open[-1] if self.open else None
        up = self.rows[parent] if parent is not None else None
        n = len(self.rows)
        template = None if up is None else parent if up[5] == "template" else up[9]
        pre = up is not None and (up[5] == "pre" or up[10])
        order = 0 if up is None else up[14]
        owner = None if up is None else parent if "data-conforms-to" in up[6] and template is None else up[13]
        if up is not None:
            up[14] += 1
        self.rows.append([n, parent, order, len(self.open), kind, tag, attrs, text, n, template, pre, start, end, owner, 0])
        return n

    def pop_to(self, depth: int, end: int) -> None:
        while len(self.open) > depth:
            row = self.rows[self.open.pop()]
            row[8], row[12] = len(self.rows) - 1, end

    def begin(self, name: str, at: int) -> None:
        """The document's html, head or body has begun."""
        if name in self.frame:
            return
        if name != "html":
            self.begin("html", at)
        if name == "body":
            self.begin("head", at)
            self.pop_to(1, at)
        self.frame[name] = self.add("element", name, {}, None, at, at)
        self.open.append(self.frame[name])

    def framed(self, tag: str | None, at: int) -> None:
        """Begin what must have begun before an element of the tag, or text."""
        if tag in HEAD and "body" not in self.frame:
            self.begin("head", at)
        elif tag not in ("html", "head", "body"):
            self.begin("body", at)

    def handle_starttag(self, tag, attrs):
        at = self.here()
        if self.whole and (not self.open or self.rows[self.open[-1]][5] in ("html", "head")):
            self.framed(tag, at)
        if self.whole and tag in ("html", "head", "body"):
            if tag not in self.frame:
                self.begin(tag, at)
                row = self.rows[self.frame[tag]]
                row[6], row[11], row[12] = {k: v or "" for k, v in reversed(attrs)}, at, at + len(self.get_starttag_text())
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[i]][5]
            if (tag in CLOSES_P and name == "p") or name in CLOSES.get(tag, ()):
                self.pop_to(i, at)
                break
            if name in ("div", "table", "ul", "ol", "body", "template", "article", "nav"):
                break
        n = self.add("element", tag, {k: v or "" for k, v in reversed(attrs)}, None, at, at + len(self.get_starttag_text()))
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self.pop_to(len(self.open) - 1, self.rows[self.open[-1]][12])

    def handle_endtag(self, tag):
        if self.whole and tag in ("html", "body"):
            return  # what follows still belongs to the body
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][5] == tag:
                at = self.here()
                self.pop_to(i, self.source.find(">", at) + 1 or len(self.source))
                return

    def handle_data(self, data):
        at = self.here()
        if self.whole and (not self.open or self.rows[self.open[-1]][5] in ("html", "head")):
            if not data.strip():
                if not self.open or "body" not in self.frame and self.rows[self.open[-1]][5] == "html":
                    return
            else:
                self.framed(None, at)
        self.add("text", None, None, data, at, at + len(data))

    def handle_comment(self, data):
        at = self.here()
        self.add("comment", None, None, data, at, at + len(data) + 7)


def parse(source: str | None, whole: bool = False) -> list[list]:
    return [row[:14] for row in Tree(source or "", whole).rows]


def with_content(rows: list[list]) -> list[list]:
    """rows with the text of the whole subtree of children of conforming elements, of elements of one's own (with a
    hyphen in the tag), and of titles, scripts and styles; null for other nodes, so text isn't repeated for each level."""
    texts = [(r[0], r[7]) for r in rows if r[4] == "text"]
    at, out = [n for n, _ in texts], []
    for r in rows:
        content = None
        if r[4] == "element" and (r[5] in ("script", "style", "title") or "-" in r[5] or r[1] is not None and "data-conforms-to" in (rows[r[1]][6] or {})):
            content = "".join(x for _, x in texts[bisect.bisect_left(at, r[0]) : bisect.bisect_right(at, r[8])])
        out.append([*r, content])
    return out


_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def nodes(files: DataFrame, key: str, html: str, whole: bool = False, tags: Iterable[str] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """One row for each element, text and comment of each file; null and empty files have none.

    tags: only elements of these; columns: only these, in their order of NODES.
    """
    picked = files.select(F.col(key).alias("_key"), F.col(html).cast("string").alias("_html"))
    kind = picked.schema["_key"].dataType.simpleString()
    fields = [x.split(" ", 1) for x in NODES.split(", ")]
    wanted = set(columns) if columns is not None else {n for n, _ in fields}
    at = [i for i, (n, _) in enumerate(fields) if n in wanted]
    kept = frozenset(tags) if tags is not None else None

    names, types = ["_key", *(fields[i][0] for i in at)], [_ARROW[fields[i][1]] for i in at]

    def made(batch: pa.RecordBatch, of: list[int], rows: list[list]) -> pa.RecordBatch:
        cols = [pa.array([list(r[j].items()) if isinstance(r[j], dict) else r[j] for r in rows], t) for j, t in zip(at, types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, held = [], []
            for i, source in enumerate(batch.column(1).to_pylist()):
                rows = parse(source, whole)
                if "content" in wanted:
                    rows = with_content(rows)
                if kept is not None:
                    rows = [r for r in rows if r[4] == "element" and r[5] in kept]
                of += [i] * len(rows)
                held += rows
                if len(held) >= BATCH_ROWS:
                    yield made(batch, of, held)
                    of, held = [], []
            if held:
                yield made(batch, of, held)

    return picked.mapInArrow(run, ", ".join([f"_key {kind}", *(" ".join(fields[i]) for i in at)])).withColumnRenamed("_key", key)
