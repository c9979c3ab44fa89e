"""Documents back to text, and places of attributes in their source.

A document without an ``html`` element is put inside one. Null reads as the empty document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.html import VOID, Tree

_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_PLACES = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n in ("tag", "name", "value") else T.IntegerType()) for n in ("tag", "name", "value", "start", "end")]))
_RAW = frozenset(("script", "style"))


class _Attributes(Tree):
    def __init__(self, source: str):
        self.places: list[dict] = []
        super().__init__(source)

    def handle_starttag(self, tag, attrs):
        at, text = self.here(), self.get_starttag_text()
        super().handle_starttag(tag, attrs)
        row = self.rows[-1]
        if row[9] is not None or tag == "template":
            return
        seen = set()
        for m in _ATTR.finditer(text, 1 + len(tag)):
            name = m.group(1).lower()
            if name not in seen:
                seen.add(name)
                self.places.append({"tag": tag, "name": name, "value": row[6].get(name, ""), "start": at + m.start(), "end": at + m.end()})


def attributes(source: str | None) -> list[dict]:
    """Attributes outside templates with their place, name to closing quote; the first of a name counts."""
    return _Attributes(source or "").places


def _blank(text: str) -> bool:
    return not text.strip()


def serialize(source: str | None, indent: bool = False) -> str:
    """The document as it is stored: blank runs of line breaks outside pre collapsed, raw text unable to close itself.

    With ``indent``, each element child of an element with ``data-conforms-to`` gets its own line, two spaces for
    each such element around it; blank text between goes. Contents of templates are left as they are.
    """
    rows = Tree(source or "").rows
    children: dict[int | None, list[list]] = {}
    for row in rows:
        children.setdefault(row[1], []).append(row)
    conforming = [row[4] == "element" and row[9] is None and "data-conforms-to" in row[6] for row in rows]
    depth = [0] * len(rows)  # conforming elements around a node
    for row in rows:
        if row[1] is not None:
            depth[row[0]] = depth[row[1]] + conforming[row[1]]
    out: list[str] = []
    todo: list = list(reversed([r for r in children.get(None, []) if r[5] == "html"][:1] or ["<html><head></head><body>", *(r for r in children.get(None, []) if r[4] != "text" or not _blank(r[7])), "</body></html>"]))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node[4] == "comment":
            out.append(f"<!--{node[7]}-->")
        elif node[4] == "text":
            parent = rows[node[1]][5] if node[1] is not None else None
            text = node[7]
            if parent in _RAW:
                text = text.replace(f"</{parent}", f"<\\/{parent}")
            else:
                text = re.sub(r"\n{2,}", "\n", text) if _blank(text) and not node[10] else text
                text = text.replace("&", "&amp;").replace(" ", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")
            out.append(text)
        else:
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(0xA0), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in reversed(node[6].items()))
            out.append(f"<{node[5]}{attrs}>")
            if node[5] in VOID:
                continue
            inner = children.get(node[0], [])
            if indent and conforming[node[0]]:
                n, laid, some = depth[node[0]], [], False
                for child in inner:
                    if child[4] == "text" and _blank(child[7]):
                        continue
                    if child[4] == "element":
                        laid.append("\n" + "  " * (n + 1))
                        some = True
                    laid.append(child)
                inner = [*laid, "\n" + "  " * n] if some else laid
            todo.append(f"</{node[5]}>")
            todo.extend(reversed(inner))
    return "".join(out)


@F.pandas_udf(T.StringType())
def serialized(s: pd.Series) -> pd.Series:
    return s.map(serialize)


@F.pandas_udf(T.StringType())
def reindented(s: pd.Series) -> pd.Series:
    return s.map(lambda x: serialize(x, indent=True))


@F.pandas_udf(_PLACES)
def attributes_of(s: pd.Series) -> pd.Series:
    return s.map(attributes)
