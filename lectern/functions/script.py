"""Scans of script sources that regular expressions alone can't do: comments, imports and exported commands.

Row functions over one source; the Arrow-batched column functions below wrap them. Null and empty sources give
empty arrays; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.lexer import Token, partners, scan, tokens

#: A script block as the text scan takes it (in this letter case, any tag whose name begins so), and its
#: double-quoted attributes: white space may stand round the equals sign, and id begins at a word's border.
BLOCK = r"<script([^>]*)>([\s\S]*?)</script>"
TYPE, ID = r'type\s*=\s*"([^"]*)"', r'\bid\s*=\s*"([^"]*)"'


def comments(source: str | None) -> list[dict]:
    """Block comments outside strings, in order."""
    return [{"start": t.start, "raw": t.text} for t in tokens(source) if t.text.startswith("/*")]


def _code(source: str | None) -> list[Token]:
    return [t for t in tokens(source) if t.kind != "comment"]


def imports(source: str | None) -> list[dict]:
    """Specifiers of import declarations, between their quotes; calls of import() and exports are none."""
    out, inside = [], False
    code = _code(source)
    for t, after in zip(code, [*code[1:], None], strict=False):
        if t.text == "import" and after is not None:
            inside = after.text not in ("(", ".")
        elif t.text in (";", "=", "("):
            inside = False
        elif inside and t.kind == "string":
            out.append({"start": t.start + 1, "end": t.end - 1, "spec": t.text[1:-1]})
            inside = False
    return out


class _Exports:
    """What a source exports that can be run, read off its tokens: functions, and tables of functions and further tables.

    A value is told by how it begins: a brace opens a table, a literal or an array is nothing to run, a name alone is
    looked up among the source's own declarations (one that isn't there, as it is imported, may be a function), and all
    else counts as a function.
    """

    def __init__(self, source: str | None):
        found = tokens(source)
        self.code = [t for t in found if t.kind != "comment"]
        self.pair = partners(self.code)
        self.doc: list[str] = []
        said = ""
        for t in found:
            if t.kind == "comment":
                said = t.text if t.text.startswith("/*") else ""
            else:
                self.doc.append(said)
                said = ""
        self.own: dict[str, tuple[str, tuple]] = {}  # top-level names: comment and value
        self.out: list[tuple[int, list[str], str, tuple]] = []
        self._statements()

    def text(self, i: int) -> str:
        return self.code[i].text if i < len(self.code) else ""

    def until(self, i: int, *marks: str) -> int:
        """The next of the marks from i on, brackets skipped; also a bracket that closes around i, or the end."""
        while i < len(self.code) and self.text(i) not in (*marks, ")", "]", "}"):
            i = self.pair[i] + 1 if self.text(i) in ("(", "[", "{") and self.code[i].kind == "mark" else i + 1
        return i

    def value(self, i: int) -> tuple:
        t, after = (self.code[i] if i < len(self.code) else None), self.text(i + 1)
        if t is None or t.kind in ("string", "number", "regex", "template") or t.text in ("[", "-", "+", "!", "null", "true", "false", "undefined", "class"):
            return ("nothing",)
        if t.text == "{":
            return ("table", i)
        alone = after in ("", ",", ";", ")", "}") or i + 1 < len(self.code) and self.code[i + 1].kind == "word"
        return ("name", t.text) if t.kind == "word" and alone and t.text not in ("async", "function", "new", "await") else ("function",)

    def _declared(self, i: int) -> list[tuple[int, str, tuple]]:
        """Place, name and value of each part of the declaration whose first name stands at i."""
        out = []
        while i < len(self.code) and self.code[i].kind == "word":
            equals = self.until(i + 1, "=", ",", ";")
            given = self.text(equals) == "="
            out.append((i, self.text(i), self.value(equals + 1) if given else ("nothing",)))
            i = equals + 1 if given else equals
            while i < len(self.code) and self.text(i) not in (",", ";", "export", "const", "let", "var", "import", ")", "]", "}"):
                i = self.pair[i] + 1 if self.text(i) in ("(", "[", "{") and self.code[i].kind == "mark" else i + 1
            if self.text(i) != ",":
                break
            i += 1
        return out

    def _statements(self) -> None:
        """Top-level declarations and exports."""
        i, code = 0, self.code
        while i < len(code):
            at, exported = i, self.text(i) == "export"
            i += exported
            word = self.text(i)
            default = exported and word == "default"
            j = i + default
            plain = self.text(j) == "function" or self.text(j) == "async" and self.text(j + 1) == "function"
            if plain:
                k = j + 1 + (self.text(j) == "async")
                k += self.text(k) == "*"
                name = self.text(k) if k < len(code) and code[k].kind == "word" else ""
                if name:
                    self.own.setdefault(name, (self.doc[at], ("function",)))
                if exported:
                    self.out.append((at, [] if default else [name], self.doc[at], ("function",)))
                i = self.until(k, "{")
            elif default:
                self.out.append((at, [], self.doc[at], self.value(j)))
                i = j
            elif word in ("const", "let", "var") and not (at and self.text(at - 1) in (".", "?.", "as")):
                for place, name, value in self._declared(i + 1):
                    doc = self.doc[at] if place == i + 1 else self.doc[place]
                    self.own.setdefault(name, (doc, value))
                    if exported:
                        self.out.append((place, [name], doc, value))
                i += 1
            elif exported and word == "{":
                self._named(i)
            if i < len(code) and code[i].kind == "mark" and self.text(i) in ("(", "[", "{"):
                i = self.pair[i]
            i += 1

    def _named(self, i: int) -> None:
        """export { a, b as c } [from ...]"""
        end = self.pair[i]
        away = self.text(end + 1) == "from"
        j = i + 1
        while j < end:
            stop = min(self.until(j, ","), end)
            words = [self.text(k) for k in range(j, stop)]
            if words and words[0] != "type":
                self.out.append((j, [] if words[-1] == "default" else [words[-1].strip("'\"")], self.doc[j], ("function",) if away else ("name", words[0])))
            j = stop + 1

    def _entries(self, i: int) -> list[tuple[str, str, tuple]]:
        """Key, comment and value of each entry of the table that opens at i; spread tables are its own."""
        out, end, j = [], self.pair[i], i + 1
        while j < end:
            doc = self.doc[j]
            if self.text(j) == "...":
                out.append(("", doc, self.value(j + 1)))
            else:
                while self.text(j) == "*" or self.text(j) in ("async", "get", "set") and self.text(j + 1) not in (",", ":", "(", "}"):
                    j += 1
                if j >= len(self.code):
                    break
                t = self.code[j]
                key = _cooked(t.text) if t.kind == "string" else t.text if t.kind in ("word", "number") else None
                k = self.pair.get(j, j) + 1
                value = self.value(k + 1) if self.text(k) == ":" else ("name", key) if self.text(k) in (",", "}") else ("function",)
                if key is not None:
                    out.append((key, doc, value))
            j = self.until(j, ",") + 1
        return out

    def commands(self) -> list[dict]:
        todo = [(path, doc, value, frozenset(path if value[0] == "table" else ())) for _, path, doc, value in sorted(self.out, key=lambda x: x[0])][::-1]
        out = []
        while todo:
            path, doc, value, seen = todo.pop()
            if value[0] == "name":
                name = value[1]
                known = self.own.get(name)
                value = ("nothing",) if name in seen else ("function",) if known is None else known[1]
                doc, seen = doc or (known[0] if known else ""), seen | {name}
                if value[0] == "name":
                    todo.append((path, doc, value, seen))
            if value[0] == "function" and (not path or path[-1]):
                out.append({"path": path, "raw": doc})
            elif value[0] == "table" and path:  # a default export must be a function
                own = self._entries(value[1])
                todo += [(path + [key] if key else path, text, v, seen) for key, text, v in own][::-1]
        return out


def commands(source: str | None) -> list[dict]:
    """path ([] for the default export; of a table's entries the words that lead to it) and raw comment of each exported
    function, in order. A later entry of a path replaces an earlier one's comment, as it would its function."""
    out: dict[tuple[str, ...], dict] = {}
    for c in _Exports(source).commands():
        out[tuple(c["path"])] = c
    return list(out.values())


def hash_imports(source: str | None) -> list[dict]:
    """Specifiers that name a sibling script by '#locator': their place with quotes, quote and locator.

    A specifier is the string after ``from`` or ``import``, with an opening parenthesis or without.
    """
    out, after = [], False
    for t in _code(source):
        x = t.text
        if after and t.kind == "string" and x[1:2] == "#" and not re.search("['\"]", x[1:-1]):
            out.append({"start": t.start, "end": t.end, "quote": x[0], "locator": x[2:-1]})
        after = x in ("from", "import") or after and x == "("
    return out


def blocks(html: str | None) -> list[dict]:
    """Script blocks as the text scan sees them, with the place of their text in the document."""
    found = enumerate(re.finditer(BLOCK, html or ""))
    value = lambda p, attrs: m.group(1) if (m := re.search(p, attrs)) else ""
    return [{"idx": i, "type": value(TYPE, m.group(1)), "id": value(ID, m.group(1)), "start": m.start(2), "source": m.group(2)} for i, m in found]


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def _cooked(literal: str) -> str:
    """The text that a quoted literal stands for."""
    one = lambda m: chr(int(m[2] or m[3] or m[4], 16)) if m[2] or m[3] or m[4] else _ESCAPES.get(m[1], m[1])
    return re.sub(r"\\(u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|[\s\S])", one, literal[1:-1])


def literals(source: str | None) -> list[str]:
    """Texts of string literals, and of templates without parts to fill in."""
    whole = lambda t: t.kind == "string" or t.kind == "template" and len(t.text) > 1 and t.text[0] == t.text[-1] == "`"
    return [_cooked(t.text) for t in tokens(source) if whole(t)]


def trouble(source: str | None) -> str | None:
    """Why a source's commands can't be read: a bracket that doesn't close what is open; None if nothing is wrong."""
    return scan(source)[1]


def _column(fn, kind: str):
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action=None)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    types = {"int": T.IntegerType(), "string": T.StringType(), "strings": T.ArrayType(T.StringType())}
    fields = [T.StructField(name, types[t]) for name, t in (x.split(": ") for x in kind.split(", "))]
    return F.pandas_udf(run, T.ArrayType(T.StructType(fields)))


comments_of = _column(comments, "start: int, raw: string")
imports_of = _column(imports, "start: int, end: int, spec: string")
commands_of = _column(commands, "path: strings, raw: string")
hash_imports_of = _column(hash_imports, "start: int, end: int, quote: string, locator: string")
blocks_of = _column(blocks, "idx: int, type: string, id: string, start: int, source: string")


@F.pandas_udf(T.ArrayType(T.StringType()))
def literals_of(s: pd.Series) -> pd.Series:
    return s.map(literals)


@F.pandas_udf(T.StringType())
def trouble_of(s: pd.Series) -> pd.Series:
    return s.map(trouble)
