"""Tokens of script sources, with brackets paired: one pass that keeps a stack of what is open.

What a slash means hangs on what stands before it, and after a closing bracket on what that bracket belongs to: it
divides after a value (a name, a call, an index, an object, a function in an expression) and begins a regular expression
after an operator, a keyword that wants a value, the head of a statement, or a block. Templates hold expressions, which
hold templates. Markup within scripts is not read: its text is taken for code.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_ATOM = re.compile(
    r"""(?P<comment>/\*[\s\S]*?\*/|//[^\n  ]*)|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'|"(?:\\[\s\S]|[^"\\\n])*")"""
    r"""|(?P<number>\.?\d[\w.]*)|(?P<word>[#@]?(?:[^\W\d]|\$)[\w$]*)|(?P<mark>\?\.(?!\d)|\.\.\.|\+\+|--|=>|\S)"""
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(?:`|\$\{)?")

#: Words after which a value is still to come, and words whose parentheses head a statement.
_WANTS_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_HEADS = frozenset("if while for with switch".split())
_STATEMENT_FOLLOWS = frozenset("else do try finally".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    kind: str  # comment, string, template, regex, number, word, mark
    start: int
    end: int
    text: str


class _Open:
    """A bracket that is open, and what it is: a template's part, head of a statement, group, block, object, or body of a
    function or class that is a value. asked: conditions (?) in it that wait for a colon; value: its next braces are such a body."""

    def __init__(self, bracket: str, what: str):
        self.bracket, self.what, self.asked, self.value = bracket, what, 0, False


def scan(source: str | None) -> tuple[list[Token], str | None]:
    """All tokens in order, and the first bracket that is wrong (None if none is)."""
    source, out, wrong = source or "", [], None
    open_ = [_Open("", "block")]
    value = False  # what stands before is a value: a slash divides
    begins = True  # a statement begins here
    last = before = None  # the two tokens before, comments aside
    at = 0
    while m := _ATOM.search(source, at):
        kind, text, start, top = m.lastgroup, m.group(), m.start(), open_[-1]
        if kind == "comment":
            out.append(Token(kind, start, m.end(), text))
            at = m.end()
            continue
        if text == "/" and not value and (r := _REGEX.match(source, start)):
            kind, text = "regex", r.group()
        elif text == "`" or text == "}" and top.what == "template":
            kind, text = "template", text + _TEMPLATE.match(source, start + 1).group()
            if text[0] == "}":
                open_.pop()
            if text.endswith("${"):
                open_.append(_Open("{", "template"))
        at = start + len(text)
        out.append(Token(kind, start, at, text))
        was, starts, value, begins = value, begins, False, False
        member = last is not None and last.text in (".", "?.")
        if kind in ("string", "number", "regex"):
            value = True
        elif kind == "template":
            value = not text.endswith("${")
        elif kind == "word":
            value = member or text not in _WANTS_VALUE
            if not member and text in ("function", "class"):
                top.value = not (was or starts)
            begins = not member and (text in _STATEMENT_FOLLOWS or starts and text in ("export", "default", "async"))
        elif text in "([":
            head = text == "(" and last is not None and last.kind == "word" and (last.text in _HEADS and not (before and before.text in (".", "?.")) or last.text == "await" and before is not None and before.text == "for")
            open_.append(_Open(text, "head" if head else "group"))
        elif text == "{":
            block = starts or was or last is not None and last.text in ("=>", "export", "import", "type", *_STATEMENT_FOLLOWS)
            open_.append(_Open(text, "object" if not block else "body" if top.value else "block"))
            top.value, begins = False, block
        elif text in _CLOSES:
            if top.bracket != _CLOSES[text]:
                wrong = wrong or f"unexpected {text} at {start}"
            else:
                open_.pop()
                value = text == "]" or text == ")" and top.what != "head" or text == "}" and top.what in ("object", "body")
                begins = not value
        elif text == ";":
            begins = True
        elif text == "?":
            top.asked += source[at : at + 1] not in (":", "?", "=") and not (last is not None and last.text == "?")
        elif text == ":":
            if top.asked:
                top.asked -= 1
            else:
                begins = top.what in ("block", "body")
        elif text in ("++", "--") or text == "!" and was and source[at : at + 1] != "=":
            value, begins = was, starts
        before, last = last, out[-1]
    if wrong is None and len(open_) > 1:
        wrong = f"{open_[-1].bracket} is not closed"
    return out, wrong


def tokens(source: str | None) -> list[Token]:
    return scan(source)[0]


def partners(code: list[Token]) -> dict[int, int]:
    """Places of the brackets of code by those that they pair with; a bracket without one pairs with the end."""
    out, open_ = {}, []
    for i, t in enumerate(code):
        if t.kind == "mark" and t.text in "([{":
            open_.append(i)
        elif t.kind == "mark" and t.text in _CLOSES and open_ and code[open_[-1]].text == _CLOSES[t.text]:
            out[i] = open_.pop()
            out[out[i]] = i
    return {**{i: len(code) for i in open_}, **out}
