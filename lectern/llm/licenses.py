"""License scans by template-markup matching.

A template is license wording with markup: ``[[ ... ]]`` is an optional region
and ``<<name:min-max>>`` a replaceable one of min to max words.  Each template
is compiled into a token automaton over word hashes; a run of words is accepted
when all mandatory wording matches exactly, in order, with nothing between but
what the markup allows.  Words are letters and digits, A-Z lower-cased, so
punctuation and layout never matter.

An automaton is started only where the template's first mandatory words stand;
that is found for a whole slice of documents at once, over whole texts.  Regions
before them are matched backwards from there.  A span takes the fewest words that
the regions before the first mandatory word need, and the most after it.

Null and empty texts have no words, places or labels and a score of 0; repeated
rows give repeated results; spans of one start are listed by their end, then label;
extra columns, whatever their names, play no part; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv

#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed wording: public license notices, with our markup.
TEMPLATES = {
    "mit": [
        "[[[[the]] mit license [[mit]]]] [[copyright <<holder:1-20>>]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "licensed under the [[terms of the]] mit [[open source]] license",
        "released under the [[terms of the]] mit [[open source]] license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 [[0]]",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache license version 2 0 january 2004",
    ],
    "gpl": [
        "licensed under the [[terms of the]] gnu general public license [[version <<number:1-1>>]]",
        "<<program:1-8>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<number:1-1>> of the license or at your option any later version",
    ],
    "lgpl": ["licensed under the [[terms of the]] gnu lesser general public license [[version <<number:1-2>>]]"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "licensed under the [[terms of the]] bsd <<clauses:0-3>> license",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by-nc": [
        "licensed under a creative commons attribution noncommercial [[<<number:1-2>> international]] license",
        "licensed under cc by nc [[<<kind:1-1>>]] [[<<number:1-2>>]]",
    ],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike [[<<number:1-2>> international]] license", "licensed under cc by sa [[<<number:1-2>>]]"],
    "cc-by": ["licensed under a creative commons attribution <<number:1-2>> international license"],
    "cc0": ["<<author:0-6>> has waived all copyright and related or neighboring rights to this work"],
    "all-rights-reserved": ["[[copyright <<holder:1-12>>]] all rights reserved"],
}

ANCHOR = 3


class Automaton:
    """A run of template elements: a word's hash, a gap (min, max), or an optional list of elements.

    States are (place in ``steps``, words of a gap used); a step is ('word', hash), ('gap', min, max)
    or ('skip', place to go on at instead).
    """

    def __init__(self, elements: list):
        self.steps: list[tuple] = []
        self._add(elements)

    def _add(self, elements: list) -> None:
        for x in elements:
            if isinstance(x, list):
                at = len(self.steps)
                self.steps.append(("skip", None))
                self._add(x)
                self.steps[at] = ("skip", len(self.steps))
            else:
                self.steps.append(("gap", *x) if isinstance(x, tuple) else ("word", x))

    def closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, seen = list(states), set(states)
        while todo:
            at, used = todo.pop()
            if at >= len(self.steps):
                continue
            step, nexts = self.steps[at], []
            if step[0] == "skip":
                nexts = [(at + 1, 0), (step[1], 0)]
            elif step[0] == "gap" and used >= step[1]:
                nexts = [(at + 1, 0)]
            for x in nexts:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def match(self, h: np.ndarray, start: int, longest: bool = True) -> int:
        """The end of the longest (or shortest) run of words from start that is accepted, or -1."""
        states, end = self.closure({(0, 0)}), -1
        for i in range(start, len(h) + 1):
            if any(at >= len(self.steps) for at, _ in states):
                end = i
                if not longest:
                    break
            if i == len(h) or not states:
                break
            word, nexts = h[i], set()
            for at, used in states:
                if at < len(self.steps):
                    step = self.steps[at]
                    if step[0] == "word" and step[1] == word:
                        nexts.add((at + 1, 0))
                    elif step[0] == "gap" and used < step[2]:
                        nexts.add((at, used + 1))
            states = self.closure(nexts)
        return end


@dataclass
class Template:
    """Its automaton is cut at the first mandatory words: the part before runs backwards from them."""

    label: str
    anchor: list[np.uint64]
    before: Automaton
    after: Automaton

    def match(self, h: np.ndarray, start: int) -> tuple[int, int] | None:
        """First word and end of the run accepted around an anchor at start: as few words before it as will do, as many after."""
        back = self.before.match(h[:start][::-1], 0, longest=False)
        end = self.after.match(h, start) if back >= 0 else -1
        return (start - back, end) if end >= 0 else None


def _reversed(elements: list) -> list:
    return [_reversed(x) if isinstance(x, list) else x for x in reversed(elements)]


def compile_template(label: str, text: str) -> Template:
    open_: list[list] = [[]]
    for token in re.findall(r"\[\[|\]\]|<<\w+:\d+-\d+>>|[^\s\[\]<>]+", text):
        if token == "[[":
            open_.append([])
        elif token == "]]":
            done = open_.pop()
            open_[-1].append(done)
        elif token.startswith("<<"):
            open_[-1].append(tuple(map(int, re.findall(r"\d+", token.split(":")[1]))))
        else:
            open_[-1].append(tv.hash_of(token))
    top = open_[0]
    mandatory = [not isinstance(x, list | tuple) for x in top]
    if len(open_) > 1 or not any(mandatory):
        raise ValueError(f"not a template with mandatory words: {text!r}")
    at = mandatory.index(True)
    size = next((i for i in range(1, ANCHOR) if at + i >= len(top) or not mandatory[at + i]), ANCHOR)
    return Template(label, top[at : at + size], Automaton(_reversed(top[:at])), Automaton(top[at:]))


def automata(templates: dict[str, list[str]]) -> list[Template]:
    return [compile_template(label, t) for label, ts in templates.items() for t in ts]


def places(h: np.ndarray, doc: np.ndarray, phrase: list[np.uint64]) -> np.ndarray:
    """Where the phrase's words stand consecutively in one document."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for i, x in enumerate(phrase[1:], 1):
        at = at[h[at + i] == x]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def license_scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row for each row of df: places of the phrases, labels, and the matched spans.

    score is the share of the text's words that lie in an accepted span; spans holds
    label:first:end in words, of the templates' matches.
    """
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    built: list = []

    def run(s: tv.Slice) -> dict:
        if not built:
            built.append(([([tv.hash_of(w) for w in p.split()], label) for p, label in phrases.items()], automata(templates)))
        known, machines = built[0]
        w = tv.words(s, tv.ALNUM)
        h, doc, of = tv.hashes(s, w), w.doc, w.of
        base: dict[int, list[tuple[int, int, str]]] = {}
        extra: dict[int, list[tuple[int, int, str]]] = {}
        for phrase, label in known:
            for at in places(h, doc, phrase):
                d = int(doc[at])
                base.setdefault(d, []).append((int(at - of[d]), int(at - of[d]) + len(phrase), label))
        for m in machines:
            for at in places(h, doc, m.anchor):
                d = int(doc[at])
                span = m.match(h[of[d] : of[d + 1]], int(at - of[d]))
                if span:
                    extra.setdefault(d, []).append((*span, m.label))
        n_words = w.counts.astype(np.int64)
        n_base, first, last = np.zeros(s.n, np.int64), [None] * s.n, [None] * s.n
        base_labels, labels, spans, score = [""] * s.n, [""] * s.n, [""] * s.n, np.zeros(s.n)
        for d in base.keys() | extra.keys():
            b, e = base.get(d, []), sorted(extra.get(d, []))
            n_base[d] = len(b)
            if b:
                first[d], last[d] = min(b)[0], max(b)[0]
            base_labels[d] = ",".join(sorted({x[2] for x in b}))
            labels[d] = ",".join(sorted({x[2] for x in b + e}))
            spans[d] = ",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in e)
            covered = np.zeros(n_words[d], bool)
            for i, j, _ in b + e:
                covered[i:j] = True
            score[d] = covered.mean()
        return {"n_words": n_words, "n_base": n_base, "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()), "base_labels": base_labels, "labels": labels, "score": score, "spans": spans}

    return _spark.map_text(df, [id_col], text, schema, run)
