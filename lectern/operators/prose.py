"""Rules for prose over text units: sentences, blocks between blank lines, comments of scripts, or texts as they are.

A rule is a regular expression that no unit may contain, and may name literals of which every match holds one. One pass
of an automaton over a text finds the literals of all rules at once, so that a rule's expression runs only on units where
it can match, however many rules there are; a rule without literals runs on every unit. Places are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import script
from lectern.operators import corpus
from lectern.operators import selectors as sel

Spans = list[tuple[int, int]]

#: A sentence with what ends it, and lines up to a blank one.
SENTENCE, BLOCK = re.compile(r"[^.!?]+[.!?]*"), re.compile(r"(?:[^\n]*\S[^\n]*(?:\n|\Z))+")

#: Ways to cut a text; each gives the units' places in order.
UNITS: dict[str, Callable[[str], Spans]] = {
    "sentence": lambda text: [m.span() for m in SENTENCE.finditer(text)],
    "block": lambda text: [m.span() for m in BLOCK.finditer(text)],
    "comment": lambda text: [(c["start"], c["start"] + len(c["raw"])) for c in script.comments(text)],
    "text": lambda text: [(0, len(text))] if text else [],
}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    needs: tuple[str, ...] = field(default=())


class Rules:
    """Compiled rules: which units each can match in, and where it does."""

    def __init__(self, rules: list[Rule]):
        self.names, self.patterns = [r.name for r in rules], [re.compile(r.pattern) for r in rules]
        self.always = [i for i, r in enumerate(rules) if not r.needs]
        by_literal: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for literal in r.needs:
                by_literal.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, of in by_literal.items():
            self.automaton.add_word(literal, (len(literal), of))
        if by_literal:
            self.automaton.make_automaton()
        self.tried = 0

    def candidates(self, text: str, spans: Spans) -> list[tuple[int, int]]:
        """(unit, rule) that can match: those whose literal lies in the unit, and rules without literals everywhere."""
        out = {(u, r) for u in range(len(spans)) for r in self.always}
        if len(self.automaton):
            starts = [a for a, _ in spans]
            for last, (length, of) in self.automaton.iter(text):
                unit = bisect.bisect_right(starts, last - length + 1) - 1
                if unit >= 0 and last < spans[unit][1]:
                    out.update((unit, r) for r in of)
        return sorted(out)

    def found(self, text: str, cut: Callable[[str], Spans]) -> Iterator[tuple[int, str, int, int]]:
        """unit, rule, start, end of each match that isn't empty."""
        spans = cut(text)
        for unit, r in self.candidates(text, spans):
            a, b = spans[unit]
            self.tried += 1
            for m in self.patterns[r].finditer(text[a:b]):
                if m.end() > m.start():
                    yield unit, self.names[r], a + m.start(), a + m.end()


def findings(texts: DataFrame, key: str, text: str, rules: list[Rule], units: str = "sentence") -> DataFrame:
    """key, unit (from 0 in each text), rule, start, end of every place that breaks a rule; a null text has no units."""
    for r in rules:
        re.compile(r.pattern)
    cut = units
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        known = Rules(rules)
        for batch in batches:
            of, out = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                for row in known.found(x, UNITS[cut]) if x else ():
                    of.append(i)
                    out.append(row)
            if out:
                unit, rule, start, end = zip(*out, strict=True)
                cols = [pa.array(unit, pa.int32()), pa.array(rule), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *cols], names=["_key", "unit", "rule", "start", "end"])

    picked = texts.selectExpr(f"`{key}`", f"CAST(`{text}` AS STRING) AS _text")
    return picked.mapInArrow(run, f"_key {kind}, unit int, rule string, start int, `end` int").toDF(key, "unit", "rule", "start", "end")


def of_corpus(files: DataFrame, nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, kind, place, unit, rule, start, end over everything in a corpus that is written to be read: the texts of documents
    by sentence (outside scripts, styles and templates; place is the text's node), Markdown files by block and scripts'
    comments (place is the script's index). Places are those in the node, file or script."""
    raw = nodes.where(sel.raw_text()).select("path", F.col("node_id").alias("parent_id"))
    texts = nodes.where((F.col("kind") == "text") & F.col("tpl_root").isNull()).join(raw, ["path", "parent_id"], "left_anti")
    own = {
        "sentence": texts.select("path", F.col("node_id").alias("place"), "text"),
        "block": files.where(F.col("path").endswith(".md")).select("path", F.lit(0).alias("place"), F.col("content").alias("text")),
        "comment": corpus.scripts(nodes).select("path", F.col("idx").alias("place"), F.col("source").alias("text")),
    }
    parts = [findings(x.select(F.struct("path", "place").alias("at"), "text"), "at", "text", rules, unit).select("at.path", F.lit(unit).alias("kind"), "at.place", "unit", "rule", "start", "end") for unit, x in own.items()]
    return reduce(DataFrame.unionByName, parts)
