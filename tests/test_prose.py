"""Prose rules by units against one rule at a time, and audits as table functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern import registry, tables
from lectern.operators import prose

RULES = [prose.Rule("loud", "[A-Z]{3,}!", ("!",)), prose.Rule("twice", r"\b(\w+) \1\b"), prose.Rule("the", "the (the|a)", ("the the", "the a")), prose.Rule("empty", "x*")]


@pytest.mark.parametrize("units", ["sentence", "block", "comment", "text"])
def test_findings_like_one_rule_at_a_time(spark, units):
    rng = random.Random(4)
    words = ["the", "a", "and", "WOW!", "x.", "é", "\n", "\n\n", "/*", "*/", "?", "😀", "wow"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(80)] + [(80, None), (81, ""), (82, "the a " * 20000)]
    df = spark.createDataFrame(texts, "unit long, start string")  # names of the result's
    got = sorted(map(tuple, prose.findings(df, "unit", "start", RULES, units).toDF("key", "unit", "rule", "start", "end").collect()))
    want = []
    for key, text in texts:
        for u, (a, b) in enumerate(prose.UNITS[units](text or "")):
            want += [(key, u, r.name, a + m.start(), a + m.end()) for r in RULES for m in re.finditer(r.pattern, (text or "")[a:b]) if m.end() > m.start()]
    assert got == sorted(want)
    assert all(a < b and (not i or spans[i - 1][1] <= a) for _, t in texts for spans in [prose.UNITS[units](t or "")] for i, (a, b) in enumerate(spans))


def test_expressions_run_only_where_a_literal_lies():
    rules = prose.Rules([prose.Rule(f"r{i}", f"word{i} [0-9]+", (f"word{i} ",)) for i in range(500)])
    text = " ".join(f"Nothing here{i}." for i in range(1000)) + " word7 12. word7 x. word499 5."
    found = list(rules.found(text, prose.UNITS["sentence"]))
    assert [(r, text[a:b]) for _, r, a, b in found] == [("r7", "word7 12"), ("r499", "word499 5")] and rules.tried == 3


def gaps():
    """A check of numbers of a key that don't follow one another; made here, so that it is sent whole to the workers."""

    class Gaps(tables.Check):
        def __init__(self):
            self.last = None

        def see(self, row):
            if self.last is not None and row["n"] != self.last + 1:
                yield f"after {self.last}"
            self.last = row["n"]

        def end(self):
            yield f"ends {self.last}"

    return Gaps


def test_one_audit_both_ways(spark):
    known = registry.Registry()
    rows = spark.createDataFrame([(k, n) for k in ("a", "b", None) for n in (1, 2, 4, 5)] + [("c", 1)], "k string, n int").repartition(5)
    tables.register(spark, known, "number-gaps", gaps(), lambda t: t["rows"], "k", "n")
    want = {(k, v) for k in ("a", "b", None) for v in ("after 2", "ends 5")} | {("c", "ends 1")}
    assert {tuple(r) for r in tables.audited(spark, "number-gaps", rows, "k", "n").collect()} == want
    rows.createOrReplaceTempView("numbers")
    assert {tuple(r) for r in spark.sql("SELECT k, violation FROM number_gaps(TABLE(numbers) PARTITION BY (k) ORDER BY (n), 'k')").collect()} == want
    audits = spark.createDataFrame([("number-gaps", ["after 2 a", "ends 5 a"])], "name string, expects array<string>")
    states = {(r.violation, r.state) for r in registry.run_audits(known, {"rows": rows}, audits).collect()}
    assert ("after 2 a", "expected") in states and ("ends 1 c", "unexpected") in states and len(states) == 7
    assert tables.audited(spark, "number-gaps", rows.limit(0), "k", "n").count() == 0
    kinds = dict(tables.audited(spark, "number-gaps", rows.withColumn("k", F.col("n").cast("long")), "k").dtypes)
    assert kinds == {"k": "bigint", "violation": "string"}
    with pytest.raises(Exception, match="no column z"):
        spark.sql("SELECT * FROM number_gaps(TABLE(numbers) PARTITION BY (k), 'z')").collect()


def test_hollow_actions(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, False), (2, None), (3, None)], "action int, has boolean")
    tables.register(spark, registry.Registry(), "hollow-action", tables.Hollow, lambda t: t["rows"], "action")
    assert {r.action for r in tables.audited(spark, "hollow-action", rows, "action").collect()} == {2, 3}
