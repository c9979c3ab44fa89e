"""Functions that documents refer to by name: types' checks, audits, prose rules, modules and commands.

Nothing in a document is executed: its scripts say which function is meant, and the function is registered here.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import corpus, validate
from lectern.operators.prose import Rule
from lectern.sources.store import NodeStore, session_store


@dataclass
class Audit:
    """check gets the corpus' tables by name and returns rows whose first column is the violation's name."""

    name: str
    check: Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Registry:
    checks: dict[tuple[str, str], Callable[[dict], object]] = field(default_factory=dict)
    audits: dict[str, Audit] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)
    modules: dict[tuple[str, str], dict[str, object]] = field(default_factory=dict)

    def check(self, template_path: str, type_id: str):
        """The own check of a type: a function of one instance."""

        def add(fn):
            self.checks[template_path, type_id] = fn
            return fn

        return add

    def audit(self, name: str):
        """A check over all documents, under the name that a script's data-audits has."""

        def add(fn):
            self.audits[name] = Audit(name, fn)
            return fn

        return add

    def rule(self, name: str, pattern: str, needs: tuple[str, ...] = ()) -> None:
        """A rule for prose: a regular expression that no text may contain, and literals of which every match holds one."""
        re.compile(pattern)
        self.rules[name] = Rule(name, pattern, needs)

    def module(self, path: str, locator: str, **exports: object) -> None:
        """What a document's script exports; its commands are functions of a context, or tables of verbs."""
        self.modules[path, locator] = exports

    def load(self, path: str, locator: str) -> dict[str, object]:
        try:
            return self.modules[path, locator]
        except KeyError:
            raise LookupError(f"no module {path}#{locator}") from None


def prose(texts: DataFrame, key: str, text: str, rules: dict[str, Rule]) -> DataFrame:
    """key, rule of each rule that a text breaks; all rules in one scan of each text. ``operators.prose`` says where."""
    hits = [F.when(F.col(text).rlike(r.pattern), F.lit(r.name)) for r in rules.values()]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return texts.select(key, F.explode(found).alias("rule"))


def run_audits(registry: Registry, tables: dict[str, DataFrame], audits: DataFrame) -> DataFrame:
    """name, violation, state of every audit of audits(name, expects) that is registered.

    A violation that an audit's script declares is expected; one that is found and not declared, or declared and not
    found, is a failure. An audit without a function fails as such. What a check returns is only read here.
    """
    declared = audits.select("name", F.explode("expects").alias("violation"))
    found = None
    for name in sorted(registry.audits):
        rows = registry.audits[name].check(tables)
        rows = rows.select(F.lit(name).alias("name"), F.col(rows.columns[0]).cast("string").alias("violation"))
        found = rows if found is None else found.unionByName(rows)
    missing = audits.where(~F.col("name").isin(*registry.audits) if registry.audits else F.lit(True)).select("name", F.lit(None).cast("string").alias("violation"), F.lit("unregistered").alias("state"))
    if found is None:
        return missing
    named = audits.select("name").distinct()
    return validate.reconciled(found.join(named, "name", "left_semi"), declared.join(missing.select("name"), "name", "left_anti"), ["name", "violation"]).unionByName(missing)


#: Failures that a report names.
FAILURES = 20


def whole(spark, files: DataFrame, registry: Registry, store: NodeStore | None = None, failures: int = FAILURES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The check of a whole corpus: every instance's verdict, every audit's violations, and one row checked, fail, ok, failures.

    ok is whether neither an instance nor an audit fails. failures has the first ones by path, then place, so many at
    most: path, node_id and errors of an instance; audits' come after all of those, by name, then violation, without a
    node_id. The nodes come from the store, so a text is parsed once, and not again while the store has it.
    """
    nodes = (store or session_store(spark)).nodes(files)
    verdicts = corpus.verdicts(files, nodes, registry.checks)
    found = run_audits(registry, {"files": files, "nodes": nodes, "instances": corpus.instances(nodes)}, corpus.audits(nodes))
    named = F.concat_ws(": ", "name", "state", "violation")
    broken = validate.summary(found.select(named.alias("path"), F.lit(None).cast("int").alias("node_id"), (F.col("state") == "expected").alias("ok"), F.array(named).alias("errors")), failures)
    unplaced = F.transform("failures", lambda f: F.struct(F.lit(None).cast("string").alias("path"), f["node_id"].alias("node_id"), f["errors"].alias("errors")))
    broken = broken.select(F.col("fail").alias("audits"), unplaced.alias("more"))
    report = validate.summary(verdicts, failures).join(F.broadcast(broken), F.lit(True))  # both are a single row
    return verdicts, found, report.select("checked", "fail", ((F.col("fail") == 0) & (F.col("audits") == 0)).alias("ok"), F.slice(F.concat("failures", "more"), 1, failures).alias("failures"))


def read_stdin() -> str:
    return sys.stdin.buffer.read().decode()
