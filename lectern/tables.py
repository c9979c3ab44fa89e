"""Audits as table functions: a check that sees the rows of one key after another, callable from SQL and as a DataFrame audit.

A check is a class: ``see(row)`` gets each row of a key, as a dict, ``end()`` is called after the last; both give the
violations found, if any. It holds what it must remember of one key, never the rows. Registered under a name it is

    SELECT * FROM name(TABLE(rows) PARTITION BY (key) [ORDER BY (...)], 'key')

whose result has the key's column as it is in the rows, and violation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from lectern.registry import Audit, Registry


class Check:
    """What a check may leave out."""

    def see(self, row: dict) -> Iterable[str]:
        return ()

    def end(self) -> Iterable[str]:
        return ()


def table_function(make: Callable[[], Check]):
    """The table function of a check: rows, partitioned by a key, and the key's name."""

    class Audited:
        def __init__(self):
            self.check, self.key, self.seen = make(), None, False

        @staticmethod
        def analyze(rows: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(key.value, str):
                raise ValueError("a table and its key's name are wanted")
            kinds = {f.name: f.dataType for f in rows.dataType}
            if key.value not in kinds:
                raise ValueError(f"the rows have no column {key.value}")
            return AnalyzeResult(T.StructType([T.StructField(key.value, kinds[key.value]), T.StructField("violation", T.StringType())]))

        def eval(self, row, key: str) -> Iterator[tuple]:
            self.key, self.seen = row[key], True
            for violation in self.check.see(row.asDict()):
                yield self.key, violation

        def terminate(self) -> Iterator[tuple]:
            if self.seen:
                for violation in self.check.end():
                    yield self.key, violation

    return udtf(Audited)


def register(spark: SparkSession, known: Registry, name: str, make: Callable[[], Check], rows: Callable[[dict[str, DataFrame]], DataFrame], key: str, order: str = "") -> None:
    """Register a check under one name both ways: as a table function of the session, and as the registry's audit over
    rows(tables), of which each key's rows meet the check in the given order. The audit's violations are 'violation key'."""
    spark.udtf.register(name.replace("-", "_"), table_function(make))

    def check(tables: dict[str, DataFrame]) -> DataFrame:
        return audited(spark, name, rows(tables), key, order).selectExpr(f"concat_ws(' ', violation, `{key}`) AS violation")

    known.audits[name] = Audit(name, check)


def audited(spark: SparkSession, name: str, rows: DataFrame, key: str, order: str = "") -> DataFrame:
    """key, violation of what a registered check finds in rows."""
    by = f"PARTITION BY (`{key}`)" + (f" ORDER BY ({order})" if order else "")
    return spark.sql(f"SELECT * FROM {name.replace('-', '_')}(TABLE({{rows}}) {by}, '{key}')", rows=rows)


class Hollow(Check):
    """An action that has neither detail nor commit; rows: has, which says of an element whether it is one."""

    def __init__(self):
        self.some = False

    def see(self, row: dict) -> Iterable[str]:
        self.some = self.some or bool(row["has"])
        return ()

    def end(self) -> Iterable[str]:
        return () if self.some else ("hollow",)


def actions(nodes: DataFrame, action: str, content: tuple[str, ...]) -> DataFrame:
    """document, has: of each conforming element of the tag action a row for itself, and one for each of its fields that says whether it is filled content."""
    from pyspark.sql import functions as F

    from lectern.operators import corpus
    from lectern.operators import selectors as sel

    own = nodes.where(sel.conforming() & (F.col("tag") == action)).select("path", "node_id")
    name = F.concat_ws("#", "path", "node_id").alias("document")
    fields = corpus.instance_fields(nodes).join(own, ["path", "node_id"], "left_semi")
    filled = F.col("field").isin(*content) & F.col("text").rlike(r"\S")
    return own.select(name, F.lit(False).alias("has")).unionByName(fields.select(name, F.coalesce(filled, F.lit(False)).alias("has")))
