"""Selectors as predicates over the nodes table; document-level ones never look into templates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Script types of this prefix run outside the browser.
PREFIX = "node/"


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def has(name: str) -> Column:
    return F.col("attrs").isNotNull() & F.map_contains_key("attrs", F.lit(name))


def visible(tag: str | None = None) -> Column:
    """Elements (of the tag) outside templates."""
    here = (F.col("kind") == "element") & F.col("tpl_root").isNull()
    return here if tag is None else here & (F.col("tag") == tag)


def stylesheet() -> Column:
    """link[rel="stylesheet"][href]"""
    return visible("link") & (attr("rel") == "stylesheet") & has("href")


def conforming() -> Column:
    """[data-conforms-to]"""
    return visible() & has("data-conforms-to")


def script_with_src() -> Column:
    """script[src]"""
    return visible("script") & has("src")


def inline_script() -> Column:
    """script without src"""
    return visible("script") & ~has("src")


def command_script(prefix: str = PREFIX) -> Column:
    return visible("script") & (attr("type") == prefix + "command")


def importmap_script(prefix: str = PREFIX) -> Column:
    return visible("script") & (attr("type") == prefix + "importmap")


def audit_script() -> Column:
    """script[data-audits]"""
    return visible("script") & has("data-audits")


def validator_script(type_id: Column | str | None = None) -> Column:
    """script[data-validates] (="#T")"""
    any_ = visible("script") & has("data-validates")
    if type_id is None:
        return any_
    return any_ & (attr("data-validates") == F.concat(F.lit("#"), F.col(type_id) if isinstance(type_id, str) else type_id))


def template_with_id() -> Column:
    """template[id]; an empty id is none."""
    return visible("template") & (F.coalesce(attr("id"), F.lit("")) != "")


def raw_text() -> Column:
    """script, style"""
    return (F.col("kind") == "element") & F.col("tag").isin("script", "style")


def children(nodes: DataFrame, parent: str, child: str) -> DataFrame:
    """parent > child: the child rows, outside templates."""
    above = nodes.where(visible(parent)).select("path", F.col("node_id").alias("parent_id"))
    return nodes.where(visible(child)).join(above, ["path", "parent_id"], "left_semi").select(*nodes.columns)


def first(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key in document order (of each path by default)."""
    keys = keys or ("path",)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "node_id").alias("x")).select(*keys, "x.*")


def first_descendant(nodes: DataFrame, of: DataFrame, tag: str) -> DataFrame:
    """of(path, node_id, last_id), all columns, with ``found``, the first element of the tag strictly inside, or null; any letter case.

    One sweep over each document from its end: the element of the tag that was met last is the first one after a place,
    and lies inside if it is no later than the place's last node. No pair of nodes is formed.
    """
    inner = nodes.where((F.col("kind") == "element") & (F.lower("tag") == tag.lower())).select("path", F.col("node_id").alias("at"), F.col("node_id").alias("n"), F.lit(1).alias("role"))
    asked = of.select("path", F.col("node_id").alias("at"), F.lit(None).cast("int").alias("n"), F.lit(0).alias("role"), F.struct(*of.columns).alias("own"))
    before = Window.partitionBy("path").orderBy(F.desc("at"), "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionByName(inner, allowMissingColumns=True).withColumn("next", F.last("n", ignorenulls=True).over(before)).where("role = 0")
    return swept.select("own.*", F.when(F.col("next") <= F.col("own.last_id"), F.col("next")).alias("found"))


def by_id(nodes: DataFrame) -> DataFrame:
    """path, id, node_id, tag, content of the element that each id of a document names: the first of any tag, outside templates."""
    rows = nodes.where(visible() & (attr("id") != "")).select("path", attr("id").alias("id"), "node_id", "tag", "content")
    return first(rows, "path", "id")


def is_html_path(path: Column | str) -> Column:
    """.html or .htm at the end."""
    return (F.col(path) if isinstance(path, str) else path).rlike(r"(?i)\.html?$")


def is_node_only(kind: Column | str, prefix: str = PREFIX) -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).startswith(prefix)


def is_opaque(kind: Column | str, prefix: str = PREFIX) -> Column:
    """Script types whose text is data, not code."""
    return (F.col(kind) if isinstance(kind, str) else kind) == prefix + "importmap"


def is_host_path(path: Column | str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(r"[^/]\.(template|command)\.html$")


def label(path: Column | str) -> Column:
    """A command's words as one text."""
    return F.array_join(path, " ")


def script_format(kind: Column | str, prefix: str = PREFIX) -> Column:
    """What a module loader takes a script for."""
    return F.when(is_node_only(F.coalesce(F.col(kind) if isinstance(kind, str) else kind, F.lit("")), prefix), "module-typescript").otherwise("module")


@F.pandas_udf(T.BooleanType())
def valid_pattern(s: pd.Series) -> pd.Series:
    """Whether a regular expression compiles; null counts as valid."""

    def ok(x) -> bool:
        try:
            re.compile(x or "")
        except re.error:
            return False
        return True

    return s.map(ok)
