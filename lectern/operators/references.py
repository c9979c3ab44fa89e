"""What a document needs beside itself: its references, their resolution to files, and the closure that seeds a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import script
from lectern.functions import text as t
from lectern.operators import graph, rewrite
from lectern.operators import selectors as sel
from lectern.sources import html
from lectern.sources.store import session_store
from lectern.storage import stored

#: A literal that holds markup of its own, and one that names a file beside the document.
MARKUP, FILE = r"<(?:script|link)[\s>]", r"^[\w.-]+\.(?:css|js|html)$"
#: Markup in literals in markup in literals: nothing written by hand goes deeper.
NESTED = 8


def named(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, ref of everything that nodes name: stylesheets, types that elements conform to, script files, and of inline
    scripts the modules they import and literals that name a file; and path, literal of literals that hold scripts or
    links of their own. Links of anchors are none, and templates aren't looked into."""
    code = nodes.where(sel.inline_script()).select("path", F.coalesce("content", F.lit("")).alias("code"))
    literals = code.select("path", F.explode(script.literals_of("code")).alias("literal"))
    refs = [
        nodes.where(sel.stylesheet()).select("path", sel.attr("href").alias("ref")), nodes.where(sel.conforming()).select("path", sel.attr("data-conforms-to").alias("ref")),
        nodes.where(sel.script_with_src()).select("path", sel.attr("src").alias("ref")), code.select("path", F.explode(script.imports_of("code")["spec"]).alias("ref")),
        literals.where(F.col("literal").rlike(FILE)).select("path", F.col("literal").alias("ref")),
    ]
    return reduce(DataFrame.unionByName, refs), literals.where(F.col("literal").rlike(MARKUP)).distinct()


def references(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """path, ref of all references of documents, those of markup in their literals included, each once.

    The nodes are read once for all kinds; literals with markup are parsed to nodes, which are asked the same, round by
    round until no literal holds any, NESTED deep at most.
    """
    refs, literals = named(nodes)
    for _ in range(NESTED):
        literals = stored(spark, literals, "literals")
        if not literals.limit(1).count():
            break
        more, deeper = named(html.nodes(literals, "path", "literal", whole=True))
        refs, literals = refs.unionByName(more), deeper
    return refs.distinct()


def local_references(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """src, dst: the files that each HTML document needs; nodes of files, if they are at hand.

    A reference loses what follows its first #; what is left is looked for beside the document, then at the root by its
    name alone; what is no file in either place is dropped.
    """
    spark = files.sparkSession
    nodes = session_store(spark).nodes(files) if nodes is None else nodes
    raw = references(spark, nodes.where(F.col("path").endswith(".html")))
    target = F.substring_index("ref", "#", 1)
    asked = raw.select("path", target.alias("target")).where("target <> ''").distinct()
    asked = asked.select("path", t.resolve("path", "target").alias("beside"), t.basename(F.regexp_replace("target", "/+$", "")).alias("at_root"), F.col("target").startswith("/").alias("rooted"))
    there = files.select("path").distinct()
    first = asked.join(there.select(F.col("path").alias("beside"), F.lit(True).alias("is")), "beside", "left")
    first = first.withColumn("is", F.col("is") & ~F.col("rooted"))
    second = first.join(there.select(F.col("path").alias("at_root"), F.lit(True).alias("is_root")), "at_root", "left")
    dst = F.when(F.col("is"), F.col("beside")).when(F.col("is_root"), F.col("at_root"))
    return second.select(F.col("path").alias("src"), dst.alias("dst")).where("dst is not null").distinct()


def seed_roots(files: DataFrame, families: list[str], folders: tuple[str, ...] = ("language", "commands"), always: tuple[str, ...] = ("theme.css",)) -> DataFrame:
    """node: files that a fresh corpus gets whatever refers to them: the named ones, families' templates, documents of folders."""
    named = F.col("path").isin(*always, *(f"templates/{f}.template.html" for f in families))
    below = F.lit(False)
    for f in folders:
        below = below | F.col("path").startswith(f + "/")
    return files.where(named | below & F.col("path").endswith(".html")).select(F.col("path").alias("node"))


def seed_paths(spark: SparkSession, files: DataFrame, families: list[str], **settings) -> DataFrame:
    """path of everything that a fresh corpus gets: the roots, and what is reached from them over references; in order of path."""
    return graph.closure(spark, seed_roots(files, families, **settings), local_references(files)).withColumnRenamed("node", "path").orderBy("path")


def seeded(files: DataFrame, paths: DataFrame, site: str) -> DataFrame:
    """path, content of the files of a fresh corpus: links of documents to what isn't carried lead to the site, the rest is copied."""
    taken = files.join(paths.select("path"), "path", "left_semi")
    pages = rewrite.repoint(taken.where(F.col("path").endswith(".html")), paths, site)
    return pages.unionByName(taken.where(~F.col("path").endswith(".html")))


def import_targets(scripts: DataFrame) -> DataFrame:
    """path, idx, spec, goal, locator, outcome of every import of scripts(path, idx, id, type, locator, source).

    A bare '#x' names a script of the importing document, 'file#x' one of another HTML document beside it; locators
    are percent-decoded, and found by id or, as '@n', by place. outcome: found, missing (the file or the script isn't
    there), or other, which an ordinary module loader resolves.
    """
    each = scripts.select("path", "idx", F.explode(script.imports_of("source")).alias("i")).select("path", "idx", "i.spec")
    file, mark = t.link_target("spec"), F.substring(t.link_fragment("spec"), 2, 1 << 20)
    ours = (mark != "") & ((file == "") | (sel.is_html_path(file) & ~file.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & file.rlike(r"^\.{0,2}/")))
    goal = F.when(ours, F.when(file == "", F.col("path")).otherwise(t.resolve("path", file)))
    asked = each.select("path", "idx", "spec", goal.alias("goal"), F.when(ours, F.expr("try_url_decode(replace(substr(spec, instr(spec, '#') + 1), '+', '%2B'))")).alias("locator"))
    return asked.join(located(scripts).select(F.col("path").alias("goal"), "locator", F.lit(True).alias("is")), ["goal", "locator"], "left").select(
        "path", "idx", "spec", "goal", "locator", F.when(F.col("goal").isNull(), "other").when(F.col("is"), "found").otherwise("missing").alias("outcome")
    )


def located(scripts: DataFrame) -> DataFrame:
    """path, locator, idx, type, source: scripts under every name they can be loaded by; the first of an id counts."""
    both = scripts.select("path", F.explode(F.array(F.col("id"), F.concat(F.lit("@"), F.col("idx").cast("string")))).alias("locator"), "idx", "type", "source")
    return both.where("locator <> ''").groupBy("path", "locator").agg(F.min_by(F.struct("idx", "type", "source"), "idx").alias("x")).select("path", "locator", "x.*")


def loaded(addresses: DataFrame, scripts: DataFrame) -> DataFrame:
    """url, path, locator, format, source, error of synthetic addresses(url): what a loader gets for each.

    An address of another form is left to others (all null); one whose script isn't there has an error.
    """
    rows = addresses.select("url", t.real_path("url").alias("path"), t.real_locator("url").alias("locator"))
    joined = rows.join(located(scripts), ["path", "locator"], "left")
    error = F.when(F.col("path").isNotNull() & F.col("source").isNull(), F.concat(F.lit("no script "), "locator", F.lit(" in "), "path"))
    return joined.select("url", "path", "locator", F.when(F.col("source").isNotNull(), sel.script_format("type")).alias("format"), "source", error.alias("error"))
