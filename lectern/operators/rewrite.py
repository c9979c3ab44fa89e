"""Rewrites that keep every other character: edits found by a scan, decided by joins, spliced back by one fold.

An edit is struct<start, end, text> in code points, ends exclusive. The edits of one file meet in one row beside
its content, so they are bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import markup, script
from lectern.functions import text as t
from lectern.operators import selectors as sel


def spliced(content: Column, edits: Column) -> Column:
    """content with non-overlapping edits applied; null edits leave it as it is."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, e: F.struct(F.concat(acc["out"], F.substring(content, acc["at"] + 1, e["start"] - acc["at"]), e["text"]).alias("out"), e["end"].alias("at"))
    rest = lambda acc: F.concat(acc["out"], F.substring(content, acc["at"] + 1, F.length(content)))
    return F.when(edits.isNull(), content).otherwise(F.aggregate(F.array_sort(edits), zero, step, rest))


def apply_edits(files: DataFrame, edits: DataFrame, keys: list[str], content: str) -> DataFrame:
    """files, all columns, with edits(keys, start, end, text) spliced into content."""
    each = edits.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "text")).alias("_edits"))
    return files.join(each, keys, "left").withColumn(content, spliced(F.col(content), F.col("_edits"))).select(*files.columns)


def repoint(files: DataFrame, carried: DataFrame, site: str) -> DataFrame:
    """files(path, content) whose href and src to paths outside carried(path) lead to the site instead.

    Only the places of links are shuffled for the anti-join. Values are quoted and not escaped again;
    fragments stay; links in templates are patterns and stay too.
    """
    found = files.select("path", F.explode(markup.attributes_of("content")).alias("a")).where("a.name in ('href', 'src')")
    links = found.where(t.link_class(F.col("a")["value"]) == "path").select("path", "a.*")
    links = links.withColumn("goal", t.resolve("path", t.link_target("value")))
    out = links.join(carried.select(F.col("path").alias("goal")), "goal", "left_anti")
    text = F.concat(F.col("name"), F.lit(f'="{site}'), F.col("goal"), t.link_fragment("value"), F.lit('"'))
    return apply_edits(files, out.select("path", "start", "end", text.alias("text")), ["path"], "content")


def rewrite_imports(scripts: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """scripts(keys, source) whose relative import specifiers change as table(spec, new) says; others stay."""
    found = scripts.select(*keys, F.explode(script.imports_of("source")).alias("i")).select(*keys, "i.*").where(F.col("spec").startswith("."))
    return apply_edits(scripts, found.join(table, "spec").select(*keys, "start", "end", F.col("new").alias("text")), keys, "source")


def virtual_files(blocks: DataFrame, key: str, base: str) -> DataFrame:
    """key, idx, name, text of the file that stands for each script block: its code with '#locator' imports leading to its
    siblings' files. Data that isn't code keeps its slot, with nothing in it."""
    edits = sibling_edits(blocks, key, base).where("text is not null")
    code = apply_edits(blocks, edits, [key, "idx"], "source")
    name = F.concat(F.col(base), F.lit("."), F.col("idx").cast("string"), t.script_lang("type"))
    return code.select(key, "idx", name.alias("name"), F.when(sel.is_opaque("type"), F.lit("")).otherwise(F.col("source")).alias("text"))


def sibling_edits(blocks: DataFrame, key: str, base: str) -> DataFrame:
    """key, idx, start, end, text of '#locator' imports; text is null where no sibling has the locator.

    blocks(key, idx, type, id, source); base is the column with the document's file name. The first script of an id counts.
    """
    found = blocks.select(key, "idx", base, F.explode(script.hash_imports_of("source")).alias("h")).select(key, "idx", base, "h.start", "h.end", "h.quote", F.expr("try_url_decode(replace(h.locator, '+', '%2B'))").alias("locator"))
    at = blocks.select(key, F.col("idx").alias("n"), t.script_lang("type").alias("ext"), F.explode(F.array(F.col("id"), F.concat(F.lit("@"), F.col("idx").cast("string")))).alias("locator"))
    goal = at.where("locator <> ''").groupBy(key, "locator").agg(F.min(F.struct("n", "ext")).alias("to"))
    text = F.concat(F.col("quote"), F.lit("./"), F.col(base), F.lit("."), F.col("to.n").cast("string"), F.col("to.ext"), F.col("quote"))
    return found.join(goal, [key, "locator"], "left").select(key, "idx", "start", "end", text.alias("text"))


def block_mapping(blocks: DataFrame, key: str, base: str) -> DataFrame:
    """key, idx, seg, source_offset, generated_offset, length, generated_length: each block's virtual file, piece by piece."""
    edits = sibling_edits(blocks, key, base).groupBy(key, "idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce(F.length("text"), F.col("end") - F.col("start")).alias("new")))).alias("e"))
    b = blocks.select(key, "idx", F.col("start").alias("first"), F.length("source").alias("size")).join(edits, [key, "idx"], "left")
    none = F.array().cast("array<struct<start: int, end: int, new: int>>")
    b = b.withColumn("e", F.concat(F.coalesce("e", none), F.array(F.struct(F.col("size").alias("start"), F.col("size").alias("end"), F.lit(0).alias("new")))))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("e"), F.greatest(i, F.lit(1)))["end"])
    piece = lambda a, n, m: F.struct(a.alias("at"), n.alias("length"), m.alias("generated"))
    pairs = F.flatten(F.transform("e", lambda e, i: F.array(piece(before(i), e["start"] - before(i), e["start"] - before(i)), piece(e["start"], e["end"] - e["start"], e["new"]))))
    s = b.select(key, "idx", "first", F.posexplode(F.filter(pairs, lambda p: p["length"] > 0)).alias("seg", "p"))
    upto = F.sum("p.generated").over(Window.partitionBy(key, "idx").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    return s.select(key, "idx", "seg", (F.col("first") + F.col("p.at")).alias("source_offset"), F.coalesce(upto, F.lit(0)).cast("int").alias("generated_offset"), F.col("p.length").alias("length"), F.col("p.generated").alias("generated_length"))
