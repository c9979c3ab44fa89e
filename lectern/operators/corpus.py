"""A corpus of documents as tables: scripts, types and their fields, instances and theirs, hosts, audits, verdicts.

Everything derives from files(path, content) through one nodes table, which callers keep if they use it several times.
Paths are relative to the corpus root. What belongs to one document meets in one task; nothing else does.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import selectors as sel
from lectern.operators import validate
from lectern.sources import html

#: Attributes of a template's field that restrict it; any other is a regular expression for the instance's attribute.
CONTROL = ("required", "pattern", "enum", "repeatable", "markup")

Check = Callable[[dict], object]


def nodes(files: DataFrame, **wanted) -> DataFrame:
    """Nodes of the corpus' HTML documents, each read as a whole one."""
    return html.nodes(files.where(sel.is_html_path("path")), "path", "content", whole=True, **wanted)


def scripts(nodes: DataFrame) -> DataFrame:
    """path, idx, id, type, locator, ext, source, node_id, start of every script outside templates; idx counts from 0."""
    rows = nodes.where(sel.visible("script"))
    idx = (F.row_number().over(Window.partitionBy("path").orderBy("node_id")) - 1).alias("idx")
    rows = rows.select("path", idx, F.coalesce(sel.attr("id"), F.lit("")).alias("id"), F.coalesce(sel.attr("type"), F.lit("")).alias("type"), F.col("content").alias("source"), "node_id", "start", "attrs")
    return rows.select("path", "idx", "id", "type", t.locator("id", "idx").alias("locator"), t.script_lang("type").alias("ext"), "source", "node_id", "start", "attrs")


def types(nodes: DataFrame) -> DataFrame:
    """template_path, type_id, node_id: templates with an id; the first of an id counts."""
    rows = nodes.where(sel.template_with_id()).select(F.col("path").alias("template_path"), sel.attr("id").alias("type_id"), "node_id")
    return rows.groupBy("template_path", "type_id").agg(F.min("node_id").alias("node_id"))


def fields(nodes: DataFrame) -> DataFrame:
    """template_path, type_id, ord, field, required, pattern, enum, repeatable, markup, attrs, bad_pattern of all types.

    A pattern that is no regular expression doesn't restrict; it stands in bad_pattern instead.
    """
    own = nodes.where((F.col("kind") == "element") & (F.col("parent_id") == F.col("tpl_root")))
    rows = own.withColumnRenamed("path", "template_path").join(types(nodes).withColumnRenamed("node_id", "tpl_root"), ["template_path", "tpl_root"])
    fine = sel.valid_pattern(sel.attr("pattern"))
    return rows.select(
        "template_path", "type_id", "ord", F.col("tag").alias("field"), sel.has("required").alias("required"), F.when(fine, sel.attr("pattern")).alias("pattern"), sel.attr("enum").alias("enum"),
        sel.has("repeatable").alias("repeatable"), sel.has("markup").alias("markup"), F.map_filter("attrs", lambda k, _: ~k.isin(*CONTROL)).alias("attrs"), F.when(~fine, sel.attr("pattern")).alias("bad_pattern"),
    )


def template_ref(path: Column | str, ref: Column | str) -> tuple[Column, Column]:
    """Template file and type that a reference names: the parts around its first #, seen from the document.

    Without a # the type is 'undefined'; what follows a second # doesn't count.
    """
    ref = F.col(ref) if isinstance(ref, str) else ref
    parts = F.split(ref, "#")
    here = F.when(parts[0] == "", F.coalesce(F.nullif(t.dirname(path), F.lit("")), F.lit("."))).otherwise(t.resolve(path, parts[0]))
    return here, F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("undefined"))


def depths(spans: DataFrame) -> DataFrame:
    """spans(path, node_id, last_id), all columns, with depth: how many of the others enclose each.

    A running sum over where spans begin and end, so no pair of spans is formed.
    """
    begins = spans.select("path", F.col("node_id").alias("at"), F.lit(1).alias("step"))
    ends = spans.select("path", (F.col("last_id") + 1).alias("at"), F.lit(-1).alias("step"))
    steps = begins.unionByName(ends).groupBy("path", "at").agg(F.sum("step").alias("step"), F.count_if(F.col("step") == 1).alias("some"))
    open_ = F.sum("step").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    depth = steps.withColumn("depth", (open_ - 1).cast("int")).where("some > 0").select("path", F.col("at").alias("node_id"), "depth")
    return spans.join(depth, ["path", "node_id"])


def instances(nodes: DataFrame) -> DataFrame:
    """path, node_id, last_id, tag, conforms_to, template_path, type_id, parent_instance, depth of every conforming element."""
    rows = nodes.where(sel.conforming()).select("path", "node_id", "last_id", "tag", sel.attr("data-conforms-to").alias("conforms_to"), F.col("owner").alias("parent_instance"))
    template, kind = template_ref("path", "conforms_to")
    return depths(rows).withColumns({"template_path": template, "type_id": kind})


def instance_fields(nodes: DataFrame) -> DataFrame:
    """path, node_id (of the instance), ord, field, text, attrs: its child elements but those of a type of their own."""
    rows = nodes.where(sel.visible() & (F.col("parent_id") == F.col("owner")) & ~sel.has("data-conforms-to"))
    return rows.select("path", F.col("owner").alias("node_id"), "ord", F.col("tag").alias("field"), F.col("content").alias("text"), "attrs")


def validators(nodes: DataFrame) -> DataFrame:
    """template_path, type_id, locator of the first script that validates a type."""
    own = scripts(nodes).where(sel.has("data-validates"))
    goal = F.col("attrs")["data-validates"]
    rows = own.where(goal.startswith("#")).select(F.col("path").alias("template_path"), F.substring(goal, 2, 1 << 20).alias("type_id"), "locator", "node_id")
    return sel.first(rows, "template_path", "type_id").drop("node_id")


SETUP = "validation setup failed: "


def verdicts(files: DataFrame, nodes: DataFrame, checks: dict[tuple[str, str], Check] | None = None, generic: bool = True) -> DataFrame:
    """path, node_id, template_path, type_id, ok, errors of every instance; nothing raises.

    In this order: no reference; a template file that isn't there; a type that isn't in it; the generic rules' messages,
    sorted, and then those of the type's own check, where a script validates it. checks holds the functions of such
    scripts by (template path, type): each gets {path, node_id, tag, type, fields: [{field, text, attrs}]} and returns a list of
    messages, or a dict with ok and errors or violations. A script without a function, or one that raises, is a
    failure of its own. Without generic rules a type needs a script.
    """
    there = files.select(F.col("path").alias("template_path"), F.lit(True).alias("file")).distinct()
    known = types(nodes).select("template_path", "type_id", F.lit(True).alias("type"))
    own = validators(nodes).withColumnRenamed("locator", "script")
    rows = instances(nodes).join(there, "template_path", "left").join(known, ["template_path", "type_id"], "left").join(own, ["template_path", "type_id"], "left")
    rows = rows.withColumn("instance", F.struct("path", "node_id"))
    type_key = F.struct("template_path", "type_id").alias("type")
    found = instance_fields(nodes).select(F.struct("path", "node_id").alias("instance"), "ord", "field", "text", "attrs")
    judged = validate.checked(rows.select("instance", type_key), found, fields(nodes).select(type_key, "field", "required", "pattern", "enum", "repeatable", "attrs"))
    rows = rows.join(judged.select("instance", F.array_sort(F.col("violations")["message"]).alias("generic")), "instance")
    asked = rows.where("type and script is not null").select("instance", "tag", "template_path", "type_id")
    rows = rows.join(_custom(asked, found, checks or {}), "instance", "left")
    key = F.concat_ws("#", "template_path", "type_id")
    none = F.array().cast("array<string>")
    one = lambda message: F.array(message)
    errors = (
        F.when(F.coalesce("conforms_to", F.lit("")) == "", one(F.lit("missing data-conforms-to attribute")))
        .when(F.col("file").isNull(), one(F.concat(F.lit(SETUP + "no such file "), "template_path")))
        .when(F.col("type").isNull(), one(F.concat(F.lit("no template found at "), key)))
        .when(F.col("setup").isNotNull(), one(F.concat(F.lit(SETUP), "setup")))
        .when(F.lit(not generic) & F.col("script").isNull(), one(F.concat(F.lit("no generic validator available and no data-validates script for "), key)))
        .otherwise(F.concat(F.col("generic") if generic else none, F.coalesce("custom", none)))
    )
    ok = (F.size("errors") == 0) & F.coalesce("custom_ok", F.lit(True))
    return rows.withColumn("errors", errors).select("path", "node_id", "template_path", "type_id", ok.alias("ok"), "errors")


def _custom(asked: DataFrame, found: DataFrame, checks: dict[tuple[str, str], Check]) -> DataFrame:
    """instance, custom_ok, custom (messages), setup (why there are none) of types' own checks."""
    some = found.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("ord", "field", "text", F.to_json("attrs").alias("attrs")))).alias("found"))
    rows = asked.join(some, "instance", "left").select("instance.path", "instance.node_id", "tag", "template_path", "type_id", F.to_json("found").alias("found"))

    def run(batches):
        import json

        for pdf in batches:
            out = []
            for path, node, tag, template, kind, fields in pdf.itertuples(index=False):
                ok, messages, setup = True, [], None
                try:
                    listed = [{"field": f["field"], "text": f.get("text", ""), "attrs": json.loads(f.get("attrs") or "{}")} for f in json.loads(fields or "[]")]
                    got = checks[template, kind]({"path": path, "node_id": int(node), "tag": tag, "type": kind, "fields": listed})
                    if isinstance(got, dict):
                        messages = [str(x) for x in got.get("errors") or got.get("violations") or []]
                        ok = bool(got.get("ok", not messages))
                    else:
                        messages = [str(x) for x in got or []]
                except KeyError as e:
                    setup = f"no check for {template}#{kind}" if e.args == ((template, kind),) else repr(e)
                except Exception as e:  # noqa: BLE001  what a check raises is its verdict
                    setup = str(e)
                out.append((path, node, ok, messages, setup))
            yield pd.DataFrame(out, columns=["path", "node_id", "custom_ok", "custom", "setup"])

    done = rows.mapInPandas(run, "path string, node_id int, custom_ok boolean, custom array<string>, setup string")
    return done.select(F.struct("path", "node_id").alias("instance"), "custom_ok", "custom", "setup")


def outside_the_type(nodes: DataFrame) -> DataFrame:
    """path, node_id, text: text of a document with an instance that stands in no conforming element.

    Scripts, styles, titles and templates are no content, and a document that declares a type isn't an instance.
    """
    declares = nodes.where(sel.template_with_id()).select("path").distinct()
    some = nodes.where(sel.conforming()).select("path").distinct().join(declares, "path", "left_anti")
    raw = nodes.where((F.col("kind") == "element") & F.col("tag").isin("script", "style", "title")).select("path", F.col("node_id").alias("parent_id"))
    texts = nodes.where((F.col("kind") == "text") & F.col("tpl_root").isNull() & F.col("owner").isNull() & F.col("text").rlike(r"\S"))
    return texts.join(raw, ["path", "parent_id"], "left_anti").join(some, "path", "left_semi").select("path", "node_id", "text")


def hosts(files: DataFrame) -> DataFrame:
    """id, kind, path of every command host; several of one id are all listed."""
    rows = files.where(sel.is_host_path("path")).select(t.host_id("path").alias("id"), F.when(F.col("path").endswith(".template.html"), "template").otherwise("command").alias("kind"), "path")
    return rows.where("id is not null")


def host_of(hosts: DataFrame) -> DataFrame:
    """id, path: the file that an id names, templates before commands, then by path."""
    return hosts.groupBy("id").agg(F.min_by("path", F.struct(F.col("kind") == "command", "path")).alias("path"))


def instances_per_host(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """id, n: documents that conform to each host, each counted once, 0 for hosts without any.

    A document that declares a type of its own counts nowhere; ids of no host are dropped.
    """
    declares = nodes.where(sel.template_with_id()).select("path").distinct()
    named = F.regexp_replace(t.basename(sel.attr("data-conforms-to")), r"\.(template|command)\.html.*$", "")
    rows = nodes.where(sel.conforming()).select("path", named.alias("id")).join(declares, "path", "left_anti")
    counts = rows.distinct().groupBy("id").agg(F.count("*").alias("n"))
    return hosts.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def audits(nodes: DataFrame) -> DataFrame:
    """name, path, touches, expects, source of every audit."""
    rows = scripts(nodes).where(sel.has("data-audits"))
    words = lambda name: F.filter(F.split(F.coalesce(F.col("attrs")[name], F.lit("")), r"\s+"), lambda x: x != "")
    return rows.select(F.col("attrs")["data-audits"].alias("name"), "path", F.coalesce(F.col("attrs")["data-touches"], F.lit("")).alias("touches"), words("data-expects").alias("expects"), "source", "locator")


def touched(audits: DataFrame, types: DataFrame) -> DataFrame:
    """name, template_path, type_id of the types that an audit concerns; prefix-* names all of a prefix, nothing else is a wildcard."""
    each = audits.select("name", F.explode(F.filter(F.split("touches", r"\s+"), lambda x: x != "")).alias("touch"))
    kinds = types.select("template_path", "type_id").distinct()
    starts = F.transform(F.sequence(F.lit(0), F.length("type_id")), lambda n: F.concat(F.substring("type_id", F.lit(1), n), F.lit("*")))
    named = kinds.select("template_path", "type_id", F.explode(F.concat(F.array("type_id"), starts)).alias("touch"))
    return each.join(named, "touch").select("name", "template_path", "type_id").distinct()


def importmaps(nodes: DataFrame) -> DataFrame:
    """path, idx, pos, name, version of every import map's entries; maps that aren't JSON have none."""
    maps = scripts(nodes).where(sel.is_opaque("type"))
    entries = F.from_json("source", "imports map<string,string>")["imports"]
    return maps.select("path", "idx", F.posexplode(F.map_entries(entries)).alias("pos", "e")).select("path", "idx", "pos", "e.key", "e.value").toDF("path", "idx", "pos", "name", "version")


def install_plan(entries: DataFrame) -> DataFrame:
    """name, version, spec of what the import maps need: the last one of a name wins, in the order of paths and scripts."""
    last = entries.groupBy("name").agg(F.max_by("version", F.struct("path", "idx", "pos")).alias("version"))
    return last.select("name", "version", F.concat_ws("@", "name", "version").alias("spec"))
