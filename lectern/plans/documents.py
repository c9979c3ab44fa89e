"""Queries over the made corpus: from files to nodes, tables, verdicts and lines, with SQL over the tables it is made from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern import registry, session, tables
from lectern.functions import markup, script
from lectern.functions import text as t
from lectern.operators import commands, corpus, overlay, prose, references, rewrite, roster, validate
from lectern.operators import selectors as sel
from lectern.plans import made
from lectern.plans.catalog import _query, _read
from lectern.sources import files
from lectern.sources.store import session_store
from lectern.storage import shared_dir
from lectern.streaming.incremental import LiveVerdicts

KNOWN = registry.Registry()


@KNOWN.check("templates/account.template.html", "account-doc")
def overdrawn(instance: dict) -> dict:
    low = [f["text"] for f in instance["fields"] if f["field"] == "account-balance" and f["text"].startswith("-")]
    return {"ok": not low, "violations": ["overdrawn"] * len(low)}


@KNOWN.audit("every-link-resolves")
def every_link_resolves(tables):
    """path of each document with an anchor whose target is no file."""
    links = tables["nodes"].where(sel.visible("a") & (t.link_class(sel.attr("href")) == "path"))
    goals = links.select("path", t.resolve("path", t.link_target(sel.attr("href"))).alias("goal"))
    return goals.join(tables["files"].select(F.col("path").alias("goal")), "goal", "left_anti").select("path").distinct()


K = "c_custkey"
PATH = made.CUSTOMER_PATH
TEMPLATE = "CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'templates/customer.template.html' WHEN c_custkey % 29 = 0 THEN 'templates/missing.template.html' WHEN c_custkey % 31 = 0 THEN 'customers' ELSE 'templates/customer.template.html' END"
TYPE = "CASE WHEN c_custkey % 17 = 0 THEN 'gone' WHEN c_custkey % 19 = 0 THEN 'undefined' ELSE 'customer-doc' END"
ACCOUNT = "'templates/account.template.html'"
HOSTS = [f"templates/{x}.template.html" for x in ("customer", "template")]
INSTANCES = (
    f"(SELECT {PATH} AS path, 'customer-doc' AS tag, {TEMPLATE} AS template_path, {TYPE} AS type_id, 0 AS depth FROM customer UNION ALL SELECT {PATH}, 'account-doc', {ACCOUNT}, 'account-doc', 1 FROM customer "
    f"UNION ALL SELECT {made.NATION_PATH}, 'nation-doc', 'templates/nation.template.html', 'nation-doc', 0 FROM nation UNION ALL SELECT path, 'template-host', 'templates/template.template.html', 'template-host', 0 FROM {made.values([(h,) for h in HOSTS], 'path')})"
)


def _nodes(spark, d, tags=None):
    """The corpus' nodes from the session's store, which parses each text once for all queries."""
    nodes = session_store(spark).nodes(made.files(spark, d))
    return nodes.where((F.col("kind") == "element") & F.col("tag").isin(*tags)) if tags else nodes


def _customers(spark, d, **shape):
    return _read(spark, d, "customer").select(F.expr(PATH).alias("path"), F.expr(made.joined(made.DOCTYPE, made.customer(**shape))).alias("content"))


def _scripts(spark, d):
    """The suppliers' scripts."""
    rows = _read(spark, d, "supplier").select(F.expr(made.SUPPLIER_PATH).alias("path"), F.expr(made.joined(made.DOCTYPE, made.SUPPLIER)).alias("content"))
    return corpus.scripts(session_store(spark).nodes(rows))


# ---- scans ----


@_query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def nodes_scan(spark, d):
    from lectern.sources import html

    rows = html.nodes(_read(spark, d, "pages"), "page_id", "html", whole=True, columns=["kind", "tag"])
    return rows.where("kind = 'element'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@_query(f"""SELECT path, name, value, strpos(content, name || '="' || value || '"') - 1 AS start, strpos(content, name || '="' || value || '"') - 1 + length(name) + length(value) + 3 AS "end"
  FROM (SELECT {PATH} AS path, {made.joined(made.DOCTYPE, made.customer())} AS content, 'data-conforms-to' AS name, {made.REF} AS value FROM customer UNION ALL SELECT {PATH}, {made.joined(made.DOCTYPE, made.customer())}, 'rel', 'stylesheet' FROM customer)""")
def attr_spans(spark, d):
    found = _customers(spark, d).select("path", F.explode(markup.attributes_of("content")).alias("a")).select("path", "a.*")
    return found.where("tag = 'customer-doc' and name = 'data-conforms-to' or name = 'rel'").select("path", "name", "value", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"SELECT path FROM {made.FILES_SQL} WHERE path LIKE 'suppliers/%' AND path LIKE '%.html'")
def corpus_list(spark, d):
    return overlay.listed(made.files(spark, d), "suppliers", ".html")


@_query(f"SELECT path, content FROM {made.FILES_SQL} WHERE path = 'customers/5.html'")
def corpus_read(spark, d):
    return made.files(spark, d).where("path = 'customers/5.html'")


@_query("SELECT asked.path, asked.path LIKE 'nations/%' AS present FROM (SELECT concat('nations/', n_nationkey, '.html') AS path FROM nation UNION ALL SELECT concat('nation/', n_nationkey, '.html') FROM nation) asked")
def corpus_exists(spark, d):
    n = _read(spark, d, "nation")
    asked = n.select(F.expr(made.NATION_PATH).alias("path")).union(n.select(F.expr("concat('nation/', n_nationkey, '.html')")))
    none = spark.createDataFrame([], "path string, op string, content string, original string")
    return overlay.exists(asked, made.files(spark, d), none)


# ---- types, instances, verdicts ----


@_query(f"SELECT path, tag, template_path, type_id, depth FROM {INSTANCES}")
def explore_list(spark, d):
    return corpus.instances(_nodes(spark, d)).select("path", "tag", "template_path", "type_id", "depth")


@_query(f"SELECT path, tag, CASE WHEN tag = 'account-doc' THEN 1 ELSE 0 END AS depth, CASE WHEN tag = 'account-doc' THEN 'customer-doc' END AS inside FROM {INSTANCES}")
def instance_depth(spark, d):
    rows = corpus.instances(_nodes(spark, d))
    above = rows.select("path", F.col("node_id").alias("parent_instance"), F.col("tag").alias("inside"))
    return rows.join(above, ["path", "parent_instance"], "left").select("path", "tag", "depth", "inside")


@_query(f"SELECT i.path, i.template_path, i.type_id, i.template_path = 'templates/missing.template.html' OR i.template_path = 'customers' AS no_file, i.type_id NOT IN ('gone', 'undefined') AND i.template_path LIKE 'templates/%' AND i.template_path NOT LIKE '%missing%' AS resolved FROM {INSTANCES} i")
def resolve_ref(spark, d):
    nodes = _nodes(spark, d)
    known = corpus.types(nodes).select("template_path", "type_id", F.lit(True).alias("is"))
    there = made.files(spark, d).select(F.col("path").alias("template_path"), F.lit(True).alias("file"))
    rows = corpus.instances(nodes).join(known, ["template_path", "type_id"], "left").join(there, "template_path", "left")
    return rows.select("path", "template_path", "type_id", F.col("file").isNull().alias("no_file"), F.coalesce("is", F.lit(False)).alias("resolved"))


@_query(f"SELECT template_path, type_id, field, required, pattern, enum, repeatable, href FROM {made.values([('templates/customer.template.html', 'customer-doc', 'customer-name', True, '^Customer#[0-9]+$', None, False, None), ('templates/customer.template.html', 'customer-doc', 'customer-segment', True, None, 'BUILDING AUTOMOBILE MACHINERY', False, None), ('templates/customer.template.html', 'customer-doc', 'customer-note', False, None, None, False, None), ('templates/customer.template.html', 'customer-doc', 'customer-nation', False, None, None, False, '^[.][.]/nations/[0-9]+[.]html$'), ('templates/customer.template.html', 'customer-doc', 'customer-tag', False, None, None, True, None), ('templates/account.template.html', 'account-doc', 'account-balance', True, '^-?[0-9]+$', None, False, None), ('templates/nation.template.html', 'nation-doc', 'nation-name', True, None, None, False, None), ('templates/template.template.html', 'template-host', 'template-purpose', True, None, None, False, None)], 'template_path, type_id, field, required, pattern, enum, repeatable, href')}")
def type_fields(spark, d):
    return corpus.fields(_nodes(spark, d)).select("template_path", "type_id", "field", "required", "pattern", "enum", "repeatable", F.col("attrs")["href"].alias("href"))


def _message(field: str, rule: str, where: str) -> str:
    return f"SELECT {PATH} AS path, 'customer-doc' AS tag, '{field}: {rule}' AS message, 0 AS k FROM customer WHERE {TEMPLATE} = 'templates/customer.template.html' AND {TYPE} = 'customer-doc' AND {where}"


MESSAGES = "(" + " UNION ALL ".join([
    _message("customer-name", "required", "c_custkey % 23 = 0 AND c_custkey % 13 <> 0"), _message("customer-name", "repeated", "c_custkey % 23 <> 0 AND c_custkey % 13 = 0"),
    _message("customer-segment", "enum", "c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')"), _message("customer-note", "empty", "c_custkey % 5 = 0"),
    _message("customer-extra", "undeclared", "c_custkey % 7 = 0"), _message("customer-nation@href", "attribute", "c_custkey % 11 = 0"),
    f"SELECT {PATH}, 'customer-doc', 'validation setup failed: no such file ' || {TEMPLATE}, 0 FROM customer WHERE {TEMPLATE} <> 'templates/customer.template.html'",
    f"SELECT {PATH}, 'customer-doc', 'no template found at ' || {TEMPLATE} || '#' || {TYPE}, 0 FROM customer WHERE {TYPE} <> 'customer-doc'",
    f"SELECT {PATH}, 'account-doc', 'overdrawn', 1 FROM customer WHERE {made.BALANCE} < 0",
    f"SELECT {made.NATION_PATH}, 'nation-doc', 'validation setup failed: no check for templates/nation.template.html#nation-doc', 0 FROM nation",
]) + ")"
VERDICTS = f"(SELECT i.path, i.type_id, count(m.message) = 0 AS ok, coalesce(string_agg(m.message, '|' ORDER BY m.k, m.message), '') AS errors FROM {INSTANCES} i LEFT JOIN {MESSAGES} m ON m.path = i.path AND m.tag = i.tag GROUP BY i.path, i.tag, i.type_id)"
BROKEN = f"(SELECT {PATH} AS path FROM customer WHERE c_custkey % 41 = 0 UNION ALL SELECT {PATH} FROM customer WHERE c_custkey < 0)"
STATES = f"(SELECT 'every-link-resolves' AS name, path AS violation, CASE WHEN path = 'customers/41.html' THEN 'expected' ELSE 'unexpected' END AS state FROM {BROKEN} UNION ALL SELECT 'every-link-resolves', 'customers/none.html', 'missing' UNION ALL SELECT 'unwritten', NULL, 'unregistered')"


@_query(f"SELECT path, type_id, ok, errors FROM {VERDICTS}")
def corpus_verdicts(spark, d):
    return corpus.verdicts(made.files(spark, d), _nodes(spark, d), KNOWN.checks).select("path", "type_id", "ok", F.array_join("errors", "|").alias("errors"))


@_query(f"SELECT path, type_id, ok, errors FROM {VERDICTS}")
def incremental_verdicts(spark, d):
    """The same verdicts of a corpus that comes as changes: first with another template and other customers, later as it is."""
    at = f"{shared_dir(spark)}/lectern/live-{uuid.uuid4().hex}"
    files = made.files(spark, d).withColumn("seq", F.lit(2).cast("long"))
    late = F.col("path").rlike("^customers/[0-9]*7.html$") | F.col("path").isin("templates/customer.template.html", "templates/account.template.html")
    other = F.when(F.col("path").endswith("customer.template.html"), F.replace("content", F.lit("required"), F.lit("repeatable"))).when(late, F.lit("<p data-conforms-to='gone.html#x'></p>")).otherwise(F.col("content"))
    first = files.where("path <> 'templates/account.template.html'").select("path", other.alias("content"), F.lit(1).cast("long").alias("seq"))
    first = first.unionByName(files.where("path like 'nations/%'").select(F.concat(F.lit("x-"), "path").alias("path"), "content", "seq"))
    then = files.where(late).unionByName(files.where("path like 'nations/%'").select(F.concat(F.lit("x-"), "path").alias("path"), F.lit(None).cast("string").alias("content"), F.lit(3).cast("long").alias("seq")))
    live = LiveVerdicts(spark, f"{at}/state", KNOWN.checks, session_store(spark))
    for changes in (first, then):
        changes.write.mode("append").parquet(f"{at}/changes")
        live.follow(f"{at}/changes", f"{at}/checkpoint").awaitTermination()
    return live.verdicts().select("path", "type_id", "ok", F.array_join("errors", "|").alias("errors"))


@_query(f"""SELECT count(*) AS checked, count(*) FILTER (NOT ok) AS fail, count(*) FILTER (NOT ok) = 0 AND (SELECT count(*) FROM {STATES} WHERE state <> 'expected') = 0 AS ok,
  (SELECT string_agg(line, chr(10) ORDER BY rank) FROM (SELECT concat(path, ': ', errors) AS line, row_number() OVER (ORDER BY path, type_id = 'account-doc') AS rank FROM {VERDICTS} WHERE NOT ok) WHERE rank <= {registry.FAILURES}) AS failures FROM {VERDICTS}""")
def corpus_report(spark, d):
    line = lambda f: F.concat(f["path"], F.lit(": "), F.array_join(f["errors"], "|"))
    return registry.whole(spark, made.files(spark, d), KNOWN)[2].withColumn("failures", F.array_join(F.transform("failures", line), "\n"))


@_query(f"SELECT name, violation, state FROM {STATES}")
def corpus_audits(spark, d):
    return registry.whole(spark, made.files(spark, d), KNOWN)[1]


@_query(f"SELECT {PATH} AS path, 'stray words' AS text FROM customer WHERE c_custkey % 37 = 0")
def outside_type(spark, d):
    return corpus.outside_the_type(_nodes(spark, d)).select("path", "text")


@_query("SELECT * FROM (VALUES ('every-link-resolves', 'templates/customer.template.html', 'customer-doc'), ('every-link-resolves', 'templates/nation.template.html', 'nation-doc')) v(name, template_path, type_id)")
def audit_touches(spark, d):
    nodes = _nodes(spark, d)
    return corpus.touched(corpus.audits(nodes), corpus.types(nodes))


# ---- hosts and lines ----

COUNT = f"(SELECT count(*) FROM customer WHERE {TEMPLATE} = 'templates/customer.template.html')"
ALL = "(SELECT count(*) FROM customer)"


@_query(f"SELECT 'customer' AS id, {COUNT} AS n UNION ALL SELECT 'account', {ALL} UNION ALL SELECT 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT id, 0 FROM {made.values([('template',), ('list',), ('broken',)], 'id')}")
def instances_per_host(spark, d):
    return corpus.instances_per_host(_nodes(spark, d), corpus.hosts(made.files(spark, d)))


@_query(f"SELECT id, path FROM {made.values([('customer', 'templates/customer.template.html'), ('account', 'templates/account.template.html'), ('nation', 'templates/nation.template.html'), ('template', 'templates/template.template.html'), ('list', 'commands/list.command.html'), ('broken', 'commands/broken.command.html')], 'id, path')}")
def host_resolve(spark, d):
    return corpus.host_of(corpus.hosts(made.files(spark, d)))


def _host(id_: str, n: str, path: str, *lines: str) -> str:
    first = f"concat('{id_}  ', {n}, '  ({path})')"
    return " UNION ALL ".join(f"SELECT 1 AS section, '{id_}' AS host, '{path}' AS path, {i} AS seq, {x} AS line" for i, x in enumerate([first, *(f"'{y}'" for y in lines), "''"]))


ROSTER = " UNION ALL ".join([
    "SELECT 0 AS section, '' AS host, '' AS path, seq, line FROM " + made.values([(0, "lectern: documents say what they are."), (1, ""), (2, "Run a command:       lectern HOST COMMAND [VERB ...] [--FLAG [VALUE]]"), (3, "List a host's own:   lectern HOST --help"), (4, "")], "seq, line"),
    _host("account", f"{ALL}, ' docs'", "templates/account.template.html"), _host("broken", "'no docs'", "commands/broken.command.html", "  (unreadable: ( is not closed)"),
    _host("customer", f"{COUNT}, ' docs'", "commands/customer.command.html"), _host("customer", f"{COUNT}, ' docs'", "templates/customer.template.html", "  People who order.", "", "  list    Lists customers.", "  enroll  Adds one."),
    _host("list", "'no docs'", "commands/list.command.html", "", "    Lists all."), _host("nation", "(SELECT count(*) FROM nation), ' docs'", "templates/nation.template.html"), _host("template", "'no docs'", "templates/template.template.html", "  What types are."),
])


@_query(f"SELECT section, host, path, CAST(seq AS INTEGER) AS seq, line FROM ({ROSTER})")
def roster_lines(spark, d):
    return roster.roster(spark, made.files(spark, d), _nodes(spark, d))


@_query("SELECT * FROM (VALUES ('every-link-resolves', 0, '  every-link-resolves  Every link points at a file.'), ('every-link-resolves', 1, '                       touches customer-* nation-doc'), ('unwritten', 0, '  unwritten')) v(host, seq, line)")
def audit_roster(spark, d):
    return roster.audit_lines(_nodes(spark, d, tags=["script"])).select("host", "seq", "line")


# ---- references ----

EDGES = (
    f"(SELECT {PATH} AS src, 'theme.css' AS dst FROM customer UNION ALL SELECT {PATH}, {ACCOUNT} FROM customer UNION ALL SELECT {PATH}, 'templates/customer.template.html' FROM customer WHERE {TEMPLATE} = 'templates/customer.template.html' "
    f"UNION ALL SELECT {made.NATION_PATH}, dst FROM nation, {made.values([(x,) for x in ('templates/nation.template.html', 'lib/nation.js', 'nations/local.js', 'theme.css', 'inner.js', 'root.html')], 'dst')} "
    f"UNION ALL SELECT src, dst FROM {made.values([('templates/customer.template.html', 'templates/customer.css'), ('templates/customer.template.html', 'templates/template.template.html'), ('templates/template.template.html', 'templates/template.template.html')], 'src, dst')})"
)


@_query(f"SELECT src, dst FROM {EDGES}")
def local_refs(spark, d):
    return references.local_references(made.files(spark, d))


@_query(f"SELECT {PATH} AS path, CAST({made.BALANCE} AS VARCHAR) AS balance, 'customer-doc' AS within FROM customer")
def first_descendant(spark, d):
    """Of each customer's body the first account-balance inside, and of it the document that it stands in."""
    nodes = _nodes(spark, d).where("path like 'customers/%'")
    found = sel.first_descendant(nodes, nodes.where("tag = 'body'").select("path", "node_id", "last_id"), "ACCOUNT-BALANCE")
    outer = sel.first_descendant(nodes, nodes.where("tag = 'body'").select("path", "node_id", "last_id"), "customer-doc").join(nodes.select("path", F.col("node_id").alias("found"), F.col("tag").alias("within")), ["path", "found"]).select("path", "within")
    return found.join(nodes.select("path", F.col("node_id").alias("found"), F.col("content").alias("balance")), ["path", "found"]).join(outer, "path").select("path", "balance", "within")


@_query(f"SELECT {PATH} AS path, 'hollow' AS violation FROM customer WHERE c_custkey % 3 <> 0")
def hollow_documents(spark, d):
    """Customers' documents without a tag, or a note that says something, by the table function over their instances."""
    tables.register(spark, registry.Registry(), "hollow-action", tables.Hollow, lambda t: t["actions"], "document")
    found = tables.audited(spark, "hollow-action", tables.actions(_nodes(spark, d), "customer-doc", ("customer-note", "customer-tag")), "document")
    return found.select(F.substring_index("document", "#", 1).alias("path"), "violation")


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, unit, 'pronoun' AS rule FROM supplier, (VALUES (3), (4), (5)) v(unit)")
def prose_scripts(spark, d):
    rows = _scripts(spark, d).where("idx = 0").select("path", "source")
    return prose.findings(rows, "path", "source", [prose.Rule("pronoun", r"\bit\.", ("it",))], "comment").select("path", F.col("unit").cast("long").alias("unit"), "rule")


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, id, 'script' AS tag FROM (SELECT s_suppkey, unnest([concat('s', s_suppkey), 'other']) AS id FROM supplier)")
def element_by_id(spark, d):
    return sel.by_id(_nodes(spark, d).where("path like 'suppliers/%'")).select("path", "id", "tag")


SEED = f"""WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES}), c(path) AS (SELECT path FROM {made.FILES_SQL} WHERE path IN ('theme.css', 'templates/customer.template.html') OR path LIKE 'nations/%.html' OR path LIKE 'commands/%.html' UNION SELECT e.dst FROM c JOIN e ON e.src = c.path) SELECT path FROM c"""


@_query(SEED)
def seed_paths(spark, d):
    return references.seed_paths(spark, made.files(spark, d), ["customer", "absent"], folders=("nations", "commands"))


@_query(f"SELECT path, CASE WHEN path LIKE '%.html' THEN 'rewrite' ELSE 'copy' END AS action FROM ({SEED}) WHERE path NOT LIKE 'commands/%'")
def seed_plan(spark, d):
    files = made.files(spark, d)
    return commands.seed_plan(references.seed_paths(spark, files, ["customer"], folders=("nations", "commands")), files.where("path like 'commands/%'"))


@_query(f"SELECT {PATH} AS path, {made.joined(made.DOCTYPE, made.customer(repoint=True))} AS content FROM customer")
def repoint_links(spark, d):
    carried = _read(spark, d, "nation").select(F.expr(made.NATION_PATH).alias("path"))
    return rewrite.repoint(_customers(spark, d), carried, made.SITE)


# ---- documents as text ----


@_query(f"SELECT {PATH} AS path, {made.customer()} AS html FROM customer")
def serialize_roundtrip(spark, d):
    return _customers(spark, d).select("path", markup.serialized("content").alias("html"))


@_query(f"SELECT {PATH} AS path, {made.customer(line='chr(10)')} AS html FROM customer")
def reindent(spark, d):
    return _customers(spark, d).select("path", markup.reindented("content").alias("html"))


# ---- scripts ----

LOCATORS = [("s", 0, ".ts", "module-typescript"), ("other", 1, ".js", "module"), ("@2", 2, ".ts", "module-typescript")]


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, idx, CASE WHEN locator = 's' THEN concat('s', s_suppkey) ELSE locator END AS locator, ext, format FROM supplier, {made.values(LOCATORS, 'locator, idx, ext, format')}")
def script_lang(spark, d):
    return _scripts(spark, d).select("path", "idx", "locator", "ext", sel.script_format("type").alias("format"))


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, wanted, idx FROM supplier, {made.values([('@0', 0), ('@7', -1), ('other', 1), ('@1', 1)], 'wanted, idx')}")
def locator_join(spark, d):
    wanted = _read(spark, d, "supplier").select(F.expr(made.SUPPLIER_PATH).alias("path"), F.explode(F.array(*[F.lit(x) for x in ("@0", "@7", "other", "@1")])).alias("wanted"))
    found = references.located(_scripts(spark, d)).select("path", F.col("locator").alias("wanted"), "idx")
    return wanted.join(found, ["path", "wanted"], "left").select("path", "wanted", F.coalesce("idx", F.lit(-1)).alias("idx"))


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, spec, goal, locator, outcome FROM (SELECT s_suppkey, concat('./lib', s_suppkey % 7, '.js') AS spec, NULL AS goal, NULL AS locator, 'other' AS outcome FROM supplier UNION ALL SELECT s_suppkey, '#other', {made.SUPPLIER_PATH}, 'other', 'found' FROM supplier)")
def import_edges(spark, d):
    return references.import_targets(_scripts(spark, d)).select("path", "spec", "goal", "locator", "outcome")


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, wanted AS locator, CASE WHEN wanted = 'other' THEN 'module' END AS format, CASE WHEN wanted = 'other' THEN 'export const o = 1' END AS source, CASE WHEN wanted = 'no%x' THEN concat('no script no%x in ', {made.SUPPLIER_PATH}) END AS error FROM supplier, (VALUES ('other'), ('no%x')) v(wanted)")
def script_load(spark, d):
    asked = _read(spark, d, "supplier").select(F.expr(made.SUPPLIER_PATH).alias("path"), F.explode(F.array(F.lit("other"), F.lit("no%x"))).alias("locator"))
    return references.loaded(asked.select(t.synthetic_url("path", "locator").alias("url")), _scripts(spark, d)).drop("url")


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, replace({made.COMMAND}, './lib0.js', './z.js') AS source FROM supplier")
def import_rewrite(spark, d):
    table = spark.createDataFrame([("./lib0.js", "./z.js")], "spec string, new string")
    return rewrite.rewrite_imports(_scripts(spark, d).where("idx = 0").select("path", "source"), table, ["path"])


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, idx, CASE WHEN idx = 0 THEN concat('Sells ', s_name, '.') ELSE '' END AS summary FROM supplier, (VALUES (0), (1), (2)) v(idx)")
def leading_comment(spark, d):
    return _scripts(spark, d).select("path", "idx", commands.leading_comment("source").alias("summary"))


#: A supplier's commands: place, words and comment.
COMMANDS = f"""(SELECT s_suppkey, s_name, ord, label, doc FROM supplier, LATERAL (SELECT * FROM (VALUES (0, concat('sell', s_suppkey), concat(' Sells ', s_name, '. More to say.', chr(10), '@x')), (1, concat('stock', s_suppkey, ' add'), ' Adds to it.'),
  (2, concat('stock', s_suppkey, ' rm all-of-it'), ' Takes from it.'), (3, concat('stock', s_suppkey, ' restock'), ' Fills it.'), (4, 'refill', ' Fills it.')) v(ord, label, doc)) c)"""


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, ord, label, len(string_split(label, ' ')) AS words, doc FROM {COMMANDS}")
def command_list(spark, d):
    rows = commands.command_list(_scripts(spark, d).where("idx = 0").select(F.col("path").alias("document"), "source"), "document")
    return rows.select(F.col("document").alias("path"), "ord", "label", F.size("path").cast("long").alias("words"), "doc")


@_query(f"SELECT {made.SUPPLIER_PATH} AS path, label, concat('  ', label, chr(10), '    ', replace(doc, chr(10), concat(chr(10), '    '))) AS help FROM {COMMANDS}")
def help_lines(spark, d):
    return command_list(spark, d).select("path", "label", commands.help_text("label", "doc").alias("help"))


#: What orders ask of suppliers, by the order's key.
ASKED = """(SELECT o_orderkey AS request, CASE WHEN o_orderkey % 9 = 0 THEN -(o_custkey % 10) - 1 ELSE o_custkey % 10 END AS host, o_custkey % 10 AS k, o_orderkey % 7 + 1 AS n, CAST(floor(o_orderkey / 7) AS BIGINT) % 3 AS m FROM orders)"""
ARGV = "CASE WHEN n = 1 THEN array(concat('sell', k), '--to', 'x', 'y') WHEN n = 2 AND m = 0 THEN array('--help') WHEN n = 2 AND m = 1 THEN array('--all') WHEN n = 2 THEN array() WHEN n = 3 THEN array(concat('stock', k), '--f', 'add', 'add') WHEN n = 4 AND m = 0 THEN array(concat('stock', k)) WHEN n = 4 AND m = 1 THEN array(concat('stock', k), 'rm') WHEN n = 4 THEN array(concat('stock', k), 'rm', 'all-of-it', 'z') WHEN n = 5 THEN array(concat('stock', k), 'rm', 'some') WHEN n = 6 THEN array(concat('sell', k + 1)) ELSE array('refill') END"


@_query(f"""SELECT request, CASE WHEN host < 0 THEN 1 WHEN n IN (1, 3) OR n > 6 OR n = 2 AND m = 0 OR n = 4 AND m = 2 THEN 0 ELSE 1 END AS status,
  CASE WHEN host < 0 THEN 'unknown-host' WHEN n = 2 THEN 'help' WHEN n = 4 AND m < 2 THEN 'needs-verb' WHEN n = 5 THEN 'unknown-verb' WHEN n = 6 THEN 'unknown-command' ELSE 'run' END AS outcome,
  CASE WHEN host < 0 OR n IN (2, 6) THEN '' WHEN n = 1 THEN concat('sell', k) WHEN n = 3 THEN concat('stock', k, ' add') WHEN n = 4 AND m = 0 THEN concat('stock', k) WHEN n = 4 AND m = 1 OR n = 5 THEN concat('stock', k, ' rm') WHEN n = 4 THEN concat('stock', k, ' rm all-of-it') ELSE 'refill' END AS label,
  CASE WHEN host >= 0 AND n = 4 AND m = 0 THEN 'add rm restock' WHEN host >= 0 AND (n = 4 AND m = 1 OR n = 5) THEN 'all-of-it' WHEN host >= 0 AND n IN (2, 6) THEN concat('sell', k, ' stock', k, ' refill') ELSE '' END AS takes
  FROM {ASKED}""")
def verb_resolve(spark, d):
    _read(spark, d, "orders").createOrReplaceTempView("lectern_orders")
    asked = spark.sql(f"SELECT request, CAST(host AS STRING) AS id, {ARGV} AS argv FROM {ASKED.replace('FROM orders', 'FROM lectern_orders')}")
    own = commands.command_list(_scripts(spark, d).where("idx = 0").select(F.regexp_extract("path", "[0-9]+", 0).alias("id"), "source"), "id")
    rows = commands.resolve(asked, own.select("id"), own.select("id", "ord", "path"))
    return rows.select("request", F.col("status").cast("int").alias("status"), "outcome", "label", F.array_join("takes", " ").alias("takes"))


@_query(f"SELECT path, content FROM {made.FILES_SQL} WHERE path LIKE 'nations/%.html'")
def source_read(spark, d):
    """Documents written to a folder by the data source and read back; only the folder asked for is listed."""
    at = f"{shared_dir(spark)}/lectern/folder-{uuid.uuid4().hex}"
    session.write_files(made.files(spark, d).where("path not like 'customers/%'"), at)
    return files.files(spark, at).where("path like 'nations/%'")


@_query("SELECT concat('pkg', g) AS name, concat('1.', substr(path, 11, length(path) - 15)) AS version, concat('pkg', g, '@1.', substr(path, 11, length(path) - 15)) AS spec FROM (SELECT s_suppkey % 5 AS g, max(concat('suppliers/', s_suppkey, '.html')) AS path FROM supplier GROUP BY g)")
def importmap_merge(spark, d):
    return corpus.install_plan(corpus.importmaps(_nodes(spark, d, tags=["script"])))


@_query(f"""SELECT path, seg, CASE seg WHEN 0 THEN first ELSE first + pos + (seg - 1) * 8 END AS source_offset, CASE seg WHEN 0 THEN 0 WHEN 1 THEN pos ELSE pos + length(path) + 9 END AS generated_offset,
  CASE seg WHEN 0 THEN pos WHEN 1 THEN 8 ELSE length(source) - pos - 8 END AS length FROM (SELECT {made.SUPPLIER_PATH} AS path, {made.COMMAND} AS source, strpos({made.COMMAND}, '"#other"') - 1 AS pos,
  strpos({made.joined(made.DOCTYPE, made.SUPPLIER)}, {made.COMMAND}) - 1 AS first FROM supplier), (VALUES (0), (1), (2)) v(seg)""")
def block_mapping(spark, d):
    rows = _read(spark, d, "supplier").select(F.expr(made.SUPPLIER_PATH).alias("path"), F.expr(made.joined(made.DOCTYPE, made.SUPPLIER)).alias("content"))
    b = rows.select("path", F.col("path").alias("base"), F.explode(script.blocks_of("content")).alias("b")).select("path", "base", "b.*").where("idx < 2")
    return rewrite.block_mapping(b, "path", "base").where("idx = 0").select("path", "seg", *[F.col(c).cast("long").alias(c) for c in ("source_offset", "generated_offset", "length")])


@_query(f"""SELECT path, idx, concat(path, '.', idx, CASE WHEN idx = 1 THEN '.js' ELSE '.ts' END) AS name, CASE idx WHEN 0 THEN replace(command, '"#other"', concat('"./', path, '.1.js"')) WHEN 1 THEN 'export const o = 1' ELSE '' END AS text
  FROM (SELECT {made.SUPPLIER_PATH} AS path, {made.COMMAND} AS command FROM supplier), (VALUES (0), (1), (2)) v(idx)""")
def virtual_slots(spark, d):
    """Suppliers' script blocks as the files that stand for them; the import map's is empty."""
    return rewrite.virtual_files(_scripts(spark, d).select("path", F.col("path").alias("base"), "idx", "type", "id", "source"), "path", "base")


@_query(f"""SELECT path, 'sentence' AS kind, 'stray' AS rule, 0 AS unit FROM (SELECT {PATH} AS path FROM customer WHERE c_custkey % 37 = 0)
  UNION ALL SELECT {made.SUPPLIER_PATH}, 'comment', 'stock', unit FROM supplier, (VALUES (2)) v(unit) UNION ALL SELECT concat('notes/', n_nationkey, '.md'), 'block', 'stock', 1 FROM nation""")
def prose_corpus(spark, d):
    notes = _read(spark, d, "nation").select(F.expr("concat('notes/', n_nationkey, '.md')").alias("path"), F.expr("concat('# ', n_name, chr(10), chr(10), 'Stock.', chr(10))").alias("content"))
    rules = [prose.Rule("stray", "stray [a-z]+", ("stray ",)), prose.Rule("stock", "Stock[.]", ("Stock",))]
    return prose.of_corpus(made.files(spark, d).unionByName(notes), _nodes(spark, d), rules).select("path", "kind", "rule", "unit")


@_query("SELECT c_custkey AS instance, 'attribute' AS rule, 'nation@key' AS field, 'nation@key: attribute' AS message FROM customer WHERE NOT regexp_matches(CAST(c_nationkey AS VARCHAR), '^1')")
def validate_attr(spark, d):
    found = _read(spark, d, "customer").select(F.col("c_custkey").alias("instance"), F.lit("nation").alias("field"), F.lit("x").alias("text"), F.create_map(F.lit("key"), F.col("c_nationkey").cast("string")).alias("attrs"))
    fields = spark.createDataFrame([("customer", "nation", {"key": "^1"})], "type string, field string, attrs map<string,string>")
    return validate.attribute(found.select("instance", F.lit("customer").alias("type")), found, fields)
