"""The registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import registry, tables
from lectern.functions import script
from lectern.functions import text as t
from lectern.operators import graph, overlay, prose, validate
from lectern.sources import html
from lectern.sources.files import ignored, visible

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _links(spark, d) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", "url", F.explode(F.expr(r"""regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)""")).alias("href"))


LINKS = r"""(SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS href FROM pages)"""
SCRIPT = script.BLOCK
SCRIPTS = rf"""(SELECT page_id, i - 1 AS idx, regexp_extract(a, '{script.TYPE}', 1) AS type, regexp_extract(a, '{script.ID}', 1) AS id, source
  FROM (SELECT page_id, unnest(generate_series(1, len(aa))) AS i, unnest(aa) AS a, unnest(ss) AS source
        FROM (SELECT page_id, regexp_extract_all(html, '{SCRIPT}', 1) AS aa, regexp_extract_all(html, '{SCRIPT}', 2) AS ss FROM pages)))"""


def _scripts(spark, d) -> DataFrame:
    p = SCRIPT.replace("\\", "\\\\")
    rows = _read(spark, d, "pages").select("page_id", F.expr(f"posexplode(arrays_zip(regexp_extract_all(html, '{p}', 1), regexp_extract_all(html, '{p}', 2)))").alias("idx", "s"))
    a = F.col("s.0")
    return rows.select("page_id", F.col("idx").cast("long").alias("idx"), F.regexp_extract(a, script.TYPE, 1).alias("type"), F.regexp_extract(a, script.ID, 1).alias("id"), F.col("s.1").alias("source"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Links of parsed pages by kind."""
    nodes = html.nodes(_read(spark, d, "pages"), "page_id", "html", tags=["a"], columns=["attrs", "tpl_root"]).where("tpl_root is null")
    return nodes.select(t.link_class(F.col("attrs")["href"]).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@_query(f"SELECT page_id, href FROM {LINKS}")
def link_scan(spark, d):
    return _links(spark, d).select("page_id", "href")


@_query(rf"SELECT href, CASE WHEN href = '' THEN 'empty' WHEN href LIKE '#%' THEN 'fragment' WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' ELSE 'path' END AS kind, count(*) AS n FROM {LINKS} GROUP BY ALL")
def link_class(spark, d):
    return _links(spark, d).groupBy("href", t.link_class("href").alias("kind")).agg(F.count("*").alias("n"))


@_query("SELECT url, split_part(url, '#', 1) AS target, CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#')) ELSE '' END AS fragment FROM pages")
def link_parts(spark, d):
    return _read(spark, d, "pages").select("url", t.link_target("url").alias("target"), t.link_fragment("url").alias("fragment"))


def _made(spark, d, table: str, *columns: str) -> DataFrame:
    """Expressions over a table that Spark and the oracle read alike."""
    return _read(spark, d, table).selectExpr(*columns)


#: A path of each customer, and its normal form, by the remainder of the key.
RAW = "CASE c_custkey % 7 WHEN 0 THEN concat('a/./b', c_custkey) WHEN 1 THEN concat('a', c_custkey, '/../b') WHEN 2 THEN concat('../x', c_custkey) WHEN 3 THEN concat('a/b', c_custkey, '/../../..') WHEN 4 THEN '' WHEN 5 THEN concat('/a', c_custkey, '//b/') ELSE concat('/../x', c_custkey) END"
NORMAL = "CASE c_custkey % 7 WHEN 0 THEN concat('a/b', c_custkey) WHEN 1 THEN 'b' WHEN 2 THEN concat('../x', c_custkey) WHEN 3 THEN '..' WHEN 4 THEN '.' WHEN 5 THEN concat('/a', c_custkey, '/b') ELSE concat('/x', c_custkey) END"


@_query(f"SELECT {RAW} AS path, {NORMAL} AS normal FROM customer")
def path_normalize(spark, d):
    return _made(spark, d, "customer", f"{RAW} AS path").select("path", t.path_normalize("path").alias("normal"))


#: Two documents of each customer, and the link from one to the other.
SRC = "CASE c_custkey % 4 WHEN 0 THEN concat('a/', c_custkey, '.html') WHEN 1 THEN concat('a/', c_custkey, '.html') WHEN 2 THEN 'b.html' ELSE concat('a/b/', c_custkey, '.html') END"
DST = "CASE c_custkey % 4 WHEN 0 THEN concat('a/c', c_nationkey, '.html') WHEN 1 THEN concat('c', c_nationkey, '.html') WHEN 2 THEN concat('x/c', c_nationkey, '.html') ELSE concat('a/d/e', c_nationkey, '.html') END"
HREF = "CASE c_custkey % 4 WHEN 0 THEN concat('./c', c_nationkey, '.html') WHEN 1 THEN concat('../c', c_nationkey, '.html') WHEN 2 THEN concat('./x/c', c_nationkey, '.html') ELSE concat('../d/e', c_nationkey, '.html') END"


@_query(f"SELECT {SRC} AS src, {DST} AS dst, {HREF} AS href FROM customer")
def rel_href(spark, d):
    return _made(spark, d, "customer", f"{SRC} AS src", f"{DST} AS dst").select("src", "dst", t.rel_href("src", "dst").alias("href"))


KNOWN = f"(SELECT DISTINCT href AS node FROM {LINKS} WHERE length(href) % 2 = 0)"


@_query(f"SELECT page_id AS src, href AS dst FROM {LINKS} WHERE href NOT IN (SELECT node FROM {KNOWN})")
def dangling_links(spark, d):
    links = _links(spark, d).select(F.col("page_id").alias("src"), F.col("href").alias("dst"))
    return graph.dangling(links, links.select(F.col("dst").alias("node")).where("length(dst) % 2 = 0").distinct())


@_query(f"SELECT href, count(*) AS n FROM {LINKS} WHERE href <> '' AND href NOT LIKE '#%' AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND split_part(href, '#', 1) NOT IN (SELECT node FROM {KNOWN}) GROUP BY href")
def outward_links(spark, d):
    links = _links(spark, d)
    known = links.select(F.col("href").alias("target")).where("length(href) % 2 = 0").distinct()
    out = links.where(t.link_class("href") == "path").withColumn("target", t.link_target("href"))
    return out.join(known, "target", "left_anti").groupBy("href").agg(F.count("*").alias("n"))


@_query(f"SELECT page_id, idx, type, id, source FROM {SCRIPTS}")
def script_blocks(spark, d):
    return _scripts(spark, d)


@_query(f"SELECT page_id, coalesce(nullif(id, ''), '@' || idx) AS locator FROM {SCRIPTS}")
def script_locator(spark, d):
    return _scripts(spark, d).select("page_id", t.locator("id", "idx").alias("locator"))


@_query(f"SELECT page_id, page_id || '.' || idx || CASE WHEN type LIKE 'node/%' THEN '.ts' ELSE '.js' END AS name, length(source) AS n FROM {SCRIPTS}")
def virtual_files(spark, d):
    name = F.concat(F.col("page_id").cast("string"), F.lit("."), F.col("idx").cast("string"), t.script_lang("type"))
    return _scripts(spark, d).select("page_id", name.alias("name"), F.length("source").cast("long").alias("n"))


@_query(f"SELECT count(*) AS blocks, count(DISTINCT page_id) AS documents FROM {SCRIPTS}")
def script_totals(spark, d):
    return _scripts(spark, d).agg(F.count("*").alias("blocks"), F.count_distinct("page_id").alias("documents"))


#: A path of each part, by the remainder of its key.
PART = "CASE p_partkey % 9 WHEN 0 THEN concat('a', p_partkey, '.html') WHEN 1 THEN concat('.x/a', p_partkey, '.html') WHEN 2 THEN concat('n/node_modules/b', p_partkey, '.html') WHEN 3 THEN concat('n/b', p_partkey, '.html') WHEN 4 THEN concat('_u', p_partkey, '.html') WHEN 5 THEN concat('build/z', p_partkey, '.html') WHEN 6 THEN concat('c', p_partkey, '.htm') WHEN 7 THEN concat('a/.b', p_partkey) ELSE concat('x', p_partkey, '/tmp1.html') END"


@_query(f"SELECT {PART} AS path FROM part WHERE p_partkey % 9 NOT IN (1, 2, 7)")
def walk_filter(spark, d):
    return _made(spark, d, "part", f"{PART} AS path").where(visible("path"))


@_query(f"SELECT {PART} AS path FROM part WHERE p_partkey % 9 NOT IN (5, 8)")
def ignore_filter(spark, d):
    return _made(spark, d, "part", f"{PART} AS path").where(~ignored("path", ["# note", "/build/", "tmp?.html"]))


@_query("SELECT page_id FROM pages WHERE split_part(url, '#', 1) LIKE '%.html'")
def html_files(spark, d):
    return _read(spark, d, "pages").where(t.link_target("url").endswith(".html")).select("page_id")


FIELD_ROWS = [("order", "status", True, None, "F O", False), ("order", "priority", True, "^[1-3]-", None, False), ("order", "clerk", True, None, None, False), ("order", "note", False, None, None, True)]


def _orders(spark, d):
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("instance"), F.lit("order").alias("type"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("x").alias("clerk"), F.when(F.col("o_orderkey") % 7 == 0, "y").alias("extra"))
    found = orders.select("instance", F.expr("stack(4, 'status', status, 'priority', priority, 'clerk', clerk, 'extra', extra) as (field, text)")).where("text is not null")
    fields = spark.createDataFrame(FIELD_ROWS, "type string, field string, required boolean, pattern string, enum string, repeatable boolean")
    return orders.select("instance", "type"), found, fields


def _rule(rule: str, field: str, where: str) -> str:
    return f"SELECT o_orderkey AS instance, '{rule}' AS rule, '{field}' AS field, '{field}: {rule}' AS message FROM orders WHERE {where}"


RULES = {
    "required": _rule("required", "clerk", "o_orderkey % 5 = 0"),
    "pattern": _rule("pattern", "priority", "NOT regexp_matches(o_orderpriority, '^[1-3]-')"),
    "enum": _rule("enum", "status", "o_orderstatus NOT IN ('F', 'O')"),
    "empty": _rule("empty", "clerk", "o_orderkey % 5 = 0"),
    "undeclared": _rule("undeclared", "extra", "o_orderkey % 7 = 0"),
}
ALL_RULES = "(" + " UNION ALL ".join(RULES.values()) + ")"


@_query(RULES["required"])
def validate_required(spark, d):
    return validate.required(*_orders(spark, d))


@_query(RULES["pattern"])
def validate_pattern(spark, d):
    return validate.pattern(*_orders(spark, d))


@_query(RULES["enum"])
def validate_enum(spark, d):
    return validate.enum(*_orders(spark, d))


@_query(RULES["empty"])
def empty_fields(spark, d):
    return validate.empty(_orders(spark, d)[1])


@_query("SELECT o_custkey AS instance, 'status' AS field, 'status: repeated' AS message FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_fields(spark, d):
    orders = _read(spark, d, "orders").select(F.col("o_custkey").alias("instance"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("text"))
    fields = spark.createDataFrame(FIELD_ROWS, "type string, field string, required boolean, pattern string, enum string, repeatable boolean")
    return validate.repeated(orders.select("instance").distinct().withColumn("type", F.lit("order")), orders, fields).select("instance", "field", "message")


@_query("SELECT event_id AS instance, 'undeclared' AS rule, 'k' AS field, 'k: undeclared' AS message FROM events")
def undeclared_fields(spark, d):
    found = _read(spark, d, "events").select(F.col("event_id").alias("instance"), F.explode(F.json_object_keys("props")).alias("field"))
    fields = spark.createDataFrame([("event", "n")], "type string, field string")
    return validate.undeclared(found.select("instance", F.lit("event").alias("type")).distinct(), found, fields)


@_query(f"SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS checked, count(DISTINCT instance) AS fail FROM {ALL_RULES}")
def validate_report(spark, d):
    return validate.report(validate.checked(*_orders(spark, d)))


@_query(f"SELECT o.o_orderkey AS instance, count(e.message) = 0 AS ok, coalesce(string_agg(e.message, ',' ORDER BY e.k, e.message), '') AS errors FROM orders o LEFT JOIN (SELECT instance, message, 0 AS k FROM {ALL_RULES} UNION ALL SELECT o_orderkey, 'dear', 1 FROM orders WHERE o_totalprice > 200000) e ON e.instance = o.o_orderkey GROUP BY o.o_orderkey")
def validate_matrix(spark, d):
    custom = _read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("instance"), F.lit("dear").alias("message"))
    return validate.verdicts(validate.checked(*_orders(spark, d)), custom).withColumn("errors", F.array_join("errors", ","))


@_query(f"SELECT coalesce(f.instance, e.instance) AS instance, CASE WHEN e.instance IS NULL THEN 'unexpected' WHEN f.instance IS NULL THEN 'missing' ELSE 'expected' END AS state FROM (SELECT DISTINCT instance FROM {ALL_RULES}) f FULL JOIN (SELECT o_orderkey AS instance FROM orders WHERE o_orderkey % 3 = 0) e ON e.instance = f.instance")
def expected_violations(spark, d):
    found = validate.validate(*_orders(spark, d))
    expected = _read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("instance"))
    return validate.reconciled(found, expected, ["instance"])


@_query("SELECT o_orderkey AS node FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark, d):
    nodes = _read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderstatus") == "P").alias("goal"))
    edges = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return graph.orphans(nodes, edges)


@_query("SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_outcome(spark, d):
    edges = _read(spark, d, "labels").select(F.lit(None).cast("long").alias("src"), F.col("doc_id").alias("dst"))
    return graph.without_cause(_read(spark, d, "documents").select(F.col("doc_id").alias("node")), edges)


@_query("SELECT l_orderkey AS action FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_returnflag = 'R' OR l_discount > 0.08)")
def hollow_action(spark, d):
    return graph.hollow(_actions(spark, d))


@_query("SELECT l_orderkey AS action, 'hollow' AS violation FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_returnflag = 'R' OR l_discount > 0.08)")
def audit_table(spark, d):
    """The same audit as a table function of SQL."""
    known = registry.Registry()
    tables.register(spark, known, "hollow-action", tables.Hollow, lambda t: t["actions"], "action")
    return tables.audited(spark, "hollow-action", _actions(spark, d), "action")


def _actions(spark, d) -> DataFrame:
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("action"), ((F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.08)).alias("has"))


@_query("""WITH RECURSIVE e(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's1', 'r0' UNION ALL SELECT 's2', 'r1'),
 c(node) AS (SELECT 'r0' UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c""")
def seed_closure(spark, d):
    link = lambda a, x, b, y: (F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    edges = _read(spark, d, "nation").select(*link("r", "n_regionkey", "n", "n_nationkey")).union(_read(spark, d, "supplier").select(*link("n", "s_nationkey", "s", "s_suppkey")))
    edges = edges.union(spark.createDataFrame([("s1", "r0"), ("s2", "r1")], "src string, dst string"))
    return graph.closure(spark, spark.createDataFrame([("r0",)], "node string"), edges)


@_query(r"""SELECT doc_id, CASE WHEN length(c) > 76 THEN regexp_replace(substr(c, 1, 75), ' +$', '') || '…' ELSE c END AS s FROM (SELECT doc_id, coalesce(nullif(regexp_extract(l, '^(.*?\.)(?:\s|$)', 1), ''), l) AS c
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS l FROM documents))""")
def first_sentence(spark, d):
    return _read(spark, d, "documents").select("doc_id", t.first_sentence("text").alias("s"))


#: Texts of white space, and of more, whether they stand in a pre, and what becomes of them.
GAP = "repeat(chr(10), CAST(o_orderkey % 4 AS INTEGER))"


@_query(f"SELECT o_orderkey AS i, CASE o_orderkey % 3 WHEN 0 THEN concat('a', {GAP}, 'b') WHEN 1 THEN {GAP} ELSE CASE WHEN o_orderkey % 4 > 1 THEN concat(chr(10), ' ', chr(10)) ELSE concat({GAP}, ' ', {GAP}) END END AS s FROM orders")
def ws_collapse(spark, d):
    text = f"CASE o_orderkey % 3 WHEN 0 THEN concat('a', {GAP}, 'b') WHEN 1 THEN {GAP} ELSE concat({GAP}, ' ', {GAP}) END"
    return _made(spark, d, "orders", "o_orderkey AS i", f"{text} AS s", "o_orderkey % 3 = 1 AS pre").select("i", t.ws_collapse("s", F.col("pre")).alias("s"))


@_query(r"SELECT page_id, replace(source, '</p', '<\/p') AS source FROM " + SCRIPTS)
def escape_raw(spark, d):
    return _scripts(spark, d).select("page_id", t.escape_raw("source", F.lit("p")).alias("source"))


@_query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS purpose FROM documents")
def host_purpose(spark, d):
    return _read(spark, d, "documents").select("doc_id", t.squeeze("text").alias("purpose"))


#: A comment of each supplier, and its text.
NOTE = "CASE s_suppkey % 3 WHEN 0 THEN concat('/* ', s_name, ' */') WHEN 1 THEN concat('/**', chr(10), ' * ', s_name, '.', chr(10), ' *', chr(10), ' *', chr(9), 'More.  ', chr(10), ' */') ELSE concat('/*', chr(10), s_name, chr(10), '*/') END"
NOTED = "CASE s_suppkey % 3 WHEN 0 THEN concat(' ', s_name) WHEN 1 THEN concat(s_name, '.', chr(10), chr(10), 'More.') ELSE s_name END"


@_query(f"SELECT s_suppkey AS i, {NOTED} AS s FROM supplier")
def format_comment(spark, d):
    return _made(spark, d, "supplier", "s_suppkey AS i", f"{NOTE} AS s").select("i", t.format_comment("s").alias("s"))


#: The words of a command line for each order, and what they come to.
LINE = "CASE o_orderkey % 9 WHEN 0 THEN array('--a') WHEN 1 THEN array('--a', o_orderstatus) WHEN 2 THEN array('--a', '--b') WHEN 3 THEN array('--a', 'x', '--a', o_orderstatus) WHEN 4 THEN array('-h') WHEN 5 THEN array(concat('--k=', o_orderkey)) WHEN 6 THEN array('--_', 'v', o_orderstatus) WHEN 7 THEN array(o_orderstatus, '-5', '--') ELSE array() END"


@_query("""SELECT o_orderkey AS i, CASE o_orderkey % 9 WHEN 4 THEN '-h' WHEN 6 THEN concat('v ', o_orderstatus) WHEN 7 THEN concat(o_orderstatus, ' -5') ELSE '' END AS pos,
  CASE o_orderkey % 9 WHEN 0 THEN 'a=true' WHEN 1 THEN concat('a=', o_orderstatus) WHEN 2 THEN 'a=true;b=true' WHEN 3 THEN concat('a=x,', o_orderstatus) WHEN 5 THEN concat('k=', o_orderkey, '=true') WHEN 7 THEN '=true' ELSE '' END AS flags FROM orders""")
def parse_args(spark, d):
    rows = _made(spark, d, "orders", "o_orderkey AS i", f"{LINE} AS argv").select("i", t.parse_args("argv").alias("a"))
    flags = F.array_join(F.transform("a.flags", lambda f: F.concat(f["k"], F.lit("="), F.array_join(f["v"], ","))), ";")
    return rows.select("i", F.array_join("a.pos", " ").alias("pos"), flags.alias("flags"))


def _store(spark, d):
    docs, labels = _read(spark, d, "documents"), _read(spark, d, "labels")
    changes = labels.select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 0, "delete").otherwise("put").alias("op"), F.when(F.col("toxic") == 1, "new").otherwise("same").alias("content"), F.lit("same").alias("original"))
    return docs.select(F.col("doc_id").alias("path"), F.col("lang").alias("content")), changes


@_query("SELECT d.doc_id AS path, CASE WHEN l.doc_id IS NULL THEN d.lang WHEN l.toxic = 1 THEN 'new' ELSE 'same' END AS content FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.quality <> 0")
def overlay_read(spark, d):
    return overlay.read(*_store(spark, d))


@_query("SELECT d.doc_id AS path, l.quality IS NULL OR l.quality <> 0 AS present FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT -1, false")
def overlay_exists(spark, d):
    files, changes = _store(spark, d)
    return overlay.exists(files.select("path").union(spark.createDataFrame([(-1,)], "path long")), files, changes)


@_query("SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def overlay_list(spark, d):
    return overlay.listing(*_store(spark, d))


@_query("SELECT doc_id AS path, CASE WHEN quality = 0 THEN 'deleted' ELSE 'wrote' END AS action FROM labels WHERE quality = 0 OR toxic = 1")
def commit_diff(spark, d):
    return overlay.commit_diff(_store(spark, d)[1])


#: What each nation's audit touches, and how that is shown.
TOUCHES = "CASE n_nationkey % 4 WHEN 0 THEN concat('n', n_nationkey, '-doc n', n_nationkey, '-task') WHEN 1 THEN concat('n', n_nationkey, '-doc') WHEN 2 THEN concat('n', n_nationkey, '-doc spec') ELSE concat('a', n_nationkey, '-b a', n_nationkey, '-b') END"


@_query(f"SELECT {TOUCHES} AS touches, CASE n_nationkey % 4 WHEN 0 THEN concat('n', n_nationkey, '-*') WHEN 3 THEN concat('a', n_nationkey, '-*') ELSE {TOUCHES} END AS shown FROM nation")
def touches_collapse(spark, d):
    return _made(spark, d, "nation", f"{TOUCHES} AS touches").select("touches", t.touches_collapse("touches").alias("shown"))


@_query(r"SELECT doc_id, rule FROM documents JOIN (VALUES ('shout', '[A-Z]{4,}!!'), ('symbols', '[#$%&*]{3}'), ('double', '\b(the the|and and)\b')) r(rule, p) ON regexp_matches(text, p)")
def prose_rules(spark, d):
    known = registry.Registry()
    for name, pattern in (("shout", "[A-Z]{4,}!!"), ("symbols", "[#$%&*]{3}"), ("double", r"\b(the the|and and)\b")):
        known.rule(name, pattern)
    return registry.prose(_read(spark, d, "documents"), "doc_id", "text", known.rules)


PROSE = [prose.Rule("shout", "[A-Z]{4,}!!", ("!!",)), prose.Rule("symbols", "[#$%&*]{3}"), prose.Rule("double", "(the the|and and) ", ("the the", "and and"))]
PROSE_SQL = ", ".join(f"('{r.name}', '{r.pattern}')" for r in PROSE)


@_query(f"""SELECT doc_id, unit, rule, len(regexp_extract_all(s, p)) AS n FROM (SELECT doc_id, unnest(u) AS s, generate_subscripts(u, 1) - 1 AS unit FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS u FROM documents))
  JOIN (VALUES {PROSE_SQL}) r(rule, p) ON regexp_matches(s, p)""")
def prose_sentences(spark, d):
    found = prose.findings(_read(spark, d, "documents"), "doc_id", "text", PROSE)
    return found.groupBy("doc_id", F.col("unit").cast("long").alias("unit"), "rule").agg(F.count("*").alias("n"))


@_query("SELECT page_id, 'ad' AS rule, len(regexp_extract_all(html, '<!-- ad [0-9]+ -->')) AS n FROM pages WHERE regexp_matches(html, '<!-- ad [0-9]+ -->')")
def prose_comments(spark, d):
    notes = html.nodes(_read(spark, d, "pages"), "page_id", "html", columns=["kind", "text"]).where("kind = 'comment'")
    return prose.findings(notes, "page_id", "text", [prose.Rule("ad", "ad [0-9]+", ("ad ",))], "text").groupBy("page_id", "rule").agg(F.count("*").alias("n"))


# ---- over parsed pages ----


@_query(f"SELECT page_id, count(*) AS n FROM {LINKS} GROUP BY page_id")
def parsed_links(spark, d):
    nodes = html.nodes(_read(spark, d, "pages"), "page_id", "html", tags=["a"], columns=["attrs"])
    return nodes.where("map_contains_key(attrs, 'href')").groupBy("page_id").agg(F.count("*").alias("n"))


# ---- addresses of scripts ----


#: A locator of each part, and its form in an address.
LOCATOR = "CASE p_partkey % 3 WHEN 0 THEN concat('a b', p_partkey) WHEN 1 THEN concat('@', p_partkey) ELSE concat('(é)!~*', p_partkey) END"
ENCODED = "CASE p_partkey % 3 WHEN 0 THEN concat('a%20b', p_partkey) WHEN 1 THEN concat('%40', p_partkey) ELSE concat('(%C3%A9)!~*', p_partkey) END"


@_query(f"SELECT {LOCATOR} AS locator, concat('file://d/', p_partkey, '.html.lectern-script.', {ENCODED}, '.mjs') AS url, concat('d/', p_partkey, '.html') AS path FROM part")
def locator_url(spark, d):
    rows = _made(spark, d, "part", f"{LOCATOR} AS locator", "concat('d/', p_partkey, '.html') AS at")
    url = t.synthetic_url("at", "locator")
    return rows.select("locator", url.alias("url"), t.real_path(url).alias("path"))


from lectern.plans import documents  # noqa: E402, F401  registers its queries
