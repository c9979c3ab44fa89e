"""A corpus of documents made from the driver's tables: what the queries over documents run on.

Each expression is SQL that Spark and the oracle read alike, so both see the same documents: one for every customer
(with faults by the customer's number), nation and supplier, and the templates, commands and audits that they name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "https://s.example/"


def joined(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def lit(text: str) -> str:
    return "'" + text + "'"


def when(divisor: int, then: str, otherwise: str = "''") -> str:
    return f"CASE WHEN c_custkey % {divisor} = 0 THEN {then} ELSE {otherwise} END"


#: What a customer's document says it conforms to: now and then a type, a template or a file that isn't there.
REF = "CASE WHEN c_custkey % 17 = 0 THEN '../templates/customer.template.html#gone' WHEN c_custkey % 19 = 0 THEN '../templates/customer.template.html' WHEN c_custkey % 29 = 0 THEN '../templates/missing.template.html#customer-doc' WHEN c_custkey % 31 = 0 THEN '#customer-doc' ELSE '../templates/customer.template.html#customer-doc' END"
BALANCE = "CAST(floor(c_acctbal) AS BIGINT)"


def customer(line: str = "''", repoint: bool = False) -> str:
    """A customer's document. line: the break before a child, at the depth marked by how often it is repeated;
    repoint: links to all but nations lead to the site."""
    nl = lambda n: f"CASE WHEN {line} = '' THEN '' ELSE concat({line}, '{'  ' * n}') END"
    child = lambda text: joined(nl(1), text)
    name = child("'<customer-name>', c_name, '</customer-name>'")
    nation = lambda folder: joined(f"'<customer-nation href=\"{folder}'", "c_nationkey", "'.html\">n</customer-nation>'")
    wrong = nation(SITE + "nation/" if repoint else "../nation/")
    return joined(
        f"'<html><head><title>', c_name, '</title><link rel=\"stylesheet\" href=\"{SITE if repoint else '../'}theme.css\"></head><body>'",
        f"'<customer-doc data-conforms-to=\"', {REF}, '\">'",
        when(23, "''", name), when(13, name), child("'<customer-segment>', c_mktsegment, '</customer-segment>'"),
        when(5, child("'<customer-note> </customer-note>'")), when(7, child("'<customer-extra>x</customer-extra>'")),
        nl(1), when(11, wrong, nation("../nations/")), when(3, joined(child("'<customer-tag>a</customer-tag>'"), child("'<customer-tag>b</customer-tag>'"))),
        nl(1), "'<account-doc data-conforms-to=\"../templates/account.template.html#account-doc\">'", nl(2), f"'<account-balance>', {BALANCE}, '</account-balance>'", nl(1), "'</account-doc>'",
        nl(0), "'</customer-doc>'", when(37, "'stray words'"), "'<a href=\"../nations/', c_nationkey, '.html#top\"></a>'",
        when(41, f"'<a href=\"{SITE + 'customers/' if repoint else ''}gone.html\"></a>'"), "'</body></html>'",
    )


CUSTOMER_PATH = "concat('customers/', c_custkey, '.html')"
DOCTYPE = "'<!DOCTYPE html>'"

#: A supplier's scripts: a command, a module that it imports, and an import map.
COMMAND = joined("'/** Sells ', s_name, '. More to say.'", "chr(10)", "' * @x'", "chr(10)", "' */'", "chr(10)", "'export function sell', s_suppkey, '() {}'", "chr(10)", "'import a from \"./lib', s_suppkey % 7, '.js\"'", "chr(10)", "'import b from \"#other\"'", "chr(10)", "'const f = \"supplier.css\" /* no comment of its own */'", "chr(10)",
                 "'/** Stock. */ export const stock', s_suppkey, ' = { /** Adds to it. */ add() { return f.length / 2 }, rm: { /** Takes from it. */ \"all-of-it\": (x) => { if (x) /[}]/.test(x) }, none: 0 }, restock } as const'", "chr(10)",
                 "'/** Fills it. */ function restock() { return `$'", "'{f} / $'", "'{{ a: 1 / 2 }.a}` } export { restock as refill }'")
IMPORTMAP = joined("'{\"imports\": {\"pkg', s_suppkey % 5, '\": \"1.', s_suppkey, '\"}}'")
SUPPLIER = joined("'<html><head></head><body><script type=\"node/command\" id=\"s', s_suppkey, '\">'", COMMAND, "'</script><script type = \"module\" id=\"other\">export const o = 1</script><script type=\"node/importmap\">'", IMPORTMAP, "'</script></body></html>'")
SUPPLIER_PATH = "concat('suppliers/', s_suppkey, '.html')"

NATION = joined("'<html><head></head><body><nation-doc data-conforms-to=\"../templates/nation.template.html#nation-doc\"><nation-name>', n_name, '</nation-name></nation-doc><script src=\"../lib/nation.js#x\"></script><script>import \"./local.js\"; const page = \"<link rel=stylesheet href=theme.css><script src=inner.js></\" + \"script>\"; const other = \"root.html\"</script></body></html>'")
NATION_PATH = "concat('nations/', n_nationkey, '.html')"

HOST = '<template-host data-conforms-to="template.template.html#template-host"><template-purpose>{}</template-purpose></template-host>'
FILES = {
    "theme.css": "",
    "inner.js": "",
    "lib/nation.js": "",
    "nations/local.js": "",
    "root.html": "<p></p>",
    "templates/customer.css": "",
    "templates/template.template.html": "<html><head></head><body>" + HOST.format("What types are.") + '<template id="template-host"><template-purpose required></template-purpose></template></body></html>',
    "templates/customer.template.html": '<html><head><link rel="stylesheet" href="customer.css"></head><body>' + HOST.format("People   who order.")
    + '<template id="customer-doc"><customer-name required pattern="^Customer#[0-9]+$"></customer-name><customer-segment required enum="BUILDING AUTOMOBILE MACHINERY"></customer-segment><customer-note></customer-note>'
    '<customer-nation href="^[.][.]/nations/[0-9]+[.]html$"></customer-nation><customer-tag repeatable></customer-tag></template>'
    '<script type="node/command">/** Lists customers. All of them. */ export function list() {} /** Adds one. */ export const enroll = () => /[(]/</script></body></html>',
    "templates/account.template.html": '<html><head></head><body><template id="account-doc"><account-balance required pattern="^-?[0-9]+$"></account-balance></template><script data-validates="#account-doc">export default check</script></body></html>',
    "templates/nation.template.html": '<html><head></head><body><template id="nation-doc"><nation-name required></nation-name></template><script data-validates="#nation-doc">export default check</script></body></html>',
    "commands/list.command.html": '<html><head></head><body><script type="node/command">/** Lists all. */ export default function () {}</script></body></html>',
    "commands/customer.command.html": "<html><head></head><body></body></html>",
    "commands/broken.command.html": '<html><head></head><body><script type="node/command">export function x() { (</script></body></html>',
    "canon/root.canon.html": "<html><head></head><body><canon-axiom><canon-title> Documents say what they are. </canon-title></canon-axiom></body></html>",
    "audits/all.html": '<html><head></head><body><script type="node/audit" data-audits="every-link-resolves" data-touches="customer-* nation-doc" data-expects="customers/41.html customers/none.html">import x from "y"; /* Every link points at a file. */</script>'
    '<script type="node/audit" data-audits="unwritten"></script></body></html>',
}


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, content of all documents and files."""
    table = lambda name, path, content: spark.read.parquet(f"{d}/{name}.parquet").select(F.expr(path).alias("path"), F.expr(joined(DOCTYPE, content)).alias("content"))
    fixed = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return table("customer", CUSTOMER_PATH, customer()).union(table("supplier", SUPPLIER_PATH, SUPPLIER)).union(table("nation", NATION_PATH, NATION)).union(fixed)


def values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL of the oracle."""
    quoted = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows) + f") v({columns})"


FILES_SQL = (
    f"(SELECT {CUSTOMER_PATH} AS path, {joined(DOCTYPE, customer())} AS content FROM customer UNION ALL SELECT {SUPPLIER_PATH}, {joined(DOCTYPE, SUPPLIER)} FROM supplier "
    f"UNION ALL SELECT {NATION_PATH}, {joined(DOCTYPE, NATION)} FROM nation UNION ALL SELECT path, content FROM {values(list(FILES.items()), 'path, content')})"
)
