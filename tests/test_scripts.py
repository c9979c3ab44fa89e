"""Script tokens, command tables, resolution of command lines, and the folder source."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import lexer, script
from lectern.operators import commands
from lectern.sources import datasource, files

#: Sources, and the block comments in them: what a slash means decides.
SLASHES = {
    'a++ / 2; /* c */ s = "x" / 1': ["/* c */"],
    "if (x) /[(]/.test(y)": [],
    "f(x) / 2 /* a */ / 3": ["/* a */"],
    "x = {} / 1; /* b */": ["/* b */"],
    "{} /[/*]/; /* d */": ["/* d */"],
    "x = function () {} / 1; /* e */ y = 2 / 1": ["/* e */"],
    'function f() {} /[/*]"/.test(a); /* f */': ["/* f */"],
    '`a${ b / 2 /* g */ + `c${d}` }e` / 2; /* h */ "x" / 1': ["/* g */", "/* h */"],
    'a ? {b: 1} / 2 : /x"/; /* i */': ["/* i */"],
    'x.return / 2; /* j */ "/"': ["/* j */"],
    'while (a) /"/.test(b); /* k */': ["/* k */"],
    'switch (a) { case 1: { b } /"/.x; default: /"/ } /* m */': ["/* m */"],
    'return /"/ /* n */': ["/* n */"],
    "a = b\n/* o */\n/c/g": ["/* o */"],
    'x => {} \n /"/.test(y) /* p */': ["/* p */"],
    'a!/2; /* q */ b != /"/': ["/* q */"],
    'class A { m() {} } /"/.x; /* r */': ["/* r */"],
    'x = class { m() { return 1 } } / 2; /* s */ "/"': ["/* s */"],
    'export default function () {} /"/ ; /* t */': ["/* t */"],
    'for await (x of y) /"/.test(x) /* u */': ["/* u */"],
    'a?.b / 1; c?.5:1 / 2; /* v */ "/"': ["/* v */"],
    'if (a) {} else /"/.x /* w */': ["/* w */"],
    'o = { m() { return /"/ }, n: /"/ } /* y */': ["/* y */"],
    "// one /* no */\n/* 1 */ a // two": ["/* 1 */"],
    "`${`${`/* no */`}`}` /* 2 */": ["/* 2 */"],
    "f(function () {} / 2) /* 3 */; '/'": ["/* 3 */"],
    "x = a[0] / /[/]/.y /* 4 */": ["/* 4 */"],
}


@pytest.mark.parametrize("source", SLASHES)
def test_slashes(source):
    found, wrong = lexer.scan(source)
    assert wrong is None and [t.text for t in found if t.text.startswith("/*")] == SLASHES[source]
    assert all(source[t.start : t.end] == t.text for t in found)
    assert "".join(source.split()) == "".join("".join(t.text for t in found).split())


def test_brackets():
    assert [script.trouble(x) for x in ("f(`${", "a)", "{[}", "({})", "`${a}`", None)] == ["{ is not closed", "unexpected ) at 1", "unexpected } at 2", None, None, None]


#: Sources, and their commands with comments.
TABLES = {
    "export const verbs = { add() {}, rm: { deep() {} } }": ["verbs add", "verbs rm deep"],
    "export { z }; /** Z. */ const z = () => 1": ["z/** Z. */"],
    "export const t: T = { /** A. */ async add(x, y) { return {a: 1, b: 2} }, 'b-c': function () {}, d: 5, e: [1], f, ...more, *gen() {}, [k]: 1, async: f, i: { j: { /** L. */ l: (a, b) => ({a, b}) } } } as const\nfunction f() {}\nconst more = { m: x => x }":
        ["t add/** A. */", "t b-c", "t f", "t m", "t gen", "t async", "t i j l/** L. */"],
    "export default { a() {} }": [],
    "export default run; /** R */ function run() {}": ["/** R */"],
    "/** D */ export default async function () {}": ["/** D */"],
    "export { a as b, default as c, type T } from './x.js'; export * from 'y'": ["b", "c"],
    "import w from 'w'; export { w }; export { w as default }": ["w", ""],
    "export async function* g() {} export function h<T>(a: T): Promise<{x: T}> { } export type X = { y: 1 }; export interface I { m(): void } export class K { n() {} }": ["g", "h"],
    "export const loop = { a: loop, b: other }; const other = { c: loop, d: () => 1 }": ["loop b d"],
    "const x = { export: 1 }; export const y = { delete() {}, return: () => 1 }": ["y delete", "y return"],
    "export const t = {a(){}} as const\nexport const q = 3, r = () => 2, s = t": ["t a", "r", "s a"],
    "export const a = b\nexport function c() {}": ["a", "c"],
    "export const t = { a: () => 1, /** Later. */ a() {} }": ["t a/** Later. */"],
}


@pytest.mark.parametrize("source", TABLES)
def test_command_tables(source):
    assert [" ".join(c["path"]) + c["raw"] for c in script.commands(source)] == TABLES[source]


def test_sources_that_break_off():
    whole = max(TABLES, key=len)
    assert all(isinstance(script.commands(whole[:i]), list) for i in range(len(whole)))
    assert script.commands(None) == []
    assert len(script.commands("export const t = {" + "a: {" * 3000 + "b() {}" + "}" * 3001)) == 1


def test_resolution_by_the_longest_beginning(spark):
    known = spark.createDataFrame([("h", 0, ["a"]), ("h", 1, ["t", "b", "c"]), ("h", 2, ["t", "d"]), ("g", 0, [])], "id string, ord int, path array<string>")
    hosts = spark.createDataFrame([("h",), ("g",), ("bare",)], "id string")
    lines = {
        ("no", "a"): (1, "unknown-host", "", ["a"]), ("bare", "a"): (1, "no-commands", "", ["a"]), ("h",): (1, "help", "", []), ("h", "-h"): (0, "help", "", ["-h"]), ("h", "--x", "a"): (1, "help", "", []),
        ("h", "a", "t"): (0, "run", "a", ["t"]), ("h", "x"): (1, "unknown-command", "", ["x"]), ("h", "t"): (1, "needs-verb", "t", []), ("h", "t", "--f", "d", "d", "e"): (0, "run", "t d", ["e"]),
        ("h", "t", "b"): (1, "needs-verb", "t b", []), ("h", "t", "b", "d"): (1, "unknown-verb", "t b", ["d"]), ("h", "t", "b", "c", "--g"): (0, "run", "t b c", []),
        ("g",): (0, "run", "", []), ("g", "--v", "w", "z"): (0, "run", "", ["z"]), ("g", "--help"): (0, "help", "", []), ("g", "z"): (1, "unknown-command", "", ["z"]),
    }
    asked = spark.createDataFrame([(i, x[0], list(x[1:])) for i, x in enumerate(lines)], "request int, id string, argv array<string>")
    rows = {r.request: r for r in commands.resolve(asked, hosts, known).collect()}
    assert [(rows[i].status, rows[i].outcome, rows[i].label, rows[i].rest) for i in range(len(lines))] == list(lines.values())
    assert {tuple(r.takes) for r in rows.values() if r.outcome == "needs-verb"} == {("b", "d"), ("c",)}


def test_folder_source(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    datasource.register(spark)
    made = spark.range(40).selectExpr("concat('f', id % 4, '/g/', id, '.html') AS path", "concat('<p>', id) AS content")
    made.write.format("lectern").mode("append").save(root)
    rows = files.files(spark, root)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, made.collect()))
    assert not [p for p in (tmp_path / "c").iterdir() if p.name.startswith(".")]
    some = rows.where("path like 'f1/%'")
    assert some.count() == 10 and some.rdd.getNumPartitions() == 2  # the root itself, and f1
    (tmp_path / "c" / "f2" / "broken.html").write_bytes(b"\xff")  # can't be decoded: only read where it is asked for
    assert rows.where("path in ('f1/g/1.html', 'f3/g/3.html', 'none/x.html')").count() == 2
    with pytest.raises(Exception, match="decode"):
        rows.count()


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    datasource.register(spark)

    @F.udf("string")
    def text(i):
        if i == 39:
            raise ValueError("no")
        return "x"

    bad = spark.range(40).select(F.concat(F.lit("h/"), "id").alias("path"), text("id").alias("content"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("lectern").mode("append").save(root)
    assert not (tmp_path / "c" / "h").exists() and files.walk(root) == []
    spark.createDataFrame([("a.html", "1"), ("b.html", "2")], "path string, content string").write.format("lectern").mode("append").save(root)
    changes = [("a.html", None, "deleted"), ("b.html", "3", "wrote"), ("d/e.html", "4", "wrote")]
    spark.createDataFrame(changes, "path string, content string, action string").write.format("lectern").mode("append").save(root)
    assert sorted(map(tuple, files.files(spark, root).collect())) == [("b.html", "3"), ("d/e.html", "4")]


def test_public_names_load_when_asked_for():
    import subprocess
    import sys

    code = "import sys, lectern; assert 'pandas' not in sys.modules; [getattr(lectern, n) for n in lectern.__all__]; from lectern import NodeStore, corpus; print(len(lectern.__all__))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 20
    with pytest.raises(AttributeError):
        import lectern

        lectern.nothing  # noqa: B018


def test_virtual_files(spark):
    from lectern.operators import rewrite

    blocks = [("p", 0, "node/command", "a", "import x from '#b'; import y from '#none'"), ("p", 1, "module", "b", "1"), ("p", 2, "node/importmap", "", "{}")]
    df = spark.createDataFrame([(*b, "p.html") for b in blocks], "path string, idx int, type string, id string, source string, base string")
    got = {r.name: r.text for r in rewrite.virtual_files(df, "path", "base").collect()}
    assert got == {"p.html.0.ts": "import x from './p.html.1.js'; import y from '#none'", "p.html.1.js": "1", "p.html.2.ts": ""}
