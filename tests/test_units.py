import posixpath
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern import cli, registry, session
from lectern.functions import script
from lectern.functions import text as t
from lectern.operators import corpus, graph, overlay, references, roster, validate
from lectern.operators import selectors as sel
from lectern.sources import files, html
from lectern.streaming.incremental import latest, revalidate


def tags(rows):
    return [(r[5], r[3]) for r in rows if r[4] == "element"]


def test_tree_rules():
    assert tags(html.parse("<ul><li>a<li>b</ul><p>x<p>y<br>z")) == [("ul", 0), ("li", 1), ("li", 1), ("p", 0), ("p", 0), ("br", 1)]
    rows = html.parse('<template id="T"><a href="x"></a></template><pre>\n\n</pre><script>"</p>"</script>')
    assert [r[9] for r in rows if r[5] == "a"] == [0]
    assert [r[10] for r in rows if r[7] == "\n\n"] == [True]
    assert [r[7] for r in rows if r[7] and "</p>" in r[7]] == ['"</p>"']
    assert html.parse(None) == [] and html.parse("") == []


def test_spans_cover_their_source():
    source = '<div><p class="é">a</p></div>'
    p = next(r for r in html.parse(source) if r[5] == "p")
    assert source[p[11] : p[12]] == '<p class="é">a</p>'


def test_nodes_keep_the_key(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "x"), (2, None, "y")], "id long, h string, node_id string")
    assert [(r.id, r.kind) for r in html.nodes(df, "id", "h").orderBy("node_id").collect()] == [(1, "element"), (1, "text")]


def test_rel_href_and_normalize_are_inverse(spark):
    pairs = [("a/b.html", "c/d/e.html"), ("x.html", "y.html"), ("a/b/c.html", "a/b/c.html"), ("a/b.html", "a/b/c.html")]
    df = spark.createDataFrame(pairs, "a string, b string").select("b", t.resolve("a", t.rel_href("a", "b")).alias("back"))
    assert all(r.b == r.back for r in df.collect())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "..", ".", "b", ""]), min_size=1, max_size=6).map("/".join), min_size=1, max_size=8))
def test_normalize_like_posix(spark, paths):
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", t.path_normalize("p").alias("n")).collect()
    for r in got:
        want = posixpath.normpath(r.p) if r.p else "."
        assert r.n == ("/" + want.lstrip("/") if want.startswith("/") else want)


def test_first_sentence(spark):
    cases = {"A b. C": "A b.", "v1.2 is out": "v1.2 is out", "\nx": "", "a\nb\n\nc": "a b", "x" * 80: "x" * 75 + "…", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", t.first_sentence("s").alias("o"))
    assert {r.s: r.o for r in df.collect()} == cases


def test_walk(tmp_path):
    for p in (".x/a.html", "node_modules/b.html", "_u.html", "build/z.html", "n/c.html", "n/d.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("")
    (tmp_path / ".gitignore").write_text("build/\n")
    (tmp_path / "n" / "again").symlink_to(tmp_path)
    assert [p.removeprefix(f"{tmp_path}/") for p in files.walk(str(tmp_path), ".html")] == ["_u.html", "n/c.html"]
    assert files.walk(str(tmp_path / "absent")) == []


IGNORE = [
    (["*.log", "!keep.log"], {"a.log": True, "keep.log": False, "x/keep.log": False, "a.txt": False}),
    (["/build"], {"build": True, "build/a": True, "x/build": False}),
    (["build/"], {"build": False, "build/a": True, "x/build/a": True}),
    (["a/*.txt"], {"a/b.txt": True, "a/b/c.txt": False, "x/a/b.txt": False}),
    (["**/tmp"], {"tmp": True, "x/y/tmp": True, "x/y/tmp/a": True}),
    (["a/**/z"], {"a/z": True, "a/b/c/z": True, "z": False}),
    (["a/**"], {"a": False, "a/b": True, "a/b/c": True}),
    (["f[0-9].html", "g[!a]"], {"f3.html": True, "fx.html": False, "gb": True, "ga": False}),
    (["\\#x", "\\!y", "# note", "", "t ", "s\\ "], {"#x": True, "!y": True, "t": True, "s ": True, "note": False}),
    (["dir/", "!dir/keep"], {"dir/keep": True}),
    (["*", "!x", "x/*", "!x/y"], {"a": True, "x/y": False, "x/z": True}),
    (["A.HTML"], {"a.html": True}),
    ([], {"a": False}),
]


def test_ignore_rules(spark):
    for lines, want in IGNORE:
        rules = files.ignore_rules(lines)
        assert {p: files.is_ignored(p, rules) for p in want} == want, lines
        got = spark.createDataFrame([(p,) for p in want], "p string").select("p", files.ignored("p", lines).alias("i")).collect()
        assert {r.p: r.i for r in got} == want, lines


def test_whole_documents():
    assert tags(html.parse("<title>t</title><p>a", whole=True)) == [("html", 0), ("head", 1), ("title", 2), ("body", 1), ("p", 2)]
    assert tags(html.parse("\n<html lang=x>\n<head></head>\n<body class=c><p>a</body></html>\n<i>b</i>", whole=True)) == [("html", 0), ("head", 1), ("body", 1), ("p", 2), ("i", 3)]
    rows = html.parse("<html lang=x><body class=c>a</body></html>", whole=True)
    assert [(r[5], r[6]) for r in rows if r[4] == "element"] == [("html", {"lang": "x"}), ("head", {}), ("body", {"class": "c"})]
    assert tags(html.parse("a", whole=True)) == [("html", 0), ("head", 1), ("body", 1)] and html.parse("", whole=True) == []
    assert [r[13] for r in html.parse('<x-a data-conforms-to="t"><b>1</b></x-a><i></i>') if r[4] == "element"] == [None, 0, None]


SOURCE = "/** Lists. More.\n * @x\n */\nexport function list() {}\nimport a from './a.js'\nimport './b.js'; const s = \"/* no */\"\nexport { q } from './c.js'"


def test_scripts():
    other = "// no\nexport default async function () { import('./d.js') }\n/* Adds. */ export const add = () => 1"
    assert [i["spec"] for i in script.imports(SOURCE)] == ["./a.js", "./b.js"] and script.imports(other) == [] == script.imports(None)
    assert [(c["path"], c["raw"][:8]) for c in script.commands(SOURCE)] == [(["list"], "/** List"), (["q"], "")]
    assert [(c["path"], c["raw"]) for c in script.commands(other)] == [([], ""), (["add"], "/* Adds. */")]
    assert [c["raw"] for c in script.comments('x = /[/*]"/; y = a / b; /* one */ "/* two */" `/* three */`')] == ["/* one */"]
    assert script.literals(r"""'a\'b' "c\x41\u{42}" `d` `e${f}` = /'g'/""") == ["a'b", "cAB", "d"]
    assert script.trouble("f(/[(]/, '(')") is None and script.trouble("f(") == "( is not closed" and script.trouble("f)") == "unexpected ) at 1"
    assert [(h["quote"], h["locator"]) for h in script.hash_imports("import x from '#a'; import(\"#b\"); import '#c'; f('#d')")] == [("'", "a"), ('"', "b"), ("'", "c")]
    found = script.blocks('<script type = "x" data-id="y" id="z">1</script><SCRIPT>2</SCRIPT><script src=a></script><script grid="z">3</script>')
    assert [(b["type"], b["id"], b["source"]) for b in found] == [("x", "y", "1"), ("", "", ""), ("", "", "3")]


def refs_of(spark, source):
    nodes = corpus.nodes(spark.createDataFrame([("a.html", source)], "path string, content string"))
    return sorted(r.ref for r in references.references(spark, nodes).collect())


def test_references(spark):
    inner = r"""<link rel=stylesheet href=in.css><script src="in.js"><\/script>"""
    source = f"""<link rel="stylesheet" href="a.css"><link rel="icon" href="b.ico"><a href="c.html">c</a><img src="d.png"><p data-conforms-to="t.html#x"></p>
      <template><link rel="stylesheet" href="no.css"></template><script src="e.js"></script><script>import f from "./f.js"; const g = ['g.css', './h.css', "i.html", 'j', `{inner}`]</script>"""
    want = ["a.css", "t.html#x", "e.js", "./f.js", "g.css", "i.html", "in.css", "in.js"]
    assert refs_of(spark, source) == sorted(want)
    assert refs_of(spark, None) == []
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("</", "<\\/") + "'"
    markup = "<link rel=stylesheet href=end.css>"
    for i in range(4):
        markup = f"<script src=l{i}.js></script><script>x = {quoted(markup)}</script>"
    assert refs_of(spark, markup) == ["end.css", "l0.js", "l1.js", "l2.js", "l3.js"]


def tree_nodes(spark, sizes):
    """Nodes of random trees: path, node_id, last_id, tag."""
    rng, rows = random.Random(3), []
    for p, n in enumerate(sizes):
        depth, up = [0], []
        for _ in range(1, n):
            depth.append(rng.randint(1, depth[-1] + 1))
        last = list(range(n))
        for i in range(n):
            while up and depth[up[-1]] >= depth[i]:
                up.pop()
            up.append(i)
            for x in up:
                last[x] = i
        rows += [(f"p{p}", i, last[i], rng.choice("abcde"), "element") for i in range(n)]
    return rows, spark.createDataFrame(rows, "path string, node_id int, last_id int, tag string, kind string")


def test_first_descendants_like_a_search(spark):
    rows, nodes = tree_nodes(spark, [1, 40, 90])
    got = {(r.path, r.node_id): r.found for r in sel.first_descendant(nodes, nodes.select("path", "node_id", "last_id"), "B").collect()}
    assert got == {(p, i): next((n for q, n, _, t, _ in rows if q == p and t == "b" and i < n <= last), None) for p, i, last, _, _ in rows}


def test_first_descendants_of_one_large_document(spark):
    nodes = spark.range(100_000).selectExpr("'p' AS path", "cast(id AS int) AS node_id", "99999 AS last_id", "if(id % 1000 = 7, 'b', 'a') AS tag", "'element' AS kind")
    found = sel.first_descendant(nodes, nodes.select("path", "node_id", "last_id"), "b")
    assert found.where("found > node_id").count() == 99_007 and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_elements_by_id(spark):
    source = '<p id="x">1</p><script id="x">2</script><template><i id="y"></i></template><b id="">3</b><script id="y">4</script>'
    nodes = corpus.nodes(spark.createDataFrame([("a.html", source)], "path string, content string"))
    assert sorted((r.id, r.tag) for r in sel.by_id(nodes).collect()) == [("x", "p"), ("y", "script")]


def test_resolution_and_closure(spark):
    rows = [("d/a.html", '<p data-conforms-to="t.html#x"></p><script src="../up.js"></script><script src="root.js"></script><script src="none.js"></script><script src="/up.js"></script><link rel=stylesheet href="#y">'), ("d/t.html", '<script src="a.html"></script>'), ("up.js", ""), ("root.js", ""), ("z.html", ""), ("theme.css", "")]
    df = spark.createDataFrame(rows, "path string, content string")
    edges = {tuple(r) for r in references.local_references(df).collect()}
    assert edges == {("d/a.html", "d/t.html"), ("d/a.html", "up.js"), ("d/a.html", "root.js"), ("d/t.html", "d/a.html")}
    assert [r.path for r in references.seed_paths(spark, df, [], folders=("d",)).collect()] == ["d/a.html", "d/t.html", "root.js", "theme.css", "up.js"]


def test_depths_like_containment(spark):
    source = '<x-a data-conforms-to="t"><b><x-b data-conforms-to="t"><x-c data-conforms-to="t"></x-c></x-b></b><x-d data-conforms-to="t"></x-d></x-a><x-e data-conforms-to="t"></x-e>'
    df = spark.createDataFrame([("p.html", source)], "path string, content string")
    got = {r.tag: r.depth for r in corpus.instances(corpus.nodes(df)).collect()}
    assert got == {"x-a": 0, "x-b": 1, "x-c": 2, "x-d": 1, "x-e": 0}


def outcome(spark, files_, checks=None, generic=True):
    df = spark.createDataFrame(list(files_.items()), "path string, content string")
    return {r.path: (r.ok, r.errors) for r in corpus.verdicts(df, corpus.nodes(df), checks, generic).collect()}


def test_every_outcome_of_a_verdict(spark):
    doc = lambda ref, inner="<t-a>1</t-a>": f'<x-d data-conforms-to="{ref}">{inner}</x-d>'
    template = '<template id="T"><t-a required pattern="^[0-9]"></t-a><t-b enum="x y" repeatable></t-b><t-c pattern="("></t-c></template>'
    own = template + '<script data-validates="#T"></script>'
    base = {"t.html": template, "own.html": own}
    docs = {"ok.html": doc("t.html#T"), "empty.html": doc(""), "nofile.html": doc("u.html#T"), "hash.html": doc("#T"), "notype.html": doc("t.html#U"), "nofrag.html": doc("t.html"), "second.html": doc("t.html#T#U"),
            "bad.html": doc("t.html#T", "<t-a>z</t-a><t-a> </t-a><t-b>x</t-b><t-b>z</t-b><t-q>1</t-q><t-c>(</t-c><x-d data-conforms-to='t.html'></x-d>"), "lacks.html": doc("t.html#T", ""), "own1.html": doc("own.html#T")}
    got = outcome(spark, base | docs | {"bad.html": docs["bad.html"].replace("<x-d data-conforms-to='t.html'></x-d>", "")})
    setup = corpus.SETUP
    assert got == {
        "ok.html": (True, []), "second.html": (True, []), "empty.html": (False, ["missing data-conforms-to attribute"]), "nofile.html": (False, [setup + "no such file u.html"]), "hash.html": (False, [setup + "no such file ."]),
        "notype.html": (False, ["no template found at t.html#U"]), "nofrag.html": (False, ["no template found at t.html#undefined"]),
        "bad.html": (False, ["t-a: empty", "t-a: pattern", "t-a: pattern", "t-a: repeated", "t-b: enum", "t-q: undeclared"]), "lacks.html": (False, ["t-a: required"]), "own1.html": (False, [setup + "no check for own.html#T"]),
    }
    only = base | {"own1.html": docs["own1.html"], "lacks1.html": doc("own.html#T", ""), "ok.html": docs["ok.html"]}

    def raises(instance):
        raise ValueError("broken")

    for check, want in ((lambda i: [], (True, [])), (lambda i: ["a"], (False, ["a"])), (lambda i: {"ok": False, "violations": ["v"]}, (False, ["v"])), (lambda i: {"ok": False}, (False, [])), (raises, (False, [setup + "broken"]))):
        got = outcome(spark, only, {("own.html", "T"): check})
        assert got["own1.html"] == want
        assert got["lacks1.html"] == (want if check is raises else (False, ["t-a: required", *want[1]]))
        got = outcome(spark, only, {("own.html", "T"): check}, generic=False)
        assert got["own1.html"] == got["lacks1.html"] == want and got["ok.html"] == (False, ["no generic validator available and no data-validates script for t.html#T"])
    assert outcome(spark, {"t.html": template}) == {}


def test_verdicts_of_no_files(spark):
    none = spark.createDataFrame([], "path string, content string")
    verdicts, found, report = registry.whole(spark, none, registry.Registry())
    assert verdicts.count() == found.count() == 0 and tuple(report.first()) == (0, 0, True, [])


def test_pattern_that_is_none(spark):
    df = spark.createDataFrame([("t.html", '<template id="T"><t-a pattern="("></t-a></template>')], "path string, content string")
    assert [(r.pattern, r.bad_pattern) for r in corpus.fields(corpus.nodes(df)).collect()] == [(None, "(")]


def test_selectors(spark):
    source = '<canon-axiom><canon-title>a</canon-title><i><canon-title>b</canon-title></i></canon-axiom><template id="x"><canon-axiom><canon-title>c</canon-title></canon-axiom></template><template id=""></template><TABLE></TABLE>'
    n = corpus.nodes(spark.createDataFrame([("p.htm", source), ("p.txt", source)], "path string, content string")).cache()
    assert [r.content for r in sel.children(n, "canon-axiom", "canon-title").collect()] == ["a"]
    assert n.where(sel.template_with_id()).count() == 1
    body = n.where("tag = 'body'").select("path", "node_id", "last_id")
    (row,) = sel.first_descendant(n, body, "Canon-Title").collect()
    assert row.path == "p.htm" and n.where(f"node_id = {row.found}").first().content == "a"
    assert sel.first_descendant(n, body, "BODY").first().found is None


def test_roster_without_anything(spark):
    none = spark.createDataFrame([], "path string, content string")
    lines = [r.line for r in roster.roster(spark, none, corpus.nodes(none)).collect()]
    assert lines[0] == "lectern: documents, and what they may say." and len(lines) == 5
    assert roster.audit_lines(corpus.nodes(none)).count() == 0


HOST = '<html><head></head><body><script type="node/command">/** Greets. */ export function greet() {} export const more = { /** Removes. */ rm() {}, deep: { er: greet } }MORE</script></body></html>'


def test_commands_in_a_sandbox(spark, tmp_path):
    known = registry.Registry()
    box = session.Sandbox(spark, str(tmp_path / "corpus"), known)
    assert box.run("x") == {"ok": False, "status": 1, "stdout": "", "stderr": f"There is no corpus at {box.dir}."}
    assert box.run()["ok"] and "no corpus" in box.run()["stdout"]
    box.write("c/hello.command.html", HOST.replace("MORE", ""))
    box.write("bare.template.html", '<template id="T"><t-a required></t-a></template>')
    box.write("odd.command.html", '<script type="node/command">export function x() { (</script>')
    box.write("notes/one.html", '<html><head></head><body><x-d data-conforms-to="../bare.template.html#T">\n  <t-a>1</t-a>\n</x-d></body></html>')

    def greet(ctx):
        assert ctx.cli.href("a/b.html", "a/c.html") == "./c.html" and ctx.cli.href("a/b.html", "c.html") == "../c.html"
        doc = ctx.fs.get("notes/one.html")
        if "name" in ctx.args:
            doc.html = doc.html.replace("<t-a>1", f"<t-a>{ctx.args['name']}")
            ctx.fs.create("notes/new.html", "<p>new</p>")
            assert ctx.fs.exists("notes/new.html") and "notes/new.html" not in ctx.fs.list("notes")
            assert ctx.cli.validate(doc.html, "notes/one.html") == {"ok": True, "errors": []}
            assert ctx.cli.validate(doc.html.replace("t-a", "t-b"), "notes/one.html")["errors"] == ["t-a: required", "t-b: undeclared"]
            assert ctx.cli.validate("<p></p>", "notes/one.html")["errors"] == ["missing data-conforms-to attribute"]
        if "fail" in ctx.args:
            raise ValueError("no")

    def remove(ctx):
        ctx.fs.delete("notes/new.html")
        assert not ctx.fs.exists("notes/new.html") and list(ctx.fs.list("notes")) == ["notes/one.html"] and ctx.args["_"] == ["now"]
        with pytest.raises(FileNotFoundError, match="notes/new.html was already deleted"):
            ctx.fs.get("notes/new.html")
        with pytest.raises(FileNotFoundError):
            ctx.fs.get("notes/none.html")

    def extend(ctx):
        for doc in ctx.fs.list().values():
            doc.html = doc.html.replace("</t-a>\n</x-d>", "</t-a><t-b>2</t-b></x-d>")
        ctx.fs.create("made.html", '<x-d data-conforms-to="t"><t-a>1</t-a></x-d>')

    known.module("c/hello.command.html", "@0", greet=greet, more={"rm": remove, "deep": {"er": extend}})
    before = box.read("notes/one.html")
    assert box.run("none")["stderr"] == "none is no command host of this corpus" and box.run("none")["status"] == 1
    assert box.run("bare")["stderr"] == "bare.template.html declares no command that can be run"
    assert box.run("odd", "x")["stderr"] == "odd.command.html can't be read: ( is not closed" and not box.run("odd")["ok"]
    assert box.run("hello")["status"] == 1 and box.run("hello")["stderr"].startswith("hello has, in c/hello.command.html:")
    told = box.run("hello", "--help")
    assert "Greets." in told["stdout"] and "  more deep er" in told["stdout"] and box.run("hello", "-h")["ok"]
    assert box.run("hello", "x")["stderr"].startswith("c/hello.command.html declares no command x\nhello has")
    assert box.run("hello", "greet") == {"ok": True, "status": 0, "stdout": "", "stderr": ""} and box.read("notes/one.html") == before
    assert box.run("hello", "greet", "--name", "q", "--fail")["stderr"] == "no" and box.read("notes/one.html") == before
    assert box.run("hello", "greet", "--name", "q")["stdout"] == "wrote notes/new.html\nwrote notes/one.html"
    assert box.read("notes/one.html").startswith("<!DOCTYPE html>\n<html>") and "<t-a>q</t-a>" in box.read("notes/one.html") and box.exists("notes/new.html")
    assert box.run("hello", "more")["stderr"] == "hello more wants one of these verbs: rm, deep" and box.run("hello", "more", "z", "rm")["stderr"] == "hello more knows no verb z, only these: rm, deep"
    assert box.run("hello", "more", "rm", "now") == {"ok": True, "status": 0, "stdout": "deleted notes/new.html", "stderr": ""} and not box.exists("notes/new.html")
    known.module("c/hello.command.html", "@0")
    assert box.run("hello", "greet")["stderr"] == "no function is registered for c/hello.command.html#@0 greet"
    box.write("c/hello.command.html", HOST.replace("MORE", " export default greet"))
    known.module("c/hello.command.html", "@0", default=greet)
    assert box.run("hello", "--name", "r")["stdout"] == "wrote notes/new.html"  # the other is as it was
    known.module("c/hello.command.html", "@0", more={"deep": {"er": extend}})
    assert box.run("hello", "more", "deep", "er")["stdout"] == "wrote made.html\nwrote notes/one.html"
    assert box.read("notes/one.html").endswith("<t-a>q</t-a>\n  <t-b>2</t-b>\n</x-d></body></html>\n")  # laid out when it is written
    assert "\n  <t-a>1</t-a>\n</x-d>" in box.read("made.html")
    lines = box.run()["stdout"].split("\n")
    assert "hello  no docs  (c/hello.command.html)" in lines and "  greet         Greets." in lines and "  more rm       Removes." in lines and "bare  1 docs  (bare.template.html)" in lines
    assert "  (unreadable: ( is not closed)" in lines


def test_seed(spark, tmp_path):
    store = session.Sandbox(spark, str(tmp_path / "from"))
    store.write("theme.css", "x")
    store.write("commands/a.command.html", '<script type="node/importmap">{"imports": {"p": "1", "q": "2"}}</script><a href="gone.html">g</a><link rel="stylesheet" href="../theme.css">')
    store.write("other.html", "")
    lines = []
    assert cli.seed(spark, store.dir, str(tmp_path / "to"), [], "https://s.example/", lines.append)
    to = session.Sandbox(spark, str(tmp_path / "to"))
    assert lines == ["wrote commands/a.command.html", "wrote theme.css", "needs: p@1 q@2"] and not to.exists("other.html")
    assert 'href="https://s.example/commands/gone.html"' in to.read("commands/a.command.html") and 'href="../theme.css"' in to.read("commands/a.command.html")
    assert not cli.seed(spark, store.dir, str(tmp_path / "to"), [], "", lines.append)


def test_last_change_of_a_path_counts(spark):
    store = spark.createDataFrame([("a", "1")], "path string, content string")
    changes = spark.createDataFrame([("a", "put", "2", "1", 0), ("a", "delete", None, "1", 1), ("a", "put", "3", "", 2)], "path string, op string, content string, original string, seq int")
    assert [tuple(r) for r in overlay.read(store, changes).collect()] == [("a", "3")] and overlay.listing(store, changes).count() == 1


ARGS = {
    ("--a",): ([], {"a": ["true"]}), ("--a", "b"): ([], {"a": ["b"]}), ("--a", "--b"): ([], {"a": ["true"], "b": ["true"]}), ("--a", "x", "--a", "y"): ([], {"a": ["x", "y"]}), ("-h",): (["-h"], {}),
    ("--k=v",): ([], {"k=v": ["true"]}), ("--_", "v", "w"): (["v", "w"], {}), ("p", "-5", "--"): (["p", "-5"], {"": ["true"]}), (): ([], {}),
}


def test_arguments(spark):
    rows = spark.createDataFrame([(list(x),) for x in ARGS], "argv array<string>").select("argv", t.parse_args("argv").alias("a")).collect()
    assert {tuple(r.argv): (r.a.pos, {f.k: f.v for f in r.a.flags}) for r in rows} == ARGS
    row = Row(rest=["p"], flags=[Row(k="a", v=["x"]), Row(k="b", v=["y", "z"])])
    assert session.arguments(row) == {"_": ["p"], "a": "x", "b": ["y", "z"]}


def test_overlay_and_commit(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    changes = spark.createDataFrame([("a", "delete", None, "1"), ("c", "put", "3", ""), ("b", "put", "2", "2")], "path string, op string, content string, original string")
    assert sorted(map(tuple, overlay.read(store, changes).collect())) == [("b", "2"), ("c", "3")]
    assert sorted(map(tuple, overlay.commit_diff(changes).collect())) == [("a", "deleted"), ("c", "wrote")]
    assert [r.path for r in overlay.listing(store, changes).collect()] == ["b"]


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = graph.closure(spark, spark.createDataFrame([("a",)], "node string"), edges)
    assert sorted(r.node for r in got.collect()) == ["a", "b", "c"]


def test_reconciled(spark):
    found, wanted = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "b"], ["b", "c"]))
    assert {r.k: r.state for r in validate.reconciled(found, wanted, ["k"]).collect()} == {"a": "unexpected", "b": "expected", "c": "missing"}


def test_stream_equals_batch(spark, tmp_path):
    schema, check = "id long, text string", lambda df: validate.empty(df.select(F.col("id").alias("instance"), F.lit("t").alias("field"), "text"))
    for rows in ([(1, ""), (2, "x")], [(1, "y"), (3, " ")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        revalidate(spark, str(tmp_path / "in"), schema, "id", check, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.instance for r in latest(spark.read.parquet(str(tmp_path / "out"))).collect()] == [3]
