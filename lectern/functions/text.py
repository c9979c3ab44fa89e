"""Scalar functions of the document engine as Column expressions.

White space means ASCII white space (``\\s``) throughout; null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def first_sentence(doc: Column | str, width: int = 76) -> Column:
    """The lines before the first blank one, joined, cut after the first full stop before white space or the end;
    over ``width`` characters, width - 1 of them and an ellipsis. A text that starts with a blank line gives ''."""
    head = F.substring_index(F.regexp_replace(_c(doc), r"[ \t\r]*\n[ \t\r]*", "\n"), "\n\n", 1)
    line = squeeze(F.when(_c(doc).rlike(r"^[ \t\r]*(\n|$)"), F.lit("")).otherwise(head))
    cut = F.coalesce(F.nullif(F.regexp_extract(line, r"^(.*?\.)(?:\s|$)", 1), F.lit("")), line)
    return F.when(F.length(cut) > width, F.concat(F.rtrim(F.substring(cut, 1, width - 1)), F.lit("…"))).otherwise(cut)


def format_comment(raw: Column | str) -> Column:
    """A block comment's text: marks and leading stars off, lines right-trimmed, a blank first or last line dropped."""
    inner = F.regexp_replace(F.regexp_replace(_c(raw), r"^/\*+", ""), r"\*+/$", "")
    lines = F.transform(F.split(inner, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\*\s?", ""), r"\s+$", ""))
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, 1) == ""), F.slice(lines, 2, F.size(lines) - 1)).otherwise(lines)
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.array_join(lines, "\n")


def ws_collapse(text: Column | str, in_pre: Column) -> Column:
    """Several line breaks to one, in text of white space only and outside ``pre``."""
    x = _c(text)
    return F.when(x.rlike(r"^\s*$") & ~in_pre, F.regexp_replace(x, r"\n{2,}", "\n")).otherwise(x)


def escape_raw(text: Column | str, tag: Column | str) -> Column:
    """The own closing tag inside a raw-text element made harmless."""
    return F.replace(_c(text), F.concat(F.lit("</"), _c(tag)), F.concat(F.lit("<\\/"), _c(tag)))


def link_class(href: Column | str) -> Column:
    """empty, fragment, external (scheme:) or path."""
    x = _c(href)
    return F.when(x == "", "empty").when(x.startswith("#"), "fragment").when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "external").otherwise("path")


def link_target(href: Column | str) -> Column:
    return F.substring_index(_c(href), "#", 1)


def link_fragment(href: Column | str) -> Column:
    """From the first # on, with it; '' without one."""
    x = _c(href)
    return F.when(F.instr(x, "#") > 0, F.substring(x, F.instr(x, "#"), F.length(x))).otherwise("")


def path_normalize(path: Column | str) -> Column:
    """Dots and doubled slashes resolved; a path that climbs above its start keeps its leading ..'s; '' gives '.'."""
    x = _c(path)
    rooted = x.startswith("/")
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(acc, p):
        up = (p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(F.lit(""))), F.greatest(F.size(acc), F.lit(1))) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & rooted, acc).otherwise(F.concat(acc, F.array(p)))

    out = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), out)).when(out == "", ".").otherwise(out)


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def resolve(base: Column | str, target: Column | str) -> Column:
    """target as seen from the file base."""
    return path_normalize(F.concat_ws("/", F.nullif(dirname(base), F.lit("")), _c(target)))


def rel_href(src: Column | str, dst: Column | str) -> Column:
    """The relative path from the file src to dst; './' before what does not start with a dot."""
    a, b = F.filter(F.split(dirname(src), "/"), lambda p: p != ""), F.filter(F.split(_c(dst), "/"), lambda p: p != "")
    upto = F.sequence(F.lit(0), F.least(F.size(a), F.size(b) - 1))
    same = F.array_max(F.filter(upto, lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)))
    rel = F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))
    path = F.array_join(rel, "/")
    return F.when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), path))


def host_id(path: Column | str) -> Column:
    """The id in <id>.template.html or <id>.command.html, null for other names."""
    return F.nullif(F.regexp_extract(basename(path), r"^(.*?)\.(?:template|command)\.html$", 1), F.lit(""))


def touches_collapse(touches: Column | str) -> Column:
    """Several names with one prefix before the first '-' as prefix-*, else as they stand."""
    parts = F.filter(F.split(_c(touches), r"\s+"), lambda p: p != "")
    kinds = F.array_distinct(F.transform(parts, lambda p: F.substring_index(p, "-", 1)))
    return F.when((F.size(parts) > 1) & (F.size(kinds) == 1), F.concat(F.element_at(kinds, 1), F.lit("-*"))).otherwise(_c(touches))


def script_lang(kind: Column | str, node_prefix: str = "node/") -> Column:
    """The extension of a script's virtual file: types of the prefix run outside the browser."""
    return F.when(_c(kind).startswith(node_prefix), ".ts").otherwise(".js")


def locator(id_: Column | str, index: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(id_), F.lit("")), F.concat(F.lit("@"), _c(index).cast("string")))


def encode_component(x: Column | str) -> Column:
    """Percent-encoding of a URL component; letters, digits and -_.!~*'() stay."""
    out = F.url_encode(_c(x))
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def synthetic_url(path: Column | str, locator_: Column | str, marker: str = "lectern-script") -> Column:
    """The address of a document's script as a module of its own."""
    return F.concat(F.lit("file://"), _c(path), F.lit(f".{marker}."), encode_component(locator_), F.lit(".mjs"))


def real_path(url: Column | str, marker: str = "lectern-script") -> Column:
    """The document in such an address, up to the last marker; null for other addresses."""
    return F.nullif(F.regexp_extract(_c(url), rf"^file://([\s\S]*)\.{marker}\.[\s\S]*\.mjs$", 1), F.lit(""))


def real_locator(url: Column | str, marker: str = "lectern-script") -> Column:
    """The decoded locator in such an address; null for other addresses."""
    raw = F.nullif(F.regexp_extract(_c(url), rf"^file://[\s\S]*\.{marker}\.([\s\S]*)\.mjs$", 1), F.lit(""))
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def opening(title: Column | str, default: str = "documents, and what they may say") -> Column:
    """A title as a sentence's continuation: first letter lower, one full stop at the end dropped; the default without one."""
    x = F.nullif(F.trim(F.regexp_replace(_c(title), r"^\s+|\s+$", "")), F.lit(""))
    return F.coalesce(F.concat(F.lower(F.substring(x, 1, 1)), F.regexp_replace(F.substring(x, 2, 1 << 20), r"\.$", "")), F.lit(default))


def count_label(n: Column | str) -> Column:
    """'3 docs', or 'no docs'."""
    return F.when(F.coalesce(_c(n), F.lit(0)) == 0, "no docs").otherwise(F.concat(_c(n).cast("string"), F.lit(" docs")))


def parse_args(argv: Column | str) -> Column:
    """struct<pos: array<string>, flags: array<struct<k, v: array<string>>>> of command-line tokens.

    Only -- starts a flag; it takes the next token unless that starts a flag or is missing, then 'true'.
    Flags that repeat collect their values; the flag named _ adds to the positionals.
    """
    x = _c(argv)
    is_flag = lambda t: F.substring(t, 1, 2) == "--"
    at = F.sequence(F.lit(1), F.size(x))
    nxt = lambda i: F.try_element_at(x, i + 1)
    own = lambda i: F.element_at(x, i)
    taken = lambda i: (i > 1) & is_flag(F.element_at(x, F.greatest(i - 1, F.lit(1)))) & ~is_flag(own(i))
    value = lambda i: F.when(nxt(i).isNull() | is_flag(nxt(i)), F.lit("true")).otherwise(nxt(i))
    pairs = F.transform(F.filter(at, lambda i: is_flag(own(i))), lambda i: F.struct(F.substring(own(i), 3, 1 << 20).alias("k"), value(i).alias("v")))
    pos = F.transform(F.filter(at, lambda i: ~is_flag(own(i)) & ~taken(i) | (taken(i) & (F.element_at(x, F.greatest(i - 1, F.lit(1))) == "--_"))), own)
    keys = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] != "_"), lambda p: p["k"]))
    flags = F.transform(keys, lambda k: F.struct(k.alias("k"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("v")))
    some = F.size(x) > 0
    return F.struct(F.when(some, pos).otherwise(F.array().cast("array<string>")).alias("pos"), F.when(some, flags).otherwise(F.array().cast("array<struct<k: string, v: array<string>>>")).alias("flags"))
