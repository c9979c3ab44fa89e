"""Personal data by candidate gradient boosting, in DataFrame expressions only.

High-recall generators propose spans: the four base kinds (email, ip, card,
phone, each leftmost and non-overlapping by its fixed pattern and check) and
loose ones (secrets, IBANs, local phone numbers, id numbers, spelled-out
emails), which may overlap.  Boosted regression trees score the loose ones by
their format and the words before them; those above their kind's threshold,
calibrated to ``precision`` on held-out examples, are selected, unless they
overlap a base span.  Base spans always stay.

The trees are fitted once a process on the driver, to generated examples
(personal data and look-alikes such as dates, versions, prices, order numbers,
long words), and become one CASE expression a tree; nothing but built-in
functions runs on the executors.  Positions are code points, end exclusive:
they are summed from the lengths of the matches and of the pieces between.

Null and empty texts have no spans; texts of any length are matched whole, in
time linear in their length; of two matches of a kind at one place the longer
counts (patterns are greedy); the order of rows plays no part, repeated rows
give repeated results; extra columns, whatever their names, are kept by
``redacted`` and not read by ``find``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in their order.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: The same matches in time that is linear in the text and without recursion: possessive repeats (what
#: follows a repeat never starts like it), tried only at the first character that could start a match,
#: as a later start within one run of characters matches only if the first one does.
_EMAIL_AT = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP_AT = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD_AT = r"[0-9](?:[\x20-]?[0-9])++"
#: What holds every ip, card and phone: all are of these characters and start so.
_RUN = r"[+0-9][\x20().0-9+-]*+"
_IP_OK = r"^(0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\.|$)){4}$"

LOOSE = {
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:\x20dot\x20|\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,6}(?![A-Za-z])",
}
KINDS = ["email", "ip", "card", "phone", *LOOSE]
CUES = r"(token|secret|passw|api|key|bearer|auth|credential|iban|account|bank|call|phone|tel|mobile|fax|ssn|social|tax|passport|e-?mail|mail|contact|reach|write)"

FEATURES = ["kind", "n", "digits", "upper", "letters", "seps", "hex", "cue", "quoted", "switches"]


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Appending copies an array, so lists are built in blocks of this many matches: a text's cost is near its length.
BLOCK = 64
_SPANS = "array<struct<s: int, m: string>>"


def _blocks(array: str, v: str, block: str) -> str:
    """block (an expression of {v}b, some neighbours of the array) for each block of the array, in order."""
    return f"flatten(transform(array({array}), {v}z -> transform(sequence(0, greatest(size({v}z) - 1, 0) div {BLOCK}), {v}i -> element_at(transform(array(slice({v}z, {v}i * {BLOCK} + 1, {BLOCK})), {v}b -> {block}), 1))))"


def spans_sql(text: str, pattern: str, v: str) -> str:
    """array<struct<s, m>>: the start and the text of each match; v makes variable names unique.

    Starts are counted from each block's beginning first, then moved by the blocks before.
    """
    p = _q(pattern)
    cut = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), ({v}g, {v}m) -> struct({v}g as g, {v}m as m))"
    local = (
        f"aggregate({v}b, struct(0 as at, cast(array() as {_SPANS}) as out), "
        f"({v}a, {v}x) -> if({v}x.m is null, {v}a, struct({v}a.at + length({v}x.g) + length({v}x.m) as at, array_append({v}a.out, struct({v}a.at + length({v}x.g) as s, {v}x.m as m)) as out)))"
    )
    moved = f"if({v}c.at = 0, {v}y.out, transform({v}y.out, {v}x -> struct({v}x.s + {v}c.at as s, {v}x.m as m)))"
    return (
        f"aggregate({_blocks(cut, v, local)}, struct(0 as at, cast(array() as array<{_SPANS}>) as out), "
        f"({v}c, {v}y) -> struct({v}c.at + {v}y.at as at, array_append({v}c.out, {moved}) as out), {v}c -> flatten({v}c.out))"
    )


_DIGITS = lambda m: f"regexp_replace({m}, '[^0-9]', '')"


def luhn_sql(m: str) -> str:
    d = _DIGITS(m)
    return f"aggregate(transform(array({d}), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + (cast(substring(d, i, 1) as int) * (1 + (length(d) - i) % 2)) - if((length(d) - i) % 2 = 1 and cast(substring(d, i, 1) as int) > 4, 9, 0))), 0, (a, x) -> a + x) % 10 = 0"


def base_spans(text: str) -> dict[str, Column]:
    """array<struct<s, m>> of each base kind; expects the columns _email_text and _runs of ``prepared``."""
    inside = lambda pattern, v: f"flatten(transform(_runs, r -> transform({spans_sql('r.m', pattern, v)}, x -> struct(r.s + x.s as s, x.m as m))))"
    n = f"length({_DIGITS('x.m')})"
    return {
        "email": F.expr(f"if(_t like '%@%', {spans_sql('_t', _EMAIL_AT, 'e')}, cast(array() as array<struct<s: int, m: string>>))"),
        "ip": F.expr(f"filter({inside(_IP_AT, 'i')}, x -> x.m rlike {_q(_IP_OK)})"),
        "card": F.expr(f"filter({inside(_CARD_AT, 'c')}, x -> if({n} between 13 and 19, {luhn_sql('x.m')}, false))"),
        "phone": F.expr(f"filter({inside(PHONE, 'p')}, x -> {n} between 9 and 15)"),
    }


# ---- boosted trees ----


def describe(kind: str, match: str, before: str) -> list[float]:
    """The features, as the SQL of ``features_sql`` makes them."""
    import re

    count = lambda p: len(re.findall(p, match))
    return [
        list(LOOSE).index(kind), len(match), count("[0-9]"), count("[A-Z]"), count("[A-Za-z]"), count(r"[\x20().\[\]-]"),
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", match))), float(bool(re.search(CUES, before.lower()))), float(bool(re.search("[\"'=:]\\x20?$", before))), count("[A-Za-z][0-9]|[0-9][A-Za-z]"),
    ]


def features_sql(kind: int, m: str, before: str) -> str:
    count = lambda p: f"length(regexp_replace({m}, {_q(p)}, ''))"
    flag = lambda text, p: f"cast({text} rlike {_q(p)} as double)"
    parts = [
        str(kind), f"length({m})", count("[^0-9]"), count("[^A-Z]"), count("[^A-Za-z]"), count(r"[^\x20().\[\]-]"),
        flag(m, "^([0-9a-f]+|[0-9A-F]+)$"), flag(f"lower({before})", CUES), flag(before, "[\"'=:]\\x20?$"), f"regexp_count({m}, '[A-Za-z][0-9]|[0-9][A-Za-z]')",
    ]
    return "array(" + ", ".join(f"cast({p} as double)" for p in parts) + ")"


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated spans, half personal data and half look-alikes."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    digits, hexes, mixed = "0123456789", "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    word = lambda: pick("aeioulnrstdhm", r.randint(2, 9))
    plain = lambda: " ".join(word() for _ in range(4)) + " "
    cue = lambda *words: plain() + r.choice(words) + r.choice([" ", ": ", " = \"", "=", " is "])
    rows, y = [], []
    for _ in range(n):
        kind, good = r.choice(list(LOOSE)), r.random() < 0.5
        if kind == "secret":
            if good:
                m = r.choice([pick(hexes, r.choice([32, 40, 64])), pick(mixed, r.randint(24, 48)), "sk-" + pick(mixed, 32)])
                before = cue("token", "secret", "api key", "password", "bearer") if r.random() < 0.8 else plain()
            else:
                m = r.choice([word() * 4 + pick(digits, r.randint(1, 3)), f"{word()}-{word()}-{word()}-{r.randint(1, 2030)}", pick(digits, r.randint(16, 24)), "-".join(pick(digits, 4) for _ in range(4)), "+" + pick(digits, 15), f"{r.randint(1990, 2030)}-{word()}-{word()}-{word()}", word() + "/" + word() + "/" + word() + str(r.randint(1, 99))])
                before = plain()
        elif kind == "iban":
            if good:
                m, before = pick("DEFRESGB", 2) + pick(digits, 2) + "".join(r.choice([" ", ""]) + pick(digits, 4) for _ in range(r.randint(4, 5))) + pick(digits, 2), cue("iban", "account", "bank")
            else:
                m, before = pick("ABCDXYZ", 2) + pick(digits, 2) + "".join(pick("ABCDEFGH0123456789", 4) for _ in range(r.randint(2, 3))), plain()
        elif kind == "local_phone":
            sep = r.choice(" .-")
            m = f"({pick(digits, 3)}){sep}{pick(digits, 3)}{sep}{pick(digits, 4)}" if r.random() < 0.4 else f"{pick(digits, 3)}{sep}{pick(digits, 3)}{sep}{pick(digits, 4)}"
            before = cue("call", "phone", "tel", "mobile", "fax") if good else plain() + r.choice(["order ", "sum ", "rows ", "of ", ""])
        elif kind == "id_number":
            m = f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}"
            before = cue("ssn", "social", "tax", "passport") if good else plain() + r.choice(["part ", "item ", ""])
        else:
            at, dot = (r.choice(["(at)", "[at]", " [at] "]), r.choice([" [dot] ", "(dot)", "."])) if good else (" at ", r.choice(["."]))
            m = f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"
            before = (cue("mail", "contact", "write", "email") if r.random() < 0.6 else plain()) if good else plain()
        rows.append(describe(kind, m, before[-24:]))
        y.append(float(good))
    return np.array(rows), np.array(y)


Tree = tuple  # (feature, cut, left, right) or (value,)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 20.0, ridge: float = 1.0) -> Tree:
    best = (1e-6, None, None)
    total = g.sum() ** 2 / (h.sum() + ridge)
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))):
                left = x[:, f] <= cut
                if left.sum() >= least and (~left).sum() >= least:
                    gain = g[left].sum() ** 2 / (h[left].sum() + ridge) + g[~left].sum() ** 2 / (h[~left].sum() + ridge) - total
                    if gain > best[0]:
                        best = (gain, f, float(cut))
    if best[1] is None:
        return (float(g.sum() / (h.sum() + ridge)),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


@functools.lru_cache(1)
def model(n: int = 3000, trees: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> tuple[tuple[Tree, ...], tuple[float, ...]]:
    """Boosted trees on the logistic loss, and for each loose kind the least threshold of the given precision on held-out examples."""
    x, y = examples(n, 1)
    z, grown = np.zeros(n), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, y - p, p * (1 - p), depth)
        grown.append(tree)
        z += rate * _value(tree, x)
    held, truth = examples(n, 2)
    z = sum(_value(t, held) for t in grown)
    return tuple(grown), tuple(_threshold(z[held[:, 0] == k], truth[held[:, 0] == k], precision) for k in range(len(LOOSE)))


def _threshold(z: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The least score above which the share of personal data is ``precision``; halfway to the next score below it."""
    cuts = np.unique(z)
    good = np.array([truth[z >= c].mean() >= precision for c in cuts])
    at = int(good.argmax()) if good.any() else len(cuts) - 1
    return float((cuts[at] + cuts[at - 1]) / 2 if at else cuts[0])


def accuracy(n: int = 3000, seed: int = 3) -> dict[str, tuple[float, float]]:
    """Precision and recall of each loose kind on generated examples that neither trees nor thresholds have seen."""
    trees, thresholds = model()
    x, y = examples(n, seed)
    z, out = sum(_value(t, x) for t in trees), {}
    for k, kind in enumerate(LOOSE):
        own = x[:, 0] == k
        taken, good = z[own] >= thresholds[k], y[own] > 0
        out[kind] = (float(good[taken].mean()) if taken.any() else 1.0, float(taken[good].mean()))
    return out


def tree_sql(tree: Tree, f: str) -> str:
    if len(tree) == 1:
        return repr(tree[0]) + "D"
    return f"if({f}[{tree[0]}] <= {tree[1]!r}D, {tree_sql(tree[2], f)}, {tree_sql(tree[3], f)})"


def loose_spans(kind: str) -> Column:
    trees, thresholds = model()
    total = " + ".join(tree_sql(t, "x.f") for t in trees)
    k = list(LOOSE).index(kind)
    found = spans_sql("_t", LOOSE[kind], "l")
    before = "substring(_t, greatest(x.s - 23, 1), least(x.s, 24))"
    featured = f"transform({found}, x -> struct(x.s as s, x.m as m, {features_sql(k, 'x.m', before)} as f))"
    free = "not exists(_base, b -> b.s < x.s + length(x.m) and x.s < b.s + length(b.m))"
    picked = f"transform(filter({featured}, x -> {total} >= {thresholds[k]!r}D and {free}), x -> struct(x.s as s, x.m as m))"
    gate = {"spelled_email": "_t rlike '(?: at |[(\\\\[]at[)\\\\]])'"}.get(kind, "_digits")
    return F.expr(f"if({gate}, {picked}, cast(array() as array<struct<s: int, m: string>>))")


def found_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column of spans for each kind, named _<kind>."""
    none = "cast(array() as array<struct<s: int, m: string>>)"
    df = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_digits", F.expr("_t rlike '[0-9]'"))
    df = df.withColumn("_runs", F.expr(f"if(_digits, filter({spans_sql('_t', _RUN, 'r')}, x -> length(x.m) >= 7), {none})"))
    df = df.withColumns({f"_{k}": c for k, c in base_spans(text).items()})
    df = df.withColumn("_base", F.concat("_email", "_ip", "_card", "_phone"))
    return df.withColumns({f"_{k}": loose_spans(k) for k in LOOSE})


def _listed(kinds: list[str]) -> Column:
    each = [F.expr(f"transform(_{k}, x -> concat_ws(':', '{k}', cast(x.s as string), cast(x.s + length(x.m) as string)))") for k in kinds]
    return F.array_join(F.concat(*each), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of docs."""
    df = found_spans(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    total = sum((F.size(f"_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans")
    return df.select(F.col("_id").alias(id_col), *counts, F.sha2(_listed(KINDS[:4]).cast("binary"), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), total)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with [KIND] in place of each selected span; overlapping spans become one, named by the first.

    Texts without spans, null ones included, stay as they are.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text)}"
    df = found_spans(inner, at)
    tagged = [F.expr(f"transform(_{k}, x -> struct(x.s as s, x.s + length(x.m) as e, '{k.upper()}' as k))") for k in KINDS]
    df = df.withColumn("_all", F.array_sort(F.concat(*tagged)))
    kind = "array<struct<s: int, e: int, k: string>>"
    joined = f"""aggregate(mb, cast(array() as {kind}), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).e > x.s,
           array_append(slice(a, 1, size(a) - 1), struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.e) as e, element_at(a, -1).k as k)),
           array_append(a, x)))"""
    # the last span of the blocks before takes what it overlaps; a block's own spans don't overlap
    merged = f"""aggregate({_blocks('_all', 'm', joined)}, struct(cast(array() as {kind}) as last, cast(array() as array<{kind}>) as out), (c, y) ->
        if(size(c.last) = 0, struct(slice(y, -1, 1) as last, array_append(c.out, slice(y, 1, size(y) - 1)) as out),
           element_at(transform(array(concat(
               array(struct(c.last[0].s as s, greatest(c.last[0].e, array_max(transform(filter(y, x -> x.s < c.last[0].e), x -> x.e))) as e, c.last[0].k as k)),
               filter(y, x -> x.s >= c.last[0].e))), w -> struct(slice(w, -1, 1) as last, array_append(c.out, slice(w, 1, size(w) - 1)) as out)), 1)),
        c -> concat(flatten(c.out), c.last))"""
    df = df.withColumn("_cut", F.expr(f"if(size(_all) > 0, {merged}, _all)"))
    gaps = "zip_with(_cut, slice(concat(array(0), transform(_cut, x -> x.e)), 1, size(_cut)), (x, p) -> struct(p as p, x.s as s, x.k as k))"
    # each block's own stretch of the text is taken out first: a substring is counted from its text's beginning
    stretch = "substring(_t, gb[0].p + 1, element_at(gb, -1).s - gb[0].p)"
    named = f"element_at(transform(array({stretch}), w -> array_join(transform(gb, x -> concat(substring(w, x.p - gb[0].p + 1, x.s - x.p), '[', x.k, ']')), '')), 1)"
    pieces = f"concat(array_join({_blocks(gaps, 'g', named)}, ''), substring(_t, element_at(_cut, -1).e + 1))"
    df = df.withColumn(at, F.expr(f"if(size(_cut) > 0, {pieces}, {at})"))
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
