"""How the sources of a language differ in the terms that they use.

Terms are runs of letters (every non-ASCII character counts as one), A-Z in lower case.  A language keeps the
V terms that stand in at least ``least_docs`` of its documents.  A group (lang, source), and a language as a
whole, gives each kept term, occurring there count times of N kept occurrences, the share

    p = 1 + floor(10^9 (count + 5) / (N + 5 V))

in whole numbers (decimals of 38 digits where 64 bits could overflow), and f = |p - q| is how far two shares lie apart.

**Terms of a group above its language**, the ``top`` of largest f: a group's terms lie in buckets of like counts,
and the largest p and the smallest q of a bucket bound every f in it.  Buckets are evaluated best bound first, in
rounds that double what a group evaluates, and a group stops once the bounds of all that it hasn't seen are
strictly below its top-th value; the common terms, whose shares are alike everywhere, are never evaluated.

**Pairs of sources**: f summed over all kept terms.  Postings (who uses a term, with which share) compute it: a term
that neither source uses gives both their smallest shares, so that only the used terms are walked, in tiles of
``tile`` sources by ``tile`` and in parts of the terms, and partial sums are added up.  No pair of rows is ever made.

Nulls in text, lang and source count as ''.  Groups without a kept term take part with p of count 0 (value 0 where the
language keeps none).  Ties rank by UTF-8.  Repeated rows are documents of their own.  Texts of any length count
whole.  An empty table gives an empty result.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv

#: Bytes of texts whose terms are added up before they leave the parser.
SLICE = 4 << 20
#: Terms of one part that a kernel holds at once.
CHUNK = 1024


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def counted_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): added up over slices of texts, so a group has several rows of a term."""

    def run(batches):
        for batch in batches:
            langs, lang_names = _codes(batch.column(0))
            sources, source_names = _codes(batch.column(1))
            groups, of_doc = np.unique(langs * max(len(source_names), 1) + sources, return_inverse=True)
            for s in tv.slices(batch.column(2), SLICE):
                w = tv.words(s, tv.LETTERS)
                if not len(w.start):
                    continue
                code, terms = _codes(tv.spelled(s, w, tv.LETTERS))
                each, n = np.unique(w.doc * len(terms) + code, return_counts=True)
                of = of_doc[s.first + each // len(terms)] * len(terms) + each % len(terms)
                both, back = np.unique(of, return_inverse=True)
                group, term = groups[both // len(terms)], both % len(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        lang_names.take(pa.array(group // len(source_names))).cast(pa.string()),
                        source_names.take(pa.array(group % len(source_names))).cast(pa.string()),
                        terms.take(pa.array(term)).cast(pa.string()),
                        pa.array(np.bincount(back, n, len(both)).astype(np.int64)),
                        pa.array(np.bincount(back, minlength=len(both)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return docs.select("lang", "source", "text").mapInArrow(_spark.tidy(run), "lang string, source string, term string, n long, docs long")


def kept_terms(spark: SparkSession, docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, source, term, n, lang_n of the kept terms; lead is true in one row of each term of a language.  Stored."""
    c = counted_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    kept = c.withColumn("df", F.sum("docs").over(w)).where(F.col("df") >= least_docs).withColumn("lang_n", F.sum("n").over(w))
    lead = F.row_number().over(w.orderBy("source")) == 1
    return _spark.materialize(spark, kept.select("lang", "source", "term", "n", "lang_n", lead.alias("lead")), "divergence-terms")


def share(count: str | int, held: str, kept: str) -> Column:
    """p of a count in a group of held occurrences, in a language of kept terms; 0 where none is kept."""
    return F.expr(f"if({kept} = 0, 0L, 1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(19,0))) div cast(greatest({held} + 5 * {kept}, 1) as decimal(19,0)))")


def group_table(spark: SparkSession, docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, sid (from 0 in each language), sids (sources of the language), held, lang_held, terms, none (p of count 0).  Stored."""
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_held"), F.count_if("lead").alias("terms"))
    g = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, ["lang"], "left").fillna(0, ["held", "lang_held", "terms"])
    w = Window.partitionBy("lang")
    g = g.withColumns({"sid": (F.row_number().over(w.orderBy("source")) - 1).cast("long"), "sids": F.count("*").over(w), "none": share(0, "held", "terms")})
    return _spark.materialize(spark, g, "divergence-groups")


def _pairs_of(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of a tile by a tile of sources over a part of the terms; part 0 has what all terms would give unused."""
    lang, one, other, part = key
    right = right.sort_values("sid")
    rows, cols = right[right["tile"] == one], right[right["tile"] == other]
    a0, b0 = rows["none"].to_numpy(np.int64), cols["none"].to_numpy(np.int64)
    base = np.abs(a0[:, None] - b0[None, :])
    total = base * int(right["terms"].iloc[0]) if part == 0 else np.zeros_like(base)
    if len(left):
        code, terms = pd.factorize(left["term"])
        order = np.argsort(code, kind="stable")
        code, tile, sid, p = code[order], left["tile"].to_numpy()[order], left["sid"].to_numpy()[order], left["p"].to_numpy()[order]
        for t in range(0, len(terms), CHUNK):
            lo, hi = np.searchsorted(code, [t, t + CHUNK])
            m = min(CHUNK, len(terms) - t)
            sides = []
            for k, none, own in ((one, a0, rows), (other, b0, cols)):
                x = np.repeat(none[None, :], m, axis=0)
                at = np.flatnonzero(tile[lo:hi] == k) + lo
                x[code[at] - t, sid[at] - int(own["sid"].iloc[0])] = p[at]
                sides.append(x)
            for i in range(len(a0)):
                total[i] += np.abs(sides[0][:, i : i + 1] - sides[1]).sum(axis=0) - m * base[i]
    i, j = np.nonzero(rows["sid"].to_numpy()[:, None] != cols["sid"].to_numpy()[None, :])
    x, y = rows["source"].to_numpy()[i], cols["source"].to_numpy()[j]
    out = pd.DataFrame({"lang": lang, "source": x, "item": y, "value": total[i, j]})
    return out if one == other else pd.concat([out, out.rename(columns={"source": "item", "item": "source"})])


def pairs(kept: DataFrame, groups: DataFrame, tile: int = 256, part_rows: int = 100_000) -> DataFrame:
    """lang, source, item (another source of the language), value: f summed over all kept terms."""
    parts = max(1, -(-kept.count() // part_rows))
    of_tile = F.expr(f"sid div {tile}")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sids - 1) div {tile}"))).alias("with")
    ends = [F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("other")]
    g = groups.withColumn("tile", of_tile).select("*", others)
    right = g.select("lang", *ends, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "tile", "sid", "source", "none", "terms")
    p = kept.join(groups, ["lang", "source"]).select("lang", "sid", "sids", "term", share("n", "held", "terms").alias("p"))
    left = p.withColumn("tile", of_tile).select("*", others)
    left = left.select("lang", *ends, F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "tile", "sid", "term", "p")
    by = ["lang", "one", "other", "part"]
    left = left.toDF(*left.columns)  # both come from groups: columns of its own
    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_pairs_of, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _bucket(count: str) -> Column:
    """Counts to 32 alone, larger ones eight to a doubling."""
    return F.when(F.col(count) < 32, F.col(count)).otherwise(F.floor(F.log2(F.col(count)) * 8) - 8).cast("int")


def leading_terms(spark: SparkSession, kept: DataFrame, groups: DataFrame, top: int = 50, first: int | None = None) -> DataFrame:
    """lang, source, item, value: of each group the top terms of largest f among those whose share is above the language's.

    The result has the attribute ``evaluated``: terms of which f was computed.
    """
    by = ["lang", "source"]
    p, q = share("n", "held", "terms"), share("lang_n", "lang_held", "terms")
    terms = kept.join(groups, by).select(*by, "term", "n", "lang_n", "held", "lang_held", "terms", _bucket("n").alias("bucket"))
    order = Window.partitionBy(*by).orderBy(F.desc("bound"), "bucket")
    buckets = terms.groupBy(*by, "bucket").agg(F.count("*").alias("size"), (F.max(p) - F.min(q)).alias("bound")).where("bound > 0")
    buckets = _spark.materialize(spark, buckets.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")), "divergence-buckets")
    best = spark.createDataFrame([], "lang string, source string, item string, value long")
    seen, want, evaluated = 0, first or top, 0
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    while True:
        floor = best.groupBy(*by).agg(F.when(F.count("*") >= top, F.min("value")).alias("floor"))
        left = buckets.where(F.col("before") >= seen).join(floor, by, "left").where("floor is null or bound >= floor")
        if not left.limit(1).count():
            best.evaluated = evaluated
            return best
        now = left.where(F.col("before") < want).select(*by, "bucket")
        found = terms.join(now, [*by, "bucket"]).withColumn("value", p - q)
        found = found.where("value > 0").select(*by, F.col("term").alias("item"), "value")
        evaluated += left.where(F.col("before") < want).agg(F.sum("size")).first()[0] or 0
        new = _spark.materialize(spark, best.unionByName(found).withColumn("rank", rank).where(F.col("rank") <= top).drop("rank"), "divergence-best")
        _spark.release(best)
        best, seen, want = new, want, want * 4


def divergence(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50, tile: int = 256) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = kept_terms(spark, docs, least_docs)
    groups = group_table(spark, docs, kept)
    made = pairs(kept, groups, tile).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    made = made.unionByName(leading_terms(spark, kept, groups, top).select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return made.withColumn("rank", rank)


SQL = """
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS held FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS held
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) LEFT JOIN c USING (lang, source)
  GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.held + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (kept.lang_n + 5)) // (l.held + 5 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u)
WHERE part = 'pair' OR rank <= 50
"""
