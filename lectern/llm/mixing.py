"""Mixing sources to target weights by entropy balancing.

Each source s has a target of words T_s.  Among all rates 0 < r_d < cap of its
documents with sum r_d size_d = T_s, those of least relative entropy to one
common rate are an exponential tilt by size,

    r_d = cap / (1 + exp(-(l_s * size_d / mean_s))),

(the logistic form of exp(l z) that the bound gives), where l_s minimises a
convex dual.  Newton's iterations on all duals run at once; each is one
aggregation over the histogram (source, size, number of documents), in which
equal sizes are one row however many documents have them, so the iterations
never read a text again and no hot source meets in one task.

Rates become copies in two steps that keep totals exact: copies are dealt to
the sizes of a source by carrying the error in words from the largest to the
smallest size, then to the documents of one size by a ranking of hashed ids
inside blocks of about ``block`` documents, so reruns agree.

Sources rank by code point, null last; weights repeat along the ranking.
Targets share ``share`` of all words and stop at ``cap`` times the source's
own words; the excess is reshared by weight until no target is above.

Null and empty texts have size 0 and take 0; a null source is a source, a null id
an id; repeated rows are documents of their own; texts of any length are counted
whole; a table without words has targets 0; an empty table gives an empty result.
Extra columns, whatever their names, play no part unless asked for in ``keep``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark

#: The largest dual, at which all documents but those far below the mean size are taken cap times.
MOST = 60.0
WORD = r"[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size: the number of words between ASCII white space."""
    return docs.withColumn("size", F.coalesce(F.expr(f"regexp_count(`{text}`, '{WORD}')"), F.lit(0)).cast("long"))


def source_targets(spark: SparkSession, by_source: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size).

    The ranking is a distributed sort; each round of resharing is one aggregation, and fixes at
    least one source at its cap, in practice all that ever will be within a few rounds.
    """
    kind = by_source.schema["source"].dataType
    ordered = by_source.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([T.StructField("source", kind), T.StructField("source_size", T.LongType()), T.StructField("rank", T.LongType())])
    ranked = spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), schema)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    state = _spark.materialize(spark, ranked.withColumn("weight", pick), "mix-sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    limit = cap * F.col("source_size")
    rate = 0.0  # words for a unit of weight
    want = min(share, cap) * total
    while True:
        full = F.col("weight") * F.lit(rate) >= limit
        row = state.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        new = (want - row.fixed) / row.open
        if new <= rate * (1 + 1e-15):
            break
        rate = new
    return state.select("source", "source_size", F.least(F.col("weight") * F.lit(rate), limit).alias("target"))


def balance(spark: SparkSession, histogram: DataFrame, cap: float = 2.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """source, mean, tilt of each source from (source, size, n, source_size, target); sizes above 0 only.

    The duals start where they would end if all of a source's documents had its mean size.  A source
    whose target is all that its documents can give keeps the largest tilt.
    """
    mean = (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")
    duals = histogram.groupBy("source").agg(mean, F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    full = F.least(F.col("target") / (cap * F.col("source_size")), F.lit(1.0))
    start = F.when(full >= 1 - 1e-12, MOST).when(full <= 0, -MOST).otherwise(F.greatest(F.least(F.log(full / (1 - full)), F.lit(MOST)), F.lit(-MOST)))
    duals = _spark.materialize(spark, duals.withColumn("tilt", start).withColumn("open", F.col("tilt") < MOST), "mix-duals")
    for _ in range(rounds):
        if not duals.where("open").limit(1).count():
            return duals.select("source", "mean", "tilt")
        h = histogram.select("source", "size", "n").alias("h").join(duals.where("open").alias("d"), F.expr("h.source <=> d.source"))
        z = F.col("size") / F.col("mean")
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("tilt") * z, F.lit(500.0)), F.lit(-500.0))))
        step = h.groupBy("h.source", "d.mean", "d.target", "d.source_size", "d.tilt").agg(
            F.sum(cap * p * F.col("size") * F.col("n")).alias("have"), F.sum(cap * p * (1 - p) * z * F.col("size") * F.col("n")).alias("slope")
        )
        gap = F.col("target") - F.col("have")
        move = F.greatest(F.least(gap / F.greatest(F.col("slope"), F.lit(1e-300)), F.lit(4.0)), F.lit(-4.0))
        done = F.abs(gap) <= F.lit(tolerance) * F.col("source_size")
        new = step.select("source", "mean", "target", "source_size", F.when(done, F.col("tilt")).otherwise(F.greatest(F.least(F.col("tilt") + move, F.lit(MOST)), F.lit(-MOST))).alias("tilt"), (~done & (F.abs("tilt") < MOST)).alias("open"))
        duals = _spark.materialize(spark, duals.where("not open").unionByName(new), "mix-duals")
    raise RuntimeError("the duals did not settle")


def _deal(cap: float):
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies for each size of one source: at most one row for each distinct size."""
        pdf = pdf.sort_values("size", ascending=False)
        copies, owed = [], 0.0
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            owed += rate * n * size
            k = max(0, min(math.floor(owed / size + 0.5), int(cap) * n))
            owed -= k * size
            copies.append(k)
        return pdf.assign(copies=copies)[["source", "size", "n", "copies"]]

    return deal


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 256, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """id, source, size, source_size, target, copies, taken for every row, with the columns in keep.

    cap is a whole number: the most copies of a document.  Rows of one id are told apart by the columns
    in keep, in their order.
    """
    keep = keep or []
    sized = sizes(docs.select(F.col(id_col).alias("_id"), F.col("source"), F.col("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])).drop("text")
    sized = _spark.materialize(spark, sized, "mix-sizes")
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = _spark.materialize(spark, counts, "mix-histogram")
    targets = source_targets(spark, counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    targets = _spark.materialize(spark, targets, "mix-targets")
    histogram = counts.where("size > 0").alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "size", "n", "source_size", "target")
    duals = balance(spark, histogram, cap)
    rate = cap / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean")))
    rated = histogram.alias("h").join(duals.alias("d"), F.expr("h.source <=> d.source")).select("h.source", "size", "n", rate.alias("rate"))
    source_type = rated.schema["source"].dataType.simpleString()
    dealt = rated.groupBy("source").applyInPandas(_deal(cap), f"source {source_type}, size long, n long, copies long")
    dealt = _spark.materialize(spark, dealt, "mix-dealt")

    # blocks of one size, each given its share of the size's copies by running totals
    part = F.pmod(F.xxhash64("_id", *[f"_keep_{c}" for c in keep[:1]]), F.greatest(F.lit(1), F.ceil(F.col("n") / block)))
    placed = sized.alias("s").join(dealt.alias("c"), F.expr("s.source <=> c.source and s.size = c.size"), "left")
    placed = placed.select("_id", "s.source", "s.size", "copies", "n", part.alias("part"), *[f"_keep_{c}" for c in keep])
    in_part = placed.where("size > 0").groupBy("source", "size", "part", "n", "copies").agg(F.count("*").alias("m"))
    running = F.sum("m").over(Window.partitionBy("source", "size").orderBy("part"))
    share_of = lambda upto: F.floor(upto.cast("decimal(38,0)") * F.col("copies") / F.col("n"))
    in_part = in_part.withColumn("upto", running).select("source", "size", "part", "m", (share_of(F.col("upto")) - share_of(F.col("upto") - F.col("m"))).cast("long").alias("k"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("_id", F.lit(1)), "_id", *[f"_keep_{c}" for c in keep])) - 1
    ranked = placed.where("size > 0").withColumn("rank", rank).alias("p").join(in_part.alias("q"), F.expr("p.source <=> q.source and p.size = q.size and p.part = q.part"))
    kept = [f"_keep_{c}" for c in keep]
    given = ranked.select("_id", "p.source", "p.size", (F.floor(F.col("k") / F.col("m")) + (F.col("rank") < F.col("k") % F.col("m")).cast("long")).alias("copies"), *kept)
    out = given.unionByName(placed.where("size = 0").select("_id", "source", "size", F.lit(0).cast("long").alias("copies"), *kept))
    out = out.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source"))
    return out.select(F.col("_id").alias(id_col), "o.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def mixed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it, with copy numbers from 1 in a last column.

    That is named ``copy``, with as many underscores before it as make it a new name; no other name
    matters.  The rows are numbered as they are written, the mix is computed without texts, and the
    texts are shuffled once, to meet their copies by the row's number.  Rows that share an id are told
    apart by a hash of all columns; rows that are equal in all of them are interchangeable.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {x: f"c{names.index(x)}" for x in (id_col, "source", "text")}
    plain = [F.to_json(F.col(c)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(c) for c, f in zip(inner.columns, inner.schema.fields, strict=True)]
    rows = _spark.materialize(spark, inner.withColumns({"hash": F.xxhash64(*plain), "row": F.monotonically_increasing_id()}), "mix-rows")
    small = rows.select(F.col(at[id_col]).alias("id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"), "hash", "row")
    taken = mix(spark, small, id_col="id", keep=["hash", "row"], **settings).where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    met = rows.join(taken, "row").select(*inner.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    last = "copy"
    while last in names:
        last = "_" + last
    return met.toDF(*names, last)
