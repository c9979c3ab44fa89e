"""Connected components of a links table, distributed, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, release


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node of its component) for all nodes of links(a, b).

    Smallest labels spread over the links, then each node takes its label's label, so long chains
    halve.  A hub's links are reduced before they are shuffled.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(spark, both, "links")
    labels = materialize(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        lower = materialize(spark, lower, "labels")
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = materialize(spark, lower.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        release(lower, labels)
        labels = new
        if not labels.where("comp <> old").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    release(both)
    out = labels.select("node", "comp")
    out.stored_at = labels.stored_at
    return out
