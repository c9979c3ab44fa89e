"""Links between documents: anti-joins and closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import release, stored


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(src, dst) whose target is no node."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, goal) without an edge in or out, goals aside."""
    linked = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return nodes.where("not goal").join(linked, "node", "left_anti").select("node")


def without_cause(outcomes: DataFrame, edges: DataFrame) -> DataFrame:
    """outcomes(node) that no edge leads to."""
    return outcomes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def hollow(rows: DataFrame) -> DataFrame:
    """action of rows(action, has) that has nothing: no row of it says so."""
    return rows.groupBy("action").agg(F.bool_or("has").alias("some")).where("not coalesce(some, false)").select("action")


def closure(spark: SparkSession, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node of everything reachable from roots(node) over edges(src, dst); cycles are no problem.

    Only the frontier is joined in each round, and each round is written, so plans stay short. The edges are written
    once, as every round reads them.
    """
    edges = stored(spark, edges.select("src", "dst"), "closure-edges")
    frontier = stored(spark, roots.select("node").distinct(), "closure")
    rounds = [frontier]
    while frontier.limit(1).count():
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(spark, reached.join(reduce(DataFrame.unionByName, rounds), "node", "left_anti"), "closure")
        rounds.append(frontier)
    seen = stored(spark, reduce(DataFrame.unionByName, rounds), "closed")
    release(edges, *rounds)
    return seen
