"""Bounded samples of labelled documents, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, excluded: int, rows: int) -> DataFrame:
    """text, y of at most ``rows`` labelled documents whose crc32(id) mod modulus isn't excluded.

    The ids with the smallest hashes are taken, so reruns agree.  A document with several labels
    takes the majority, 1 on a tie; null labels are left out.  The ids are at most ``rows`` in
    number, so they can be broadcast.  Of several texts of an id the one of the smallest hash is
    taken, so an id that repeats is one row however often it stands.
    """
    usable = labels.select(F.col("doc_id"), F.col(target).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(_spark.crc_mod("doc_id", modulus) != excluded)
    ids = usable.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text").isNull())).alias("text")).select("doc_id", "text", "y")
