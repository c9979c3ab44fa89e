"""Sharding by rendezvous hashing: every record key draws a number for each shard, and the best draw wins.

A draw is u = a 53-bit uniform number hashed from (key, shard), weighed as ln(u) / weight, of which the
largest wins (the smaller shard on a tie), so a shard gets keys in proportion to its weight, and the draws of
a shard never depend on the other shards: one shard more takes keys only into itself, one of n + 1 on average.
Key and shards alone decide, so a record keeps its place through every rerun, repartitioning or change of its text.

The key is the id as text, so that a wider integer type moves nothing; a null id counts as the empty one.
A null text is empty, of size 1.  Rows that are equal in id, size and checksum are interchangeable; each gets a
slot.  Texts of any length count whole.  An empty table gives an empty result.  Other columns stay as they are,
except one of the name of a column that is added, which is replaced.

Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialize

#: Rows of a shard that one task numbers, and copies of one row that one task makes, about.
BLOCK_ROWS = 50_000
SPAN = 1 << 16


def record_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def draws(key: Column, weights: Sequence[float]) -> list[Column]:
    """ln(u) / weight for each shard."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be above 0")
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return [F.log(u(k)) / F.lit(float(w)) for k, w in enumerate(weights)]


def assign(docs: DataFrame, id_col: str = "doc_id", shards: int = 16, weights: Sequence[float] | None = None, next_weight: float = 1.0) -> DataFrame:
    """docs with shard, and grown_shard: where the row would be with one more shard of next_weight.  No shuffle."""
    own = list(weights or [1.0] * shards)
    if len(own) != shards or not shards:
        raise ValueError("one weight for each shard")
    *now, new = draws(record_key(id_col), [*own, next_weight])
    drawn = F.array(*now)
    shard = (F.array_position(drawn, F.array_max(drawn)) - 1).cast("int")
    return docs.withColumns({"shard": shard, "grown_shard": F.when(new > F.array_max(drawn), F.lit(shards)).otherwise(shard)})


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, size (UTF-8 bytes and 1) and text_crc32 of each row."""
    own = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col), (F.octet_length(own) + 1).cast("long").alias("size"), F.crc32(own).alias("text_crc32"))


def slots(spark: SparkSession, sharded: DataFrame, id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, span: int = SPAN) -> DataFrame:
    """Rows of ``assign`` over ``digest``, with slot: from 0 without gaps in each shard, in the order of a hash of the row.

    A shard is numbered in blocks of about block_rows rows, ranges of that hash, each after the rows of the
    blocks before it; equal rows are one row with a count until they are numbered, so no key is hot.
    """
    keys = [id_col, "size", "text_crc32"]
    at = F.xxhash64(record_key(id_col), F.col("size"), F.col("text_crc32"))
    rows = sharded.groupBy(*keys, "shard", "grown_shard", at.alias("at")).agg(F.count("*").alias("n"))
    rows = materialize(spark, rows, "shard-rows")
    total = rows.agg(F.count("*").alias("rows"), F.max("n").alias("most"), F.max("shard").alias("last")).first()
    blocks = -(-total.rows // (block_rows * ((total.last or 0) + 1))) or 1
    block = F.least(F.floor((F.col("at") / F.lit(float(1 << 64)) + 0.5) * blocks), F.lit(blocks - 1)).cast("long")
    rows = rows.withColumn("block", block)
    ahead = rows.groupBy("shard", "block").agg(F.sum("n").alias("held"))
    order = Window.partitionBy("shard").orderBy("block")
    ahead = ahead.select("shard", "block", (F.sum("held").over(order) - F.col("held")).alias("ahead"))
    within = Window.partitionBy("shard", "block").orderBy("at", *[F.col(c).asc_nulls_first() for c in keys]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = rows.join(ahead, ["shard", "block"]).withColumn("first", F.col("ahead") + F.sum("n").over(within) - F.col("n"))
    pieces = first.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {span}"))))
    if (total.most or 0) > span:  # the copies of one row are made by many tasks
        pieces = pieces.repartition("at", "piece")
    start = F.col("piece") * span
    copies = pieces.withColumn("copy", F.explode(F.sequence(start, F.least(start + span, F.col("n")) - 1)))
    return copies.select(*keys, "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")


def shard(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    out = slots(spark, assign(digest(docs, id_col, text), id_col, shards, weights), id_col)
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", shards: int = 16, weights: Sequence[float] | None = None, file_bytes: int = 256 << 20) -> None:
    """All columns of docs as Parquet, a folder for each shard, in files of about file_bytes of text.

    One exchange; a hot shard is as many files, and tasks, as it needs.
    """
    held = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("b")).first().b or 0
    files = max(1, round(held / file_bytes / shards))
    part = F.pmod(F.xxhash64(record_key(id_col), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))), F.lit(files))
    out = assign(docs, id_col, shards, weights).drop("grown_shard")
    out.repartition(shards * files, F.col("shard"), part).write.partitionBy("shard").parquet(path)
