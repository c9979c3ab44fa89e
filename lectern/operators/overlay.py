"""Uncommitted changes over stored files: changes(path, op, content, original), op put or delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last(changes: DataFrame) -> DataFrame:
    """One change of each path: the last by ``seq``, where there is such a column; else paths are taken as they come."""
    if "seq" not in changes.columns:
        return changes
    return changes.groupBy("path").agg(F.max_by(F.struct("op", "content", "original"), "seq").alias("x")).select("path", "x.*")


def read(files: DataFrame, changes: DataFrame) -> DataFrame:
    """path, content as a command sees them: its own puts first, its deletions gone."""
    c = last(changes).select("path", F.col("content").alias("new"), "op")
    joined = files.select("path", "content").join(c, "path", "full_outer")
    return joined.where("op is null or op <> 'delete'").select("path", F.when(F.col("op") == "put", F.col("new")).otherwise(F.col("content")).alias("content"))


def exists(paths: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """path, present: the overlay decides, then the store."""
    on_disk = files.select("path").distinct().withColumn("stored", F.lit(True))
    joined = paths.join(last(changes).select("path", "op"), "path", "left").join(on_disk, "path", "left")
    return joined.select("path", F.coalesce(F.col("op") != "delete", F.col("stored"), F.lit(False)).alias("present"))


def listed(files: DataFrame, folder: str = ".", suffix: str = "") -> DataFrame:
    """path of the files below a folder that end so; a folder that isn't there holds none."""
    below = F.lit(True) if folder in (".", "") else F.col("path").startswith(folder.rstrip("/") + "/")
    return files.where(below & F.col("path").endswith(suffix)).select("path")


def listing(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored paths that aren't deleted; new files are not listed before they are committed."""
    return files.join(last(changes).where("op = 'delete'"), "path", "left_anti").select("path")


def commit_diff(changes: DataFrame) -> DataFrame:
    """path, action of what a commit does: deletions, and puts that differ from what was read."""
    changed = ~F.col("content").eqNullSafe(F.col("original"))
    return last(changes).where((F.col("op") == "delete") | changed).select("path", F.when(F.col("op") == "delete", "deleted").otherwise("wrote").alias("action"))
