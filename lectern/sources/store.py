"""Parsed documents kept by what they say: a store of nodes under the hash of their text.

A text is parsed once, whatever files hold it and however often they are asked for: files are joined with the hashes
that the store has, only the others are parsed, and what they give is appended. The store is a table of a fixed number
of buckets of the hash, so joining files with it moves the files' hashes, never the nodes; columns and rows that a
query doesn't want stay unread. Nodes whose text no file holds any more go with ``retain``, by reference.

A store is a folder: versions ``v0``, ``v1``, ... of the table, of which the last complete one counts. Appending is
one job, which Spark commits as a whole; ``retain`` writes the next version beside the last and then drops that, so
whatever breaks off leaves a store that is right. One writer at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import selectors as sel
from lectern.sources import html
from lectern.storage import delete, listing, release, shared_dir, stored

#: A text's own row, which stands for it where it has no nodes.
TEXT = "text of"
_COLUMNS = html.NODES.replace(" end int", " `end` int")


def keyed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with sha: of the text, a null one as an empty one."""
    return files.withColumn("sha", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256))


class NodeStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, f"{root.rstrip('/')}/nodes-{buckets}", buckets
        done = [int(name[1:]) for name in listing(spark, self.root) if name[:1] == "v" and listing(spark, f"{self.root}/{name}/_SUCCESS", whole=True)]
        self.version = max(done, default=0)
        self._open()

    def _at(self, version: int) -> tuple[str, str]:
        where = f"{self.root}/v{version}"
        return "lectern_nodes_" + hashlib.md5(where.encode()).hexdigest(), where

    def _open(self) -> None:
        self.table, where = self._at(self.version)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (sha STRING, {_COLUMNS}) USING parquet CLUSTERED BY (sha) SORTED BY (sha) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        self.spark.catalog.refreshTable(self.table)

    def _append(self, rows: DataFrame, table: str) -> None:
        rows = rows.repartition(self.buckets, "sha").sortWithinPartitions("sha", "node_id")
        rows.select(*self.spark.table(table).columns).write.mode("append").insertInto(table)
        self.spark.catalog.refreshTable(table)

    def hashes(self) -> DataFrame:
        """sha of every text that the store has."""
        return self.spark.table(self.table).where(F.col("kind") == TEXT).select("sha")

    def add(self, files: DataFrame, content: str = "content") -> int:
        """Parse the texts that the store doesn't have; how many there were."""
        new = keyed(files, content).join(self.hashes(), "sha", "left_anti")
        if not new.limit(1).count():
            return 0
        new = stored(self.spark, new.groupBy("sha").agg(F.first(content).alias("content")), "new-texts")
        rows = html.nodes(new, "sha", "content", whole=True)
        own = new.select("sha").withColumns({c: F.lit(TEXT).cast(t) if c == "kind" else F.lit(-1 if c == "node_id" else None).cast(t) for c, t in rows.dtypes if c != "sha"})
        self._append(rows.unionByName(own), self.table)
        n = new.count()
        release(new)
        return n

    def of(self, keys: DataFrame) -> DataFrame:
        """path and the nodes of keys(path, sha); those of texts that the store lacks are not there."""
        return keys.select("path", "sha").join(self.spark.table(self.table).where(F.col("kind") != TEXT), "sha").drop("sha")

    def nodes(self, files: DataFrame) -> DataFrame:
        """path and nodes of the HTML documents of files(path, content), as ``corpus.nodes`` gives them."""
        documents = files.where(sel.is_html_path("path"))
        self.add(documents)
        return self.of(keyed(documents))

    def retain(self, files: DataFrame) -> int:
        """Drop what no file of files(path, content) or (path, sha) refers to; how many texts went."""
        held = (files if "sha" in files.columns else keyed(files)).select("sha").distinct()
        gone = self.hashes().join(held, "sha", "left_anti").count()
        if gone:
            old_table, old = self.table, self._at(self.version)[1]
            kept = self.spark.table(self.table).join(held, "sha", "left_semi")
            self.version += 1
            self._open()
            self._append(kept, self.table)
            self.spark.sql(f"DROP TABLE IF EXISTS {old_table}")
            delete(self.spark, old)
        return gone

    def dispose(self) -> None:
        """Delete the store."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.root)


def session_store(spark: SparkSession) -> NodeStore:
    """The store in the shared folder, which all queries of an application use."""
    return NodeStore(spark, f"{shared_dir(spark)}/lectern/store-{spark.sparkContext.applicationId}")
