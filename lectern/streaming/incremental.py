"""Verdicts kept up to date over a stream of changed files: what changed is parsed, and what depends on it is judged again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import corpus
from lectern.operators import selectors as sel
from lectern.sources.store import NodeStore, keyed
from lectern.storage import delete, listing, release, stored

#: A change: the whole new text of a path, null where the path is deleted; of one path's changes in a batch the largest seq counts.
CHANGES = "path string, content string, seq long"


class LiveVerdicts:
    """The verdicts of a corpus of which only changes arrive.

    A document's verdict rests on its own text and on the template files that its elements name: whether they are
    there, and what they say. So a batch judges the documents that it changes, and those that name a path that it
    changes, creates or deletes; a template's own verdict plays no part in theirs, so nothing further follows. Texts
    are parsed by the node store, each once; a path that gets the text it has is no change.

    State is three tables in a folder, kept by merging on read: ``files`` (path, sha), ``uses`` (path, template_path)
    and ``verdicts``. Each batch writes its rows under its own number, one without a value for each path that it
    touches, and the newest of a path are the ones that count. A batch that Spark runs again overwrites what it wrote
    and reads only what earlier batches did, so it has the same result. ``compact`` keeps reading cheap.
    """

    TABLES = {
        "files": "path string, sha string",
        "uses": "path string, template_path string",
        "verdicts": "path string, node_id int, template_path string, type_id string, ok boolean, errors array<string>",
    }

    def __init__(self, spark: SparkSession, root: str, checks: dict[tuple[str, str], corpus.Check] | None = None, store: NodeStore | None = None):
        self.spark, self.root, self.checks = spark, root.rstrip("/"), checks or {}
        self.store = store or NodeStore(spark, f"{self.root}/store")

    def _write(self, table: str, step: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/step={step}")

    def _newest(self, table: str, before: int = 1 << 62) -> DataFrame:
        """Rows of each path's newest step; the ones without a value say that it has none."""
        kind = self.TABLES[table] + ", step long"
        if not listing(self.spark, f"{self.root}/{table}"):
            return self.spark.createDataFrame([], kind).drop("step")
        rows = self.spark.read.schema(kind).parquet(f"{self.root}/{table}").where(F.col("step") < before)
        last = F.max("step").over(Window.partitionBy("path"))
        return rows.withColumn("last", last).where("step = last").drop("step", "last")

    def apply(self, changes: DataFrame, number: int) -> dict[str, int]:
        """Take in CHANGES as batch number; how many paths changed, texts were parsed and documents judged."""
        step = 2 * number
        new = changes.groupBy("path").agg(F.max_by("content", F.struct("seq", "content")).alias("content"))
        new = keyed(new).withColumn("sha", F.when(F.col("content").isNotNull(), F.col("sha")))
        old = self._newest("files", step).select("path", F.col("sha").alias("had"))
        changed = stored(self.spark, new.join(old, "path", "left").where("not sha <=> had").drop("had"), "changed")
        parsed = self.store.add(changed.where(F.col("content").isNotNull() & sel.is_html_path("path")))
        self._write("files", step, changed.select("path", "sha"))
        now = self._newest("files", step + 1).where("sha is not null")

        named = self._newest("uses", step).join(changed.select(F.col("path").alias("template_path")), "template_path", "left_semi")
        touched = changed.select("path").union(named.select("path")).distinct()
        judged = stored(self.spark, now.where(sel.is_html_path("path")).join(touched, "path", "left_semi"), "judged")
        none = lambda table: touched.select("path", *[F.lit(None).cast(t).alias(c) for c, t in self._newest(table, 0).dtypes if c != "path"])
        uses = corpus.instances(self.store.of(judged)).select("path", "template_path").distinct()
        self._write("uses", step, uses.unionByName(none("uses")))

        asked = self._newest("uses", step + 1).join(judged, "path", "left_semi").select(F.col("template_path").alias("path"))
        keys = stored(self.spark, judged.union(now.join(asked, "path", "left_semi")).distinct(), "judged-with")
        verdicts = corpus.verdicts(keys, self.store.of(keys), self.checks).join(judged, "path", "left_semi")
        self._write("verdicts", step, verdicts.unionByName(none("verdicts")))
        counts = {"changed": changed.count(), "parsed": parsed, "judged": judged.count()}
        release(changed, judged, keys)
        return counts

    def verdicts(self) -> DataFrame:
        """path, node_id, template_path, type_id, ok, errors of every instance, as ``corpus.verdicts`` gives them."""
        return self._newest("verdicts").where("node_id is not null")

    def files(self) -> DataFrame:
        """path, sha of the files there are."""
        return self._newest("files").where("sha is not null")

    def compact(self) -> None:
        """One step in place of all so far, and no nodes of texts that no file has; between batches."""
        for table in self.TABLES:
            steps = sorted(int(x.split("=")[1]) for x in listing(self.spark, f"{self.root}/{table}") if x.startswith("step="))
            if len(steps) > 1:
                self._write(table, steps[-1] | 1, stored(self.spark, self._newest(table), "compact"))
                for step in steps:
                    if step != steps[-1] | 1:
                        delete(self.spark, f"{self.root}/{table}/step={step}")
        self.store.retain(self.files())

    def follow(self, source: str, checkpoint: str, files_at_once: int = 1000, told: Callable[[int, dict[str, int]], None] = lambda number, counts: None) -> StreamingQuery:
        """Take in the change files of a folder (Parquet, CHANGES), also those that come while it runs, until all are read."""

        def each(batch: DataFrame, number: int) -> None:
            told(number, self.apply(batch, number))

        stream = self.spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_at_once).parquet(source)
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revalidate(spark: SparkSession, source: str, schema: str, key: str, check: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new rows is checked by itself; its violations are appended with the batch's number.

    ``latest`` keeps each key's newest batch. Stops when all files there are have been read.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = check(batch).withColumn("batch", F.lit(number))
        seen = batch.select(F.col(key).alias("instance")).distinct().withColumn("batch", F.lit(number))
        seen.join(rows, ["instance", "batch"], "left").write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """The violations of each instance's newest batch."""
    newest = rows.groupBy("instance").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["instance", "batch"]).where("rule is not null")
