"""The folder that the driver and all executors share, where steps write what later ones read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, where there is one machine, gets a folder of its own when that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lectern-"))
    return base.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/lectern/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def listing(spark: SparkSession, path: str, whole: bool = False) -> list[str]:
    """Names of what is at path: of a folder's entries, or with ``whole`` of the path itself; none where nothing is."""
    at, store = _path(spark, path)
    if not store.exists(at):
        return []
    return [at.getName()] if whole else [x.getPath().getName() for x in store.listStatus(at)]


def delete(spark: SparkSession, path: str) -> None:
    at, store = _path(spark, path)
    store.delete(at, True)


def release(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` has written for frames that nothing reads any more."""
    for df in frames:
        if getattr(df, "stored_at", None):
            delete(df.sparkSession, df.stored_at)
