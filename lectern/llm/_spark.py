"""What the operators share: input tables, the shared folder, and text scans."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import storage

from . import textvec as tv

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write to the shared folder and read back; delete what has been written so.
materialize, release = storage.stored, storage.release


def extend(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """A materialized frame with more rows, written beside its own, so that it stays one scan."""
    rows.write.mode("append").parquet(stored.stored_at)
    out = stored.sparkSession.read.schema(stored.schema).parquet(stored.stored_at)
    out.stored_at = stored.stored_at
    return out


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers stay, and share their executor's room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(fn: Callable) -> Callable:
    """fn over batches that gives memory back when its task ends."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, tv.Slice]]:
    for batch in batches:
        for s in tv.slices(batch.column(text)):
            yield batch.slice(s.first, s.n), s


def map_text(df: DataFrame, ids: list[str], text: str, schema: str, fn: Callable) -> DataFrame:
    """fn(rows, slice) -> dict of arrays of the columns after the ids, for each slice of whole texts.

    Only the ids and the text are read; other columns, whatever their names, play no part.
    """
    keep = df.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"_id{i} {kind}" for i, (_, kind) in enumerate(keep.dtypes[:-1]))

    def run(batches):
        for batch, s in text_slices(batches, "_text"):
            out = fn(s)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out.values())],
                names=[*(f"_id{i}" for i in range(len(cols))), *out],
            )

    out = keep.mapInArrow(tidy(run), ", ".join(x for x in (fields, schema) if x))
    for i, c in enumerate(ids):
        out = out.withColumnRenamed(f"_id{i}", c)
    return out
