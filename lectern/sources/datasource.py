"""A folder of files as a table, to read and to write: ``spark.read.format("lectern").load(root)``.

Reading gives path (relative to the root) and content; with the option ``content`` false no file is opened, and that is
null. The driver lists folders to a depth of ``depth`` only; each folder
there is a partition, listed and read by its task, and conditions on path (=, in, starts and ends with) decide before
that which folders are listed and which files are opened. What counts as a file is what ``files.walk`` says.

Writing takes path, content and, where there is such a column, action ('deleted' removes). It has two phases: tasks
write what they get to a folder of their own beside the corpus, hidden from readers, and when all are done the driver
moves the files to their places; a task that fails or runs again, or a job that breaks off, leaves nothing. Should the
moving itself break off, some files are new and the others as they were.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from lectern.sources import files

#: Bytes of texts that a reading task sends on at once, about.
BATCH_BYTES = 8 << 20


@dataclass
class Wanted:
    """Conditions on paths, all of which must hold."""

    exact: set[str] | None = None
    starts: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the condition is one that this can see to; it is then held to."""
        if getattr(f, "attribute", None) != ("path",):
            return False
        if isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.exact = values if self.exact is None else self.exact & values
        elif isinstance(f, StringStartsWith):
            self.starts.append(f.value)
        elif isinstance(f, StringEndsWith):
            self.ends.append(f.value)
        else:
            return False
        return True

    def file(self, path: str) -> bool:
        return (self.exact is None or path in self.exact) and all(path.startswith(x) for x in self.starts) and all(path.endswith(x) for x in self.ends)

    def folder(self, path: str) -> bool:
        """Whether a folder can hold such files."""
        inside = path + "/"
        return (self.exact is None or any(x.startswith(inside) for x in self.exact)) and all(x.startswith(inside) or inside.startswith(x) for x in self.starts)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with all that is below it


class Reader(DataSourceReader):
    def __init__(self, root: str, depth: int, content: bool):
        self.root, self.depth, self.content, self.wanted = root, depth, content, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Folder]:
        tree, level, out = files.Tree(self.root), [""], []
        for _ in range(self.depth):
            out += [Folder(f, False) for f in level]
            level = [x for f in level for x in tree.folders(f) if self.wanted.folder(x)]
        return out + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        tree, rows, size = files.Tree(self.root), [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["path", "content"])
        for path in tree.below(partition.path, partition.deep, self.wanted.folder):
            if self.wanted.file(path):
                rows.append((path, tree.text(path) if self.content else None))
                size += len(path) + len(rows[-1][1] or "")
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str | None, str]]  # where a file is staged (None: to be deleted), and its path


class Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f".staged-{uuid.uuid4().hex}"
        store, top = files.open_store(root)
        store.create_dir(posixpath.join(top, self.staging), recursive=True)

    def write(self, iterator: Iterator) -> Staged:
        store, top = files.open_store(self.root)
        own = posixpath.join(top, self.staging, str(TaskContext.get().taskAttemptId()))
        store.create_dir(own, recursive=False)  # fails where the write is given up: its folder is gone
        out = []
        for n, row in enumerate(iterator):
            if "action" in row and row["action"] == "deleted":
                out.append((None, row["path"]))
                continue
            at = posixpath.join(own, str(n))
            with store.open_output_stream(at) as f:
                f.write((row["content"] or "").encode())
            out.append((at, row["path"]))
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        store, top = files.open_store(self.root)
        listed = [x for m in messages if m is not None for x in m.files]
        for folder in sorted({posixpath.dirname(p) for at, p in listed if at is not None}):
            store.create_dir(posixpath.join(top, folder), recursive=True)
        for at, path in listed:
            goal = posixpath.join(top, path)
            if at is None:
                store.delete_file(goal)
            else:
                store.move(at, goal)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, top = files.open_store(self.root)
        at = posixpath.join(top, self.staging)
        if store.get_file_info(at).type == stores.FileType.Directory:
            store.delete_dir(at)


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("depth", "1")), self.options.get("content", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are replaced one by one: mode must be append")
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
