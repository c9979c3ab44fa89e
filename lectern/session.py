"""What a command works with: the corpus' files with its own changes over them, its arguments, and helpers."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field

from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import registry
from lectern.functions import markup
from lectern.operators import corpus, overlay
from lectern.sources import datasource, html
from lectern.sources.files import open_store
from lectern.storage import stored

DOCTYPE = "<!DOCTYPE html>\n"


@dataclass
class Document:
    """A document in a command's hands: its markup, free to be changed."""

    html: str


@dataclass
class _Held:
    """What a command has done to a path: the document (None: deleted), and the laid-out markup that it was read as (None: it is new)."""

    document: Document | None
    read_as: str | None = None


class Filesystem:
    """The files of a corpus as one command sees them: an overlay of its own changes on what is stored.

    Documents that it asks for are held until ``commit``, which writes those that differ from what was read. They are
    laid out when they are read and again when they are written, so a difference in layout alone is none. Only what a
    command asks for comes to the driver.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, root: str):
        self.spark, self.files, self.root = spark, files, root
        self._held: dict[str, _Held] = {}

    def changes(self) -> DataFrame:
        """path, op, content, original of what is held, as ``overlay`` takes it."""
        rows = [(p, "delete", None, None) if h.document is None else (p, "put", markup.serialize(h.document.html, indent=True), h.read_as) for p, h in self._held.items()]
        return self.spark.createDataFrame(rows, "path string, op string, content string, original string")

    def _take(self, files: DataFrame) -> None:
        """Hold the documents of files(path, content) that aren't held, in one query."""
        for r in overlay.read(files.where(~F.col("path").isin(*self._held)), self.changes()).where(~F.col("path").isin(*self._held)).collect():
            laid = markup.serialize(r.content, indent=True)
            self._held[r.path] = _Held(Document(laid), laid)

    def get(self, path: str) -> Document:
        if path not in self._held:
            self._take(self.files.where(F.col("path") == path))
        held = self._held.get(path)
        if held is None or held.document is None:
            raise FileNotFoundError(path if held is None else f"{path} was already deleted")
        return held.document

    def create(self, path: str, seed: str = "") -> Document:
        """A new document in place of whatever was there; it is written in any case."""
        self._held[path] = _Held(Document(seed))
        return self.get(path)

    def delete(self, path: str) -> None:
        self._held[path] = _Held(None)

    def exists(self, path: str) -> bool:
        asked = self.spark.createDataFrame([(path,)], "path string")
        return overlay.exists(asked, self.files.where(F.col("path") == path), self.changes()).first().present

    def paths(self, folder: str = ".") -> DataFrame:
        """path of the stored documents below a folder that aren't deleted; what isn't committed yet isn't listed."""
        return overlay.listing(overlay.listed(self.files, folder, ".html"), self.changes())

    def list(self, folder: str = ".") -> dict[str, Document]:
        """The documents of ``paths``, in order of path, held like those of ``get``."""
        found = sorted(r.path for r in self.paths(folder).collect())
        self._take(self.files.where(F.col("path").isin(*found)))
        return {p: self._held[p].document for p in found}

    def commit(self, told: Callable[[str, str], None] = lambda action, path: None) -> list[str]:
        """Paths written, in order of path; a second call without further changes writes nothing. told: each action, by path."""
        done = sorted(commit(self.spark, self.changes(), self.root).collect())
        for r in done:
            told(r.action, r.path)
        for path, held in list(self._held.items()):
            if held.document is None:
                del self._held[path]
            else:
                held.read_as = markup.serialize(held.document.html, indent=True)
        return [r.path for r in done if r.action == "wrote"]


def commit(spark: SparkSession, changes: DataFrame, root: str) -> DataFrame:
    """path, action of what is done below root: deletions, and documents that differ from their original.

    Files are staged by the tasks and moved when all are there (``datasource``): what fails before that changes nothing.
    Deleting what isn't there is an error.
    """
    todo = stored(spark, overlay.last(changes).join(overlay.commit_diff(changes), "path").select("path", "action", F.concat(F.lit(DOCTYPE), "content", F.lit("\n")).alias("content")), "commit")
    write_files(todo, root)
    return todo.select("path", "action")


def write_files(todo: DataFrame, root: str) -> None:
    """Write, or delete, todo(path, content[, action]) below root: all of it, or nothing if a task fails."""
    datasource.register(todo.sparkSession)
    todo.write.format("lectern").mode("append").save(root)


@dataclass
class Tools:
    """Helpers for commands: checks, input, parsing, links."""

    validate: Callable[[str, str], dict]
    read_stdin: Callable[[], str] = registry.read_stdin
    parse_html: Callable[[str], list[list]] = lambda source: html.parse(source, whole=True)
    href: Callable[[str, str], str] = lambda a, b: (lambda p: p if p.startswith(".") else "./" + p)(posixpath.relpath("/" + b, posixpath.dirname("/" + a)))


@dataclass
class Context:
    fs: Filesystem
    args: dict[str, object]
    cli: Tools
    spark: SparkSession | None = None


def validate_document(spark: SparkSession, files: DataFrame, known: registry.Registry, source: str, path: str) -> dict:
    """{ok, errors} of the instances in a document that isn't stored (yet) at path; nothing raises.

    Only the document and the template files that it names are read and parsed.
    """
    mine = spark.createDataFrame([(path, source)], "path string, content string")
    named = [r.template_path for r in corpus.instances(corpus.nodes(mine)).select("template_path").distinct().collect()]
    if not named:
        return {"ok": False, "errors": ["missing data-conforms-to attribute"]}
    all_ = mine.unionByName(files.where(F.col("path").isin(*named) & (F.col("path") != path)).select("path", "content"))
    rows = corpus.verdicts(all_, corpus.nodes(all_), known.checks).where(F.col("path") == path).orderBy("node_id").collect()
    return {"ok": all(r.ok for r in rows), "errors": [e for r in rows for e in r.errors]}


def arguments(row) -> dict[str, object]:
    """A command's arguments from a row of ``commands.resolve``: {'_': [...], flag: value or list of values}."""
    return {**{f.k: f.v[0] if len(f.v) == 1 else list(f.v) for f in row.flags}, "_": list(row.rest)}


@dataclass
class Sandbox:
    """A corpus in a folder of its own, for tests: write and read files, run commands against it."""

    spark: SparkSession
    dir: str
    known: registry.Registry = field(default_factory=registry.Registry)

    def write(self, path: str, content: str) -> None:
        store, top = open_store(self.dir)
        goal = posixpath.join(top, path)
        store.create_dir(posixpath.dirname(goal), recursive=True)
        with store.open_output_stream(goal) as f:
            f.write(content.encode())

    def read(self, path: str) -> str:
        store, top = open_store(self.dir)
        with store.open_input_stream(posixpath.join(top, path)) as f:
            return f.read().decode()

    def exists(self, path: str) -> bool:
        store, top = open_store(self.dir)
        return store.get_file_info(posixpath.join(top, path)).type == stores.FileType.File

    def run(self, *argv: str) -> dict:
        """{ok, status, stdout, stderr} of a command line."""
        from lectern import cli

        out, err = [], []
        status = cli.run(self.spark, list(argv), self.dir, self.known, out.append, err.append)
        return {"ok": status == 0, "status": status, "stdout": "\n".join(out), "stderr": "\n".join(err)}

