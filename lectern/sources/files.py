"""File listings: which paths belong to a corpus, and their contents."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_FILE = ".gitignore"


def visible(path: Column | str) -> Column:
    """No part of the path starts with a dot or is node_modules."""
    x = F.col(path) if isinstance(path, str) else path
    return ~F.exists(F.split(x, "/"), lambda p: p.startswith(".") | (p == "node_modules"))


def _translated(body: str) -> str:
    """The regular expression of one glob; ** stands for folders, * ? [..] stay inside a name, \\ quotes."""
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i) and i + 2 == len(body) and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*" and (i == 0 or body[i - 1] == "/") and body[i + 1 : i + 2] in ("", "/"):
            out, i = out + "[^/]+", i + 1  # a whole name isn't empty
        elif c == "*":
            out, i = out + ("" if out.endswith("[^/]*") else "[^/]*"), i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = body[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            out += "[" + "^/" * negated + re.sub(r"([\\\[&^])", r"\\\1", inner[negated:]) + "]"
            i = end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def ignore_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(ignores, regular expression) of each line of an ignore file, in order; folders are matched with a last slash.

    A # at the beginning is a comment, ! takes back what earlier lines ignore, a slash before the end anchors, one at
    the end means folders. Letter case plays no part.
    """
    out = []
    for line in lines:
        line = re.sub(r"(?<!\\)[ \t\r]+$", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        body = line[back:]
        folder, body = body.endswith("/"), body.rstrip("/")
        if not body:
            continue
        start = "^" if "/" in body else "^(?:.*/)?"
        out.append((not back, "(?i)" + start + _translated(body.removeprefix("/")) + ("/$" if folder else "/?$")))
    return out


def is_ignored(path: str, rules: list[tuple[bool, str]]) -> bool:
    """The last rule that matches a path decides; what lies in an ignored folder can't be taken back."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        part = "/".join(parts[:n]) + ("/" if n < len(parts) else "")
        if next((ignores for ignores, p in reversed(rules) if re.search(p, part)), False):
            return True
    return False


def _folder_ignored(path: str, rules: list[tuple[bool, str]]) -> bool:
    return next((ignores for ignores, p in reversed(rules) if re.search(p, path + "/")), False)


def ignored(path: Column | str, lines: list[str]) -> Column:
    """``is_ignored`` as an expression."""
    x = F.col(path) if isinstance(path, str) else path
    rules = ignore_rules(lines)
    if not rules:
        return F.lit(False)
    parts = F.split(x, "/")

    def decided(n: Column) -> Column:
        part = F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n < F.size(parts), "/").otherwise(""))
        hits = [F.when(part.rlike(p), F.lit(ignores)) for ignores, p in reversed(rules)]
        return F.coalesce(*hits, F.lit(False))

    return F.exists(F.sequence(F.lit(1), F.size(parts)), decided)


def open_store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def _ignore_file(store: fs.FileSystem, top: str) -> tuple[str, list[tuple[bool, str]]]:
    """The folder of the nearest ignore file at or above top, and its rules; no file ignores nothing."""
    at = top
    while True:
        name = posixpath.join(at, IGNORE_FILE)
        if store.get_file_info(name).type == fs.FileType.File:
            with store.open_input_stream(name) as f:
                return at, ignore_rules(f.read().decode().splitlines())
        if posixpath.dirname(at) == at:
            return top, []
        at = posixpath.dirname(at)


class Tree:
    """What lies below a root; paths are relative to it. The nearest ignore file at or above root counts, alone.

    Names that start with a dot and node_modules are left out, but for root itself. Links are followed, but not to a
    folder that they lie in. A missing root holds nothing.
    """

    def __init__(self, root: str):
        self.store, self.top = open_store(root)
        self.there = self.store.get_file_info(self.top).type == fs.FileType.Directory
        self.base, self.rules = _ignore_file(self.store, self.top) if self.there else (self.top, [])

    def _real(self, path: str) -> str:
        return os.path.realpath(posixpath.join(self.top, path)) if isinstance(self.store, fs.LocalFileSystem) else path

    def _entries(self, folder: str) -> tuple[list[str], list[str]]:
        """Folders and files of a folder that count."""
        folders, found = [], []
        here = posixpath.join(self.top, folder) if folder else self.top
        for x in self.store.get_file_info(fs.FileSelector(here)):
            if x.base_name.startswith(".") or x.base_name == "node_modules":
                continue
            path, rel = posixpath.join(folder, x.base_name), posixpath.relpath(x.path, self.base)
            if x.type == fs.FileType.Directory and not _folder_ignored(rel, self.rules):
                folders.append(path)
            elif x.type == fs.FileType.File and not is_ignored(rel, self.rules):
                found.append(path)
        return sorted(folders), sorted(found)

    def folders(self, folder: str) -> list[str]:
        """Folders in a folder, but for links to one that it lies in."""
        if not self.there:
            return []
        above = {self._real(folder)} | {self._real(folder[:i]) for i, c in enumerate(folder) if c == "/"} | {self._real("")}
        return [x for x in self._entries(folder)[0] if self._real(x) not in above]

    def below(self, folder: str = "", deep: bool = True, wanted: Callable[[str], bool] = lambda folder: True) -> Iterator[str]:
        """Files in a folder, and with ``deep`` in the wanted folders below it."""
        todo = [folder] if self.there else []
        while todo:
            here = todo.pop()
            yield from self._entries(here)[1]
            if deep:
                todo += [x for x in self.folders(here) if wanted(x)]

    def text(self, path: str) -> str:
        with self.store.open_input_stream(posixpath.join(self.top, path)) as f:
            return f.read().decode()


def walk(root: str, suffix: str = "") -> list[str]:
    """Paths of all files of a ``Tree`` that end so, root included, sorted."""
    tree = Tree(root)
    return sorted(posixpath.join(tree.top, p) for p in tree.below() if p.endswith(suffix))


def files(spark: SparkSession, root: str, suffix: str = ".html", content: bool = True) -> DataFrame:
    """path (relative to root), content of the files there are when it is read; root is a local folder or any URI that all machines reach.

    Without content no file is opened.
    """
    from lectern.sources import datasource

    datasource.register(spark)
    rows = spark.read.format("lectern").option("content", str(content).lower()).load(root)
    return rows.where(F.col("path").endswith(suffix)) if suffix else rows
