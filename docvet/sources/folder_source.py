"""A Spark data source for folders that every worker can reach as a path.

Spark's own file listing leaves out names that start with a dot or an underscore, and reads whole files or none. Here folders are
listed by tasks, all names are seen, filters on size and path are applied while listing, ignored folders are named but not
entered further than their own folders, and only files that may be wanted are opened.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)

SCHEMA = "root_path string, relative_path string, is_folder boolean, size_bytes bigint, content binary"
#: Folders that are listed before the rest is left to tasks, at least; files of a batch; bytes of contents in one.
PARTITIONS, BATCH_FILES, BATCH_BYTES = 64, 4_096, 32 << 20
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b, StringEndsWith: str.endswith, StringStartsWith: str.startswith, StringContains: str.__contains__,
}


@dataclass
class Folders(InputPartition):
    """Folders below the root; ``deep``: with all that is below them."""

    paths: tuple[str, ...]
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(os.path.expanduser(options["path"]))
        if not os.path.isdir(self.root):
            raise ValueError(f"Local source path is not a directory: {self.root}")
        self.ignored = frozenset(json.loads(options.get("ignorednames", "[]")))
        self.extensions = frozenset(json.loads(options.get("extensions", "[]")))
        self.most = int(options.get("maxfilebytes", 1 << 62))
        self.contents = options.get("contents", "true") == "true"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of size and path; all others are left to Spark."""
        for f in filters:
            if type(f) in _TESTS and tuple(f.attribute) in (("size_bytes",), ("relative_path",)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Folders]:
        """The upper folders, listed here until there are enough of them, and all lower ones in parts."""
        upper, open_ = [], [""]
        while open_ and len(open_) < PARTITIONS:
            upper += open_
            open_ = [os.path.join(f, e.name) for f in open_ for e in self._entries(f) if e.is_dir(follow_symlinks=False)]
        return [Folders(tuple(upper[k::8]), False) for k in range(min(8, len(upper)))] + [Folders(tuple(open_[k::PARTITIONS]), True) for k in range(min(PARTITIONS, len(open_)))]

    def _entries(self, folder: str) -> list[os.DirEntry]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            return sorted(found, key=lambda e: e.name)

    def _wanted(self, path: str, size: int | None) -> bool:
        for f in self.tests:
            value = size if tuple(f.attribute) == ("size_bytes",) else path
            if value is None or not _TESTS[type(f)](value, f.value):
                return False
        return True

    def _content(self, path: str, size: int) -> bytes | None:
        name = os.path.basename(path)
        extension = os.path.splitext(name)[1].lower()
        if not self.contents or size > self.most or (self.extensions and extension not in self.extensions) or self.ignored & set(path.split("/")):
            return None
        with open(os.path.join(self.root, path), "rb") as file:
            return file.read()

    def _rows(self, folder: str, deep: bool) -> Iterator[tuple]:
        open_ = [folder]
        while open_:
            below = []
            for entry in self._entries(open_.pop()):
                path = os.path.relpath(entry.path, self.root).replace(os.sep, "/")
                if entry.is_dir(follow_symlinks=False):
                    below.append(path)
                    if self._wanted(path, None):
                        yield self.root, path, True, None, None
                elif entry.is_file():
                    size = entry.stat().st_size
                    if self._wanted(path, size):
                        yield self.root, path, False, size, self._content(path, size)
            if deep:
                open_ += reversed(below)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.binary())
        names = ["root_path", "relative_path", "is_folder", "size_bytes", "content"]
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for folder in partition.paths:
            for row in self._rows(folder, partition.deep):
                rows.append(row)
                held += len(row[4] or b"")
                if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class FolderSource(DataSource):
    """Options: path; contents (true), maxFileBytes, extensions and ignoredNames as JSON lists: which files are opened."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)
