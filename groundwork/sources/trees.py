"""Source trees as a Spark data source: folders are the partitions, and what is not wanted is never listed or opened.

Spark's own file listing leaves out names with a leading dot and walks every folder before a filter sees one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from groundwork.functions.workers import ship

LINES = "file string, line_no int, line string"
BATCH_CHARS = 1 << 22


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    where, inside = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    return where, inside.rstrip("/") or "/"


@dataclass
class Folder(InputPartition):
    """A folder, and whether all below it belongs to the same partition."""

    path: str
    whole: bool


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.extensions = tuple(json.loads(options["extensions"]))
        self.names = frozenset(json.loads(options["names"]))
        self.skip = frozenset(json.loads(options["skip"]))
        self.most = int(options["max_bytes"])
        self.depth = int(options["depth"])

    def _listed(self, where: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Wanted folders and wanted files right below a folder, by name."""
        folders, files = [], []
        for x in sorted(where.get_file_info(fs.FileSelector(folder, recursive=False)), key=lambda x: x.path):
            if x.type == fs.FileType.Directory and x.base_name not in self.skip:
                folders.append(x.path)
            elif x.type == fs.FileType.File and (x.size or 0) <= self.most and (x.base_name in self.names or suffix(x.base_name) in self.extensions):
                files.append(x)
        return folders, files

    def partitions(self) -> list[Folder]:
        """Folders down to `depth` on their own, deeper ones with all below them. Only names down to that depth are seen here."""
        where, root = opened(self.root)
        if where.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.root}")
        found, level = [], [root]
        for _ in range(self.depth):
            found += [Folder(p, False) for p in level]
            level = [x for p in level for x in self._listed(where, p)[0]]
        return found + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        where, root = opened(self.root)
        start = len(root.rstrip("/")) + 1
        todo, rows, held = [partition.path], [], 0
        while todo:
            folders, files = self._listed(where, todo.pop())
            if partition.whole:
                todo += folders
            for x in files:
                with where.open_input_stream(x.path) as f:
                    text = f.read().decode("utf-8", errors="ignore")
                rows += [(x.path[start:], n, line) for n, line in enumerate(text.splitlines(), 1)]
                held += len(text)
                if held > BATCH_CHARS:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


def suffix(name: str) -> str:
    """From the last dot on, but not a leading one: `.env` has none, `x.env` has one."""
    at = name.rfind(".")
    return name[at:] if 0 < at < len(name) - 1 else ""


def batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    files, numbers, lines = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int32()), pa.array(lines, pa.string())], names=["file", "line_no", "line"])


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, extensions, skip_dirs, max_bytes: int = 2_000_000, names=(".env", ".env.example"), depth: int = 2) -> DataFrame:
    """(file, line_no, line) of the text files under a folder that all executors see, by path or address.

    Files with one of the extensions or exactly one of the names, dot files too; none below a folder of
    `skip_dirs`, which is not even listed, and none larger than `max_bytes`, which is not opened. Bytes that are
    not UTF-8 are left out of their line. Lines end as Python's `splitlines` has it; an empty file has none.
    Each folder down to `depth` is a task, the deepest with all below them. A missing folder is an error. The
    tree is read when the query runs, so it should not change meanwhile; links that lead upward are not detected.
    """
    ship(spark)
    spark.dataSource.register(SourceTree)
    options = {"extensions": json.dumps(list(extensions)), "names": json.dumps(list(names)), "skip": json.dumps(list(skip_dirs)), "max_bytes": max_bytes, "depth": depth}
    return spark.read.format("source_tree").options(**options).load(root)
