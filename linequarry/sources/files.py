"""A tree of files as a table: path, length, modified, content (binary), through a Python data source.

Spark's own file readers leave out dot-files, files that start with ``_`` and
empty files; a search must see all of them but the hidden ones.  The tree is
listed where the query is planned, files are read in tasks of about
``batch_bytes`` each; the paths must be visible to the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .roots import root_key

SCHEMA = "path string, length bigint, modified double, content binary, error boolean"


def list_files(roots: Sequence[str], hidden: bool = False) -> tuple[list[tuple[str, int]], int]:
    """((path, size) of regular files, number of skipped hidden entries); links and special files are left out."""
    kept, skipped = [], 0
    chosen: list[str] = []
    for root in sorted(set(roots or ["."]), key=lambda r: len(root_key(r))):
        if not any(root_key(root) == root_key(c) or (os.path.isdir(c) and root_key(root).startswith(root_key(c).rstrip("/") + "/")) for c in chosen):
            chosen.append(root)
    todo = []
    for root in chosen:
        if os.path.isdir(root):
            todo.append(root)
        elif os.path.isfile(root):
            kept.append((root, os.path.getsize(root)))
    while todo:
        try:
            entries = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
        except OSError:
            skipped += 1
            continue
        for e in entries:
            if not hidden and len(e.name) > 1 and e.name[0] == "." and e.name != "..":
                skipped += 1
            elif e.is_dir(follow_symlinks=False):
                todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                kept.append((e.path, e.stat(follow_symlinks=False).st_size))
    return sorted(kept), skipped


class _Batch(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options.get("paths", ".").split("\n") if r]
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.batch = int(options.get("batch_bytes", 32 << 20))

    def partitions(self):
        out, now, size = [], [], 0
        for path, n in list_files(self.roots, self.hidden)[0]:
            now.append(path)
            size += n + 4096
            if size >= self.batch:
                out.append(_Batch(now))
                now, size = [], 0
        return [*out, _Batch(now)] if now or not out else out

    def read(self, partition) -> Iterator[tuple]:
        import os

        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    data = f.read()
                yield path, len(data), os.stat(path).st_mtime, data, False
            except OSError:
                yield path, 0, None, None, True


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "linequarry_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_files(spark: SparkSession, roots: Sequence[str], hidden: bool = False, batch_bytes: int = 32 << 20) -> DataFrame:
    """path, length, modified, content, error of every file under the roots."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FileTree)
    return spark.read.format("linequarry_files").options(paths="\n".join(roots), hidden=str(hidden).lower(), batch_bytes=str(batch_bytes)).load()


def file_texts(files: DataFrame) -> DataFrame:
    """path, length, modified, text: the byte view of each readable file, one character per byte."""
    return files.where("not error").select("path", "length", "modified", F.decode("content", "ISO-8859-1").alias("text"))
