"""Size and checksum of stored files of any size: a Python data source that reads in blocks."""

from __future__ import annotations

import fnmatch
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

__all__ = ["FileDigests", "file_digests"]


def open_store(path: str):
    """The pyarrow file system that ``path`` names, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _DigestReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.glob = options.get("glob", "*")
        self.block = int(options.get("blockBytes", 8 << 20))
        self.task = int(options.get("taskBytes", 1 << 30))
        if self.block < 1:
            raise ValueError("blockBytes is 1 or more")

    def partitions(self):
        """Files in name order, as many to a task as make up ``taskBytes``; a larger file has its own."""
        from pyarrow import fs
        store, root = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)
                       and not any(p.startswith((".", "_")) for p in f.path[len(root):].split("/")))
        parts, held = [], 0
        for path, size in files:
            if not parts or held + size > self.task:
                parts.append([])
                held = 0
            parts[-1].append(path)
            held += size
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition):
        store, root = open_store(self.path)
        for path in partition.paths:
            digest, size = hashlib.md5(usedforsecurity=False), 0
            with store.open_input_stream(path) as stream:
                while block := stream.read(self.block):
                    digest.update(block)
                    size += len(block)
            yield path[len(root):].lstrip("/"), size, digest.hexdigest()


class FileDigests(DataSource):
    """``spark.read.format("file_digests")``; options path, glob, blockBytes, taskBytes."""

    @classmethod
    def name(cls):
        return "file_digests"

    def schema(self):
        return "path string, length long, md5 string"

    def reader(self, schema):
        return _DigestReader(self.options)


def file_digests(spark: SparkSession, root: str, glob: str = "*", *, block_bytes: int = 8 << 20,
                 task_bytes: int = 1 << 30) -> DataFrame:
    """Q1: path under ``root``, length and md5 of every file whose name fits ``glob``.

    A task holds one block of a file at a time, so files above the 2 GB of one value are no matter.  Names
    that start with a dot or an underscore are skipped, as by Spark's own file sources."""
    spark.dataSource.register(FileDigests)
    return (spark.read.format("file_digests").option("path", root).option("glob", glob)
                 .option("blockBytes", block_bytes).option("taskBytes", task_bytes).load())
