"""Source trees listed without entering excluded directories: a Python data source.

``binaryFile`` with a recursive lookup lists every directory below the root and filters
paths afterwards, so a large or unreadable ``node_modules`` costs a listing or fails the
job.  This source never lists an excluded directory.  The driver walks directory names
down to ``split_depth`` (names only, no files); every directory at that depth is one
input partition that a task walks to the bottom, and every shallower directory is one
partition for the files directly in it.  Partitions are by directory, so the work spreads
over a cluster like the tree does, and a task that is lost is walked again by another.

File systems are those of ``pyarrow.fs`` (local, HDFS, S3, GCS), by the root's URI.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from auditlake.functions.rules import LANGUAGES
from auditlake.functions.text import decode
from auditlake.operators.inventory import EXCLUDED_DIRS
from auditlake.sources.tree import with_repo

SCHEMA = StructType([StructField("path", StringType(), False), StructField("content", BinaryType(), True)])


def _filesystem(root: str):
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _entries(filesystem, directory: str):
    from pyarrow import fs

    return filesystem.get_file_info(fs.FileSelector(directory, recursive=False))


class DirectoryPart(InputPartition):
    """A directory below the root; ``whole`` walks it to the bottom, else only its files."""

    def __init__(self, relative: str, whole: bool):
        super().__init__(relative)
        self.relative = relative
        self.whole = whole


class PrunedTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.split_depth = int(options.get("split_depth", "2"))
        self.excluded = set(filter(None, options.get("excluded", ",".join(EXCLUDED_DIRS)).split(",")))
        wanted = options.get("extensions", "")
        self.extensions = tuple(filter(None, wanted.split(","))) or None
        self.skip = options.get("skip_unreadable", "false") == "true"

    def partitions(self) -> list[DirectoryPart]:
        from pyarrow import fs

        filesystem, base = _filesystem(self.root)
        parts, level = [], [""]
        for depth in range(self.split_depth + 1):
            below = []
            for relative in level:
                if depth == self.split_depth:
                    parts.append(DirectoryPart(relative, True))
                    continue
                parts.append(DirectoryPart(relative, False))
                for entry in _entries(filesystem, f"{base}/{relative}".rstrip("/")):
                    if entry.type == fs.FileType.Directory and entry.base_name not in self.excluded:
                        below.append(f"{relative}/{entry.base_name}".lstrip("/"))
            level = below
        return parts

    def _wanted(self, name: str) -> bool:
        return self.extensions is None or name.endswith(self.extensions)

    def read(self, partition: DirectoryPart) -> Iterator[tuple[str, bytes | None]]:
        from pyarrow import fs

        filesystem, base = _filesystem(self.root)
        pending = [partition.relative]
        while pending:
            relative = pending.pop()
            for entry in _entries(filesystem, f"{base}/{relative}".rstrip("/")):
                path = f"{relative}/{entry.base_name}".lstrip("/")
                if entry.type == fs.FileType.Directory:
                    if partition.whole and entry.base_name not in self.excluded:
                        pending.append(path)
                elif self._wanted(entry.base_name):
                    # A listed entry that is neither file nor directory (a pipe, a socket)
                    # is unreadable, like one that fails to open; it is never opened.
                    try:
                        if entry.type != fs.FileType.File:
                            raise FileNotFoundError(entry.path)
                        with filesystem.open_input_stream(entry.path) as stream:
                            content = stream.read()
                    except OSError:
                        if self.skip:
                            continue
                        raise
                    yield path, content


class PrunedTree(DataSource):
    """``spark.read.format("pruned_tree").load(root)``: ``(path, content)`` below ``root``."""

    @classmethod
    def name(cls) -> str:
        return "pruned_tree"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> PrunedTreeReader:
        return PrunedTreeReader(self.options)


def load_pruned_tree(
    spark: SparkSession,
    root: str,
    repo: str | None,
    snapshot: str = "current",
    sources_only: bool = True,
    skip_unreadable: bool = False,
    split_depth: int = 2,
) -> DataFrame:
    """``files(repo, snapshot, path, content)`` below ``root``, as ``load_tree`` gives them,
    but excluded directories (``EXCLUDED_DIRS``) are never listed or opened at any depth.

    Without a ``repo``, every directory directly below ``root`` is one and files directly
    below the root belong to none. A listed file that can't be read (or isn't a regular
    file, as a pipe) fails the job; with ``skip_unreadable`` it is left out. Broken links
    aren't listed by the file system and give no row. An empty tree gives no rows; a root
    that doesn't exist fails.
    """
    spark.dataSource.register(PrunedTree)
    reader = spark.read.format("pruned_tree").option("split_depth", str(split_depth))
    reader = reader.option("skip_unreadable", str(skip_unreadable).lower())
    if sources_only:
        reader = reader.option("extensions", ",".join(LANGUAGES))
    files = with_repo(reader.load(root), repo)
    return files.select(
        "repo", F.lit(snapshot).alias("snapshot"), "path", decode(F.col("content")).alias("content")
    )
