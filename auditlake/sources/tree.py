"""Source trees on any Hadoop file system."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.rules import LANGUAGES
from auditlake.functions.text import decode


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; scheme and host are ignored on both sides."""
    below = urlparse(root).path.rstrip("/") + "/"
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    at = F.lit(1) if below.startswith("/") else F.instr(bare, "/" + below) + 1
    return F.substring(bare, at + len(below), F.length(bare))


def _listed(spark: SparkSession, root: str, repo: str | None, sources_only: bool, skip: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if skip:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if sources_only:
        names = ",".join(ext[1:] for ext in LANGUAGES)
        reader = reader.option("pathGlobFilter", "*.{" + names + "}")
    return with_repo(reader.load(root).withColumn("path", relative_path(F.col("path"), root)), repo)


def with_repo(files: DataFrame, repo: str | None) -> DataFrame:
    """``repo`` for files by paths below the root: the one given, else the first directory."""
    if repo is not None:
        return files.withColumn("repo", F.lit(repo))
    # Files directly below the root belong to no repository.
    files = files.filter(F.contains("path", F.lit("/")))
    return files.withColumns(
        {
            "repo": F.substring_index("path", "/", 1),
            "path": F.expr("substr(path, instr(path, '/') + 1)"),
        }
    )


def load_tree(
    spark: SparkSession,
    root: str,
    repo: str | None,
    snapshot: str = "current",
    sources_only: bool = True,
    skip_unreadable: bool = False,
) -> DataFrame:
    """``files(repo, snapshot, path, content)`` of all files below ``root``, at any depth.

    Without a ``repo``, every directory directly below ``root`` is one, so a corpus of many
    is one read.  With ``sources_only`` the extension filter runs while listing, so other
    files are never opened.  A file that can't be read fails the job, as a storage outage
    would otherwise pass for a smaller corpus; with ``skip_unreadable`` such files are
    left out, and ``unread_files`` names them.
    """
    return _listed(spark, root, repo, sources_only, skip_unreadable).select(
        "repo",
        F.lit(snapshot).alias("snapshot"),
        "path",
        decode(F.col("content")).alias("content"),
    )


def unread_files(
    spark: SparkSession, root: str, repo: str | None, loaded: DataFrame, sources_only: bool = True
) -> DataFrame:
    """``(repo, path)`` of files that are listed below ``root`` but missing from ``loaded``.

    Listing reads no contents.  ``loaded`` should be a stored table: a file may be
    unreadable at one time and not at another.
    """
    listed = _listed(spark, root, repo, sources_only, True).select("repo", "path")
    return listed.join(loaded.select("repo", "path"), ["repo", "path"], "left_anti")
