"""Which files a run visits: all, those changed since a base snapshot, or a given list.

Decisions are taken on keys and hashes alone.  Contents are fetched at the end,
and never meet the change computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.inventory import in_excluded_dir
import uuid

from auditlake.sources.tables import KEY, fetch, store_files

# A repo may hold a third of all files: per-repo facts meet its files under this many salts.
SALTS = 32


def _hashed(files: DataFrame, name: str) -> DataFrame:
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    return files.select(*KEY, digest.alias(name))


def changes(current: DataFrame, base: DataFrame) -> DataFrame:
    """``repo, path, status`` with status added, deleted, modified or same."""
    joined = _hashed(current, "now").join(_hashed(base, "was"), KEY, "full_outer")
    status = (
        F.when(F.col("was").isNull(), F.lit("added"))
        .when(F.col("now").isNull(), F.lit("deleted"))
        .when(F.col("now") != F.col("was"), F.lit("modified"))
        .otherwise("same")
    )
    return joined.select(*KEY, status.alias("status"))


def stored(files: DataFrame, label: str, buckets: int) -> DataFrame:
    """``files`` saved as a table of the warehouse, bucketed and sorted by key, and read back.

    The name is fresh for every call, so runs don't overwrite each other's snapshots.
    """
    name = f"{label}_{uuid.uuid4().hex}"
    store_files(files, name, buckets)
    return files.sparkSession.table(name)


def stored_changes(current: DataFrame, base: DataFrame) -> DataFrame:
    """``changes`` of two stored snapshots: with the same buckets on both sides, the full
    outer join reads keys and hashes bucket by bucket and moves no row between tasks."""
    return changes(current.select(*KEY, "sha256"), base.select(*KEY, "sha256"))


def _with_repo_flag(keys: DataFrame, repos: DataFrame) -> DataFrame:
    """Join per-repo rows to file keys, spreading each repo over salts of its paths."""
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    spread = repos.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["repo", "salt"], "left").drop("salt")


def full_scan_set(files: DataFrame) -> DataFrame:
    return files.filter(~in_excluded_dir(F.col("path")))


def incremental_scan_set(current: DataFrame, base: DataFrame) -> DataFrame:
    """Files of ``current`` to scan, given what changed since ``base``.

    A repo with changes has its added and modified files scanned, excluded
    directories included.  A repo without changes or without a base snapshot is
    scanned in full.
    """
    changed = changes(current, base)
    repos = changed.groupBy("repo").agg(
        (
            F.bool_or(F.col("status") != "added") & F.bool_or(F.col("status") != "same")
        ).alias("partial")
    )
    present = changed.filter(F.col("status") != "deleted")
    keys = _with_repo_flag(present, repos)
    return fetch(current, keys.filter(_visited(F.col("status") != "same")))


def _visited(wanted: Column) -> Column:
    partial = F.coalesce(F.col("partial"), F.lit(False))
    return F.when(partial, wanted).otherwise(~in_excluded_dir(F.col("path")))


def listed_scan_set(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files of ``files`` to scan, given ``paths(repo, path)``.

    A repo with listed paths has exactly those scanned, excluded directories
    included; a repo with none listed is scanned in full.
    """
    listed = paths.select(*KEY).distinct().withColumn("listed", F.lit(True))
    repos = paths.select("repo").distinct().withColumn("partial", F.lit(True))
    keys = _with_repo_flag(files.select(*KEY).join(listed, KEY, "left"), repos)
    return fetch(files, keys.filter(_visited(F.coalesce("listed", F.lit(False)))))
