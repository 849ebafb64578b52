"""File tables: storing them, and fetching contents by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import written

KEY = ["repo", "path"]
# Keys up to this many bytes are broadcast; more of them are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
# What a row of a hashed relation takes besides its strings.
ROW_BYTES = 100


def store_files(files: DataFrame, table: str, buckets: int) -> None:
    """Save ``files`` for later runs: hashed, bucketed and sorted by key.

    Two snapshots stored with the same number of buckets are compared, and
    contents fetched by key, without any shuffle; comparing them reads hashes
    and keys only.
    """
    (
        files.withColumn("sha256", F.sha2("content", 256))
        .write.bucketBy(buckets, *KEY)
        .sortBy(*KEY)
        .mode("overwrite")
        .saveAsTable(table)
    )


def fetch(files: DataFrame, keys: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``files`` whose (repo, path) is in ``keys``.

    A few changed paths must not make all contents move, so the keys' size is
    measured: they are broadcast if they fit the limit, and meet the files in a
    shuffled (or bucketed) semi-join if not.
    """
    kept = written(keys.select(*KEY).distinct(), "keys")
    row = F.octet_length("repo") + F.octet_length("path") + ROW_BYTES
    size = kept.agg(F.sum(row)).first()[0] or 0
    return files.join(F.broadcast(kept) if size <= limit else kept, KEY, "left_semi")
