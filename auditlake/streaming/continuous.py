"""The incremental scan as a stream: new files arrive, their findings are appended.

Rules run inside the file's row, so the plain query keeps no state and needs no
watermark. The changed-only query keeps a small entry per file: the hash of its last
content, so an arrival that repeats it emits nothing and one that changes it emits the
file's new findings under a new version. The entries lie in keyed state by bucket of files,
as a call to Python for every single file costs milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from auditlake.operators.inventory import source_files
from auditlake.operators.scan import findings, scan_files


def stream_rows(spark: SparkSession, where: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", str(files_per_trigger))
        .parquet(where)
    )


def stream_findings(files: DataFrame) -> DataFrame:
    """Findings of a streaming (or batch) ``files(repo, path, content)``.

    Paths that arrive are scanned wherever they lie, like any changed file.
    """
    return findings(scan_files(source_files(files, prune=False)))


def append_available(found: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what has arrived, exactly once, into a parquet table."""
    query = (
        found.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()


def keep_severity_totals(
    found: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Running totals per severity, handed to ``write`` after each batch."""
    query = (
        found.groupBy("severity")
        .count()
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


CHANGED_SCHEMA = "repo string, path string, content string, sha256 string, version long"
CHANGED_COLUMNS = ["repo", "path", "content", "sha256", "version"]
STATE_SCHEMA = "repo array<string>, path array<string>, sha256 array<string>, version array<long>"
BUCKETS = 4096


def _emit_changed(order: str):
    def emit(key, frames, state: GroupState):
        last = {}
        if state.exists:
            repos, paths, hashes, versions = state.get
            last = dict(zip(zip(repos, paths), zip(hashes, versions)))
        # A bucket's arrivals may come in several frames; a file's are in order only over all of them.
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        kept, numbers = [], []
        for i, (repo, path, sha256) in enumerate(zip(rows["repo"], rows["path"], rows["sha256"])):
            before, version = last.get((repo, path), (None, 0))
            if version and before == sha256:
                continue
            last[repo, path] = sha256, version + 1
            kept.append(i)
            numbers.append(version + 1)
        if kept:
            keys, entries = zip(*last), zip(*last.values())
            state.update(tuple(map(list, (*keys, *entries))))
        yield rows.iloc[kept].assign(version=numbers)[CHANGED_COLUMNS]

    return emit


def changed_only(files: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Of ``files(repo, path, content, <order>)``, streaming or not, the arrivals whose content
    differs from the one before of the same (repo, path), numbered by ``version`` from 1.

    Keyed state holds the last content's sha256 and version per file, not the content, so it
    grows with the number of files and not with their sizes or arrivals. Its keys are ``buckets``
    (``BUCKETS`` if none are given) of files by hash: a batch reads the buckets that its arrivals fall into, writes those
    in which a file changed, and a task holds a bucket's arrivals of the batch. ``buckets``
    stays as it is for the life of a checkpoint location; very many files want more of them. Within a
    batch the arrivals of a file are taken by ``order``. A null content is a content like any other
    (two nulls in a row are one). The state is kept in the query's checkpoint location.
    """
    bucket = F.pmod(F.xxhash64("repo", "path"), F.lit(buckets or BUCKETS)).alias("state_bucket")
    hashed = files.select("repo", "path", "content", F.sha2("content", 256).alias("sha256"), order, bucket)
    return hashed.groupBy("state_bucket").applyInPandasWithState(
        _emit_changed(order), CHANGED_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def changed_findings(changed: DataFrame) -> DataFrame:
    """Findings of changed files, with the version they belong to."""
    return findings(scan_files(source_files(changed, prune=False), "version"), "version")


def keep_changed(files: DataFrame, order: str, sink: str, checkpoint: str) -> None:
    """Process what has arrived: changed files to ``sink/versions``, their findings to
    ``sink/findings``. Each batch is written under its own id, so a batch run again after a
    failure replaces its own output and nothing is doubled."""
    changed = changed_only(files, order)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.select("repo", "path", "sha256", "version").write.mode("overwrite").parquet(
            f"{sink}/versions/batch={batch_id}"
        )
        changed_findings(kept).write.mode("overwrite").parquet(f"{sink}/findings/batch={batch_id}")
        kept.unpersist()

    query = (
        changed.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_findings(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The findings of each file's latest version: a changed file's findings replace those of
    its versions before, also when it has none any more."""
    versions = spark.read.parquet(f"{sink}/versions").groupBy("repo", "path").agg(F.max("version").alias("version"))
    found = spark.read.parquet(f"{sink}/findings").select(*schema.fieldNames())
    return found.join(versions, ["repo", "path", "version"], "left_semi")
