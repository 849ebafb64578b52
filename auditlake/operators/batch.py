"""Ordered edits: every plan of a file sees the result of the plan before it.

The order inside one file is part of the meaning, so a file's plans are walked
by one task.  That walk is kept to what must be sequential: it streams over
sorted rows, holds one content at a time however many plans a file has, and
writes a small edit record per plan (how much of the text is kept at both ends
and what stands between), with the full text only at the head of a segment of
versions.  What costs more - contents of all versions, hashes, diffs - is
replayed afterwards per (file, segment), so the versions of one much edited
file are spread over the cluster.  Segments double in length after every
``SPREAD`` of them: full texts in the log grow with the logarithm of a file's
edits, not with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.edits import (
    EXTRACT_FUNCTION,
    INLINE_FIX,
    RENAME,
    RESTRUCTURE,
    STRATEGIES,
)
from auditlake.functions.udiff import diff_text
from auditlake.sources.tables import fetch

# Versions in each of a file's first SPREAD segments.
SEGMENT = 64
SPREAD = 64
# A worker hands on its rows once they hold about this many characters.
FLUSH_CHARS = 4_000_000
FLUSH_ROWS = 2_000

LOG_SCHEMA = (
    "repo string, path string, seq int, plan_key string, step string, version int, segment int, "
    "base string, keep_head int, keep_tail int, inserted string, "
    "is_outcome boolean, success boolean, rolled_back boolean, error string, output string"
)
_LOG_ARROW = pa.schema(
    [
        ("repo", pa.string()),
        ("path", pa.string()),
        ("seq", pa.int32()),
        ("plan_key", pa.string()),
        ("step", pa.string()),
        ("version", pa.int32()),
        ("segment", pa.int32()),
        ("base", pa.string()),
        ("keep_head", pa.int32()),
        ("keep_tail", pa.int32()),
        ("inserted", pa.string()),
        ("is_outcome", pa.bool_()),
        ("success", pa.bool_()),
        ("rolled_back", pa.bool_()),
        ("error", pa.string()),
        ("output", pa.string()),
    ]
)
_VERSION_ARROW = pa.schema(
    [
        ("repo", pa.string()),
        ("path", pa.string()),
        ("version", pa.int32()),
        ("seq", pa.int32()),
        ("plan_key", pa.string()),
        ("step", pa.string()),
        ("before", pa.string()),
        ("content", pa.string()),
    ]
)
_OUTCOME_ARROW = pa.schema(
    [
        ("repo", pa.string()),
        ("path", pa.string()),
        ("seq", pa.int32()),
        ("plan_key", pa.string()),
        ("success", pa.bool_()),
        ("rolled_back", pa.bool_()),
        ("diff", pa.string()),
        ("error", pa.string()),
    ]
)


@dataclass(frozen=True)
class Change:
    """A text change: what is kept at both ends, and what stands between."""

    keep_head: int
    keep_tail: int
    inserted: str

    def on(self, text: str) -> str:
        return text[: self.keep_head] + self.inserted + text[len(text) - self.keep_tail :]


def _unchanged(text: str) -> Change:
    return Change(len(text), 0, "")


def _change(
    text: str, strategy: str, original: str, target: str, start: int, end: int, search_from: int = 0
) -> Change:
    """``search_from``: where a first occurrence of ``original`` can start at the earliest."""
    if strategy == RESTRUCTURE:
        rows = text.split("\n")
        head = min(len("\n".join(rows[: start - 1])) + 1, len(text)) if start > 1 else 0
        tail = len("\n".join(rows[end:])) + 1 if end < len(rows) else 0
        # A range that starts past the end, or that resumes before it starts,
        # repeats text or adds line ends: it is no plain cut.
        if head + tail > len(text) or (start > 1 and start - 1 >= len(rows)):
            before = "\n".join(rows[: start - 1]) + "\n" if start > 1 else ""
            after = "\n" + "\n".join(rows[end:]) if end < len(rows) else ""
            return Change(0, 0, before + target + after)
        return Change(head, tail, target)
    first = text.find(original, search_from)
    if first < 0:
        return _unchanged(text)
    if strategy == RENAME:
        last = text.rfind(original) + len(original)
        return Change(first, len(text) - last, text[first:last].replace(original, target))
    return Change(first, len(text) - first - len(original), target)


def _incomplete(row: dict) -> bool:
    needed = (
        ("line_start", "line_end") if row["strategy"] == RESTRUCTURE else ("original_snippet",)
    )
    return row["target_snippet"] is None or any(row[name] is None for name in needed)


class _Out:
    """Collects rows and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.chars += sum(len(v) for v in row.values() if isinstance(v, str))

    def full(self) -> bool:
        return self.chars > FLUSH_CHARS or len(self.rows) >= FLUSH_ROWS

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.chars = [], 0
        return batch


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of small slices, so that few of them exist as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield from batch.slice(start, 64).to_pylist()


def _walker(run_tests: bool, auto_rollback: bool, segment_size: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(_LOG_ARROW)
        file, text, previous, version, segment, room = None, None, None, 0, -1, 0
        searched, search_from = None, 0

        def record(row: dict, step: str, change: Change, **verdict) -> str:
            nonlocal previous, version, segment, room
            head = room == 0
            if head:
                segment += 1
                room = segment_size << (segment // SPREAD)
            room -= 1
            out.add(
                repo=row["repo"],
                path=row["path"],
                seq=row["seq"],
                plan_key=row["plan_key"],
                step=step,
                version=version + 1,
                segment=segment,
                base=text if head else None,
                keep_head=change.keep_head,
                keep_tail=change.keep_tail,
                inserted=change.inserted,
                **verdict,
            )
            version += 1
            previous = text
            return change.on(text)

        def close() -> None:
            """The file's last state, and the state before its last edit."""
            if version:
                out.add(
                    repo=file[0],
                    path=file[1],
                    step="final",
                    version=version,
                    base=previous,
                    inserted=text,
                    is_outcome=False,
                )

        for row in _rows(batches):
            if (row["repo"], row["path"]) != file:
                close()
                file = (row["repo"], row["path"])
                text, previous, version, segment, room = None, None, 0, -1, 0
                searched = None
            if row["is_file"]:
                if text is not None:
                    raise ValueError(f"two contents for {file}: choose one snapshot")
                text = row["content"]
                continue
            strategy = row["strategy"]
            if text is None:
                out.add(
                    repo=row["repo"],
                    path=row["path"],
                    seq=row["seq"],
                    plan_key=row["plan_key"],
                    step="edit",
                    is_outcome=True,
                    success=False,
                    rolled_back=False,
                    error=f"Cannot refactor: {row['path']} not found",
                )
            elif strategy not in STRATEGIES or _incomplete(row):
                unknown = strategy not in STRATEGIES
                text = record(
                    row,
                    "edit",
                    _unchanged(text),
                    is_outcome=True,
                    success=False,
                    rolled_back=False,
                    error=f"Unknown strategy: {strategy}" if unknown else "Incomplete plan",
                )
            else:
                original, target = row["original_snippet"] or "", row["target_snippet"]
                bounds = row["line_start"], row["line_end"]
                # Runs of one snippet are common.  Whatever replaced its first occurrence,
                # the next one cannot lie wholly before that place.
                first_only = strategy in (INLINE_FIX, EXTRACT_FUNCTION)
                if not first_only or original != searched:
                    search_from = 0
                change = _change(text, strategy, original, target, *bounds, search_from)
                searched = original if first_only and original else None
                search_from = max(0, change.keep_head - len(original) + 1)
                failed = run_tests and row["passed"] is False
                if failed and auto_rollback and strategy == RESTRUCTURE:
                    done = dict(success=True, rolled_back=False, error=None, output=row["output"])
                    text = record(row, "edit", change, is_outcome=False, **done)
                    simple = _change(
                        text, INLINE_FIX, original.split("\n")[0], target.split("\n")[0], *bounds
                    )
                    text = record(row, "degraded", simple, is_outcome=True, **done)
                elif failed and auto_rollback:
                    text = record(
                        row,
                        "edit",
                        _unchanged(text),
                        is_outcome=True,
                        success=True,
                        rolled_back=True,
                        error=None,
                        output=row["output"],
                    )
                else:
                    text = record(
                        row,
                        "edit",
                        change,
                        is_outcome=True,
                        success=not failed,
                        rolled_back=False,
                        error=f"Tests failed: {(row['output'] or '')[:200]}" if failed else None,
                        output=row["output"],
                    )
            if out.full():
                yield out.flush()
        close()
        yield out.flush()

    return walk


def one_verdict(verdicts: DataFrame) -> DataFrame:
    """One row per plan: whether every run passed, and the output of one that did not.

    A run without a result did not fail.
    """
    failed = ~F.coalesce("passed", F.lit(True))
    return verdicts.groupBy("plan_key").agg(
        (~F.bool_or(failed)).alias("passed"),
        F.coalesce(F.min(F.when(failed, F.col("output"))), F.min("output")).alias("output"),
    )


def edit_log(
    files: DataFrame,
    plans: DataFrame,
    verdicts: DataFrame | None = None,
    run_tests: bool = True,
    auto_rollback: bool = True,
    segment_size: int = SEGMENT,
) -> DataFrame:
    """Apply ``plans`` to ``files`` in ``seq`` order; one log row per edit made.

    ``verdicts(plan_key, passed, output)`` tells how the tests went after a plan;
    a plan without a verdict passes, and one with several passes if all of them do.
    ``files`` holds one snapshot; two rows for a file end the job.
    The log keeps the whole output; errors quote its start.  Only files that have plans
    are shuffled, each content once.
    """
    judged = plans.select(
        "repo",
        "path",
        "seq",
        "plan_key",
        "strategy",
        "original_snippet",
        "target_snippet",
        "line_start",
        "line_end",
    )
    if verdicts is not None and run_tests:
        judged = judged.join(one_verdict(verdicts), "plan_key", "left")
    planned = fetch(files, plans)
    feed = (
        planned.select("repo", "path", "content", F.lit(True).alias("is_file"))
        .unionByName(judged.withColumn("is_file", F.lit(False)), allowMissingColumns=True)
    )
    for name, kind in (("passed", "boolean"), ("output", "string")):
        if name not in feed.columns:
            feed = feed.withColumn(name, F.lit(None).cast(kind))
    ordered = feed.repartition("repo", "path").sortWithinPartitions(
        "repo", "path", F.desc("is_file"), "seq", "plan_key"
    )
    return ordered.mapInArrow(_walker(run_tests, auto_rollback, segment_size), LOG_SCHEMA)


def _replayer(schema: pa.Schema, emit):
    """Walk log rows of a (file, segment) from its base text, handing each version to ``emit``."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        text = None
        for row in _rows(batches):
            before = None
            if row["version"] is not None:
                before = text if row["base"] is None else row["base"]
                text = Change(row["keep_head"], row["keep_tail"], row["inserted"]).on(before)
            emit(out, row, before, text)
            if out.full():
                yield out.flush()
        yield out.flush()

    return replay


def _emit_version(out: _Out, row: dict, before: str, content: str) -> None:
    kept = {k: row[k] for k in ("repo", "path", "version", "seq", "plan_key", "step")}
    out.add(**kept, before=before, content=content)


def _emit_outcome(out: _Out, row: dict, before: str | None, content: str | None) -> None:
    if not row["is_outcome"]:
        return
    shown = row["success"] and not row["rolled_back"]
    kept = {
        k: row[k] for k in ("repo", "path", "seq", "plan_key", "success", "rolled_back", "error")
    }
    out.add(**kept, diff=diff_text(before, content, row["path"]) if shown else "")


def _by_segment(log: DataFrame) -> DataFrame:
    return (
        log.filter(F.col("step") != "final")
        .repartition("repo", "path", "segment")
        .sortWithinPartitions("repo", "path", "segment", "version")
    )


def file_versions(log: DataFrame) -> DataFrame:
    """Every version of every edited file, with the text before and after."""
    versions = _by_segment(log.filter(F.col("version").isNotNull())).mapInArrow(
        _replayer(_VERSION_ARROW, _emit_version),
        "repo string, path string, version int, seq int, plan_key string, step string, "
        "before string, content string",
    )
    return versions.withColumn("sha256", F.sha2("content", 256))


def outcomes(log: DataFrame) -> DataFrame:
    """One row per plan without the diff; nothing is replayed."""
    return log.filter("is_outcome").select(
        "repo", "path", "seq", "plan_key", "success", "rolled_back", "error"
    )


def outcomes_with_diff(log: DataFrame) -> DataFrame:
    """One row per plan with its unified diff; empty unless the edit stands."""
    return _by_segment(log).mapInArrow(
        _replayer(_OUTCOME_ARROW, _emit_outcome),
        "repo string, path string, seq int, plan_key string, success boolean, "
        "rolled_back boolean, diff string, error string",
    )


def edited_files(log: DataFrame) -> DataFrame:
    """The state of every edited file after its last plan."""
    return log.filter(F.col("step") == "final").select(
        "repo", "path", "version", F.col("inserted").alias("content")
    )


def rolled_back_files(log: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Edited files as they were before their last edit: all of them, or those in ``paths``."""
    last = log.filter(F.col("step") == "final").select(
        "repo", "path", F.col("base").alias("content"), F.sha2("base", 256).alias("sha256")
    )
    if paths is None:
        return last
    return last.join(paths.select("repo", "path"), ["repo", "path"], "left_semi")
