"""Diff review: every step stays in the diff's row, so no diff line is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import review as R
from auditlake.functions.text import is_blank, lines, strip

# Lines of a diff that one task takes when a diff is read as numbered lines.
RANGE_LINES = 65_536


def _with_lines(diffs: DataFrame, *carry: str | Column) -> DataFrame:
    """``diff_id``, the carried columns and ``changed``: the diff's section lines.

    Three selects on purpose: rows and headers become columns that the next
    step reads many times.
    """
    kept = diffs.select("diff_id", *carry, R.diff_rows(F.col("diff")).alias("rows"))
    headed = kept.withColumn("heads", R.file_headers(F.col("rows")))
    parts = R.sections(F.col("rows"), F.col("heads"))
    return headed.withColumn("changed", R.section_lines(parts)).drop("rows", "heads")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """``diffs(diff_id, diff)`` to one row per line that belongs to a file section."""
    rows = _with_lines(diffs).select("diff_id", F.inline_outer("changed"))
    return rows.filter(F.col("pos").isNotNull())


def numbered_lines(diffs: DataFrame) -> DataFrame:
    """``(diff_id, pos, text)``: one row per line of every diff, ``pos`` from 0."""
    return diffs.select("diff_id", F.posexplode(lines(F.col("diff"))).alias("pos", "text"))


def ranged_diff_lines(numbered: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """``diff_lines`` of diffs given as numbered lines ``(diff_id, pos, text)``, so that one
    diff may be longer than a task can hold.

    Lines are cut into ranges of ``range_lines`` by ``pos``. Pass one finds each range's
    last file header (a grouped aggregate, one row per range) and carries the last one of
    all earlier ranges forward by a window over those few rows. Pass two gives each line
    the latest header at or before it in its own range, else the carried one. No task
    holds more than a range of lines, and only the per-range rows cross them. Lines before
    the first header, headers and ``+++ `` lines give no row, as in ``diff_lines``; a null
    line gives none and doesn't end a section; an empty table gives none. ``numbered`` is
    read by both passes, so a long diff should come as a stored table.
    """
    header = F.when(F.startswith("text", F.lit("--- ")), F.struct("pos", "text"))
    ranged = numbered.withColumn("range", F.floor(F.col("pos") / range_lines))
    last = ranged.groupBy("diff_id", "range").agg(F.max(header).alias("last"))
    earlier = Window.partitionBy("diff_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("diff_id", "range", F.max("last").over(earlier).alias("carried"))
    upto = Window.partitionBy("diff_id", "range").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = ranged.withColumn("own", F.max(header).over(upto))
    head = F.coalesce("own", "carried")
    body = local.join(carried, ["diff_id", "range"]).filter(
        head.isNotNull() & ~F.startswith("text", F.lit("--- ")) & ~F.startswith("text", F.lit("+++ "))
    )
    return body.select(
        "diff_id",
        "pos",
        strip(F.substring(head["text"], 7, 2147483647)).alias("file"),
        F.substring("text", 1, 1).alias("sign"),
        F.substring("text", 2, 2147483647).alias("text"),
    )


def line_comments(diffs: DataFrame, rule: str | None = None) -> DataFrame:
    """One row per comment; with ``rule`` only that rule's."""
    noted = _with_lines(diffs).select("diff_id", R.comments(F.col("changed")).alias("comments"))
    found = noted.select("diff_id", F.inline_outer("comments")).filter(F.col("pos").isNotNull())
    return found if rule is None else found.filter(F.col("rule") == rule)


def added_text_comments(texts: DataFrame, *keys: str) -> DataFrame:
    """Check free text as if every line of it were added: one row per line that fails."""
    rows = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "line_text"))
    ruled = rows.withColumn("rule", R.added_rule(F.col("line_text")))
    return ruled.filter(F.col("rule").isNotNull()).select(
        *keys, "pos", "rule", F.length("line_text").alias("length")
    )


def review_reports(diffs: DataFrame, *carry: str, approve_from: int = R.APPROVE_FROM) -> DataFrame:
    """One report per diff; a diff without a comment, or a blank one, keeps its row."""
    lined = _with_lines(diffs, *carry, is_blank(F.col("diff")).alias("blank"))
    noted = lined.select(
        "diff_id", *carry, "blank", R.comments(F.col("changed")).alias("comments")
    )
    severities = F.col("comments.severity")
    scored = noted.withColumn("score", R.score(severities))
    approved = F.col("blank") | (F.col("score") >= approve_from)
    return scored.select(
        "diff_id",
        *carry,
        approved.alias("approved"),
        "score",
        "comments",
        F.when(F.col("blank"), F.lit(R.NO_CHANGES))
        .otherwise(R.summary(F.col("score"), approved, severities))
        .alias("summary"),
    )


def failure_summary(error: Column) -> Column:
    return F.concat(F.lit("Refactoring failed: "), F.coalesce(error, F.lit("None")))


def outcome_reports(outcomes: DataFrame, approve_from: int = R.APPROVE_FROM) -> DataFrame:
    """One report per outcome: a review of its diff, or a rejection where there is none."""
    stands = F.col("success") & (F.col("diff") != "")
    reviewed = review_reports(
        outcomes.withColumn("diff_id", F.col("plan_key")).withColumn("stands", stands),
        "repo",
        "path",
        "plan_key",
        "stands",
        "error",
        approve_from=approve_from,
    )
    ok = F.col("stands")
    return reviewed.select(
        "repo",
        "path",
        "plan_key",
        (ok & F.col("approved")).alias("approved"),
        F.when(ok, F.col("score")).otherwise(0).alias("score"),
        F.when(ok, F.col("comments")).otherwise(F.array().cast(f"array<{R.COMMENT_TYPE}>")).alias("comments"),
        F.when(ok, F.col("summary")).otherwise(failure_summary(F.col("error"))).alias("summary"),
    )


def review_bodies(
    reports: DataFrame, work_summary: Column, title: str = "Auto-Review", keys: tuple[str, ...] = ("diff_id",)
) -> DataFrame:
    """The text of each report; ``keys`` are carried (reports of edits have a ``plan_key``)."""
    return reports.select(
        *keys,
        R.body(F.col("approved"), F.col("score"), F.col("comments"), work_summary, title).alias("body"),
    )
