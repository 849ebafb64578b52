"""The run report: one row per run, as columns, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import one_decimal
from auditlake.operators.scan import CLEAN_MESSAGE, budget_message, over_budget, scan_summary


def run_report(
    scanned: DataFrame,
    reports: DataFrame,
    budget: int | None = None,
    duration: Column | None = None,
    title: str = "Audit Complete",
) -> DataFrame:
    """Roll up scanned files and edit reports per repo.

    A run over its token budget, or without findings, ends early: it makes no
    edits and reports neither tokens nor a duration.
    """
    summary = scan_summary(scanned)
    edits = reports.groupBy("repo").agg(
        F.count("*").alias("attempted"), F.count_if("approved").alias("approved")
    )
    joined = summary.join(edits, "repo", "left")
    tripped = over_budget(F.col("tokens"), budget)
    clean = ~tripped & (F.col("findings") == 0)
    early = tripped | clean
    seconds = F.lit(0.0) if duration is None else duration
    rows = joined.select(
        F.col("repo").alias("run_id"),
        (~tripped).alias("success"),
        "files_scanned",
        "findings",
        F.when(early, 0).otherwise(F.coalesce("attempted", F.lit(0))).cast("bigint").alias("refactors_attempted"),
        F.when(early, 0).otherwise(F.coalesce("approved", F.lit(0))).cast("bigint").alias("refactors_approved"),
        F.when(early, 0).otherwise(F.col("tokens")).cast("bigint").alias("tokens_consumed"),
        F.when(early, 0.0).otherwise(seconds).alias("duration_seconds"),
        F.when(tripped, budget_message(F.col("tokens"), budget))
        .when(clean, F.lit(CLEAN_MESSAGE))
        .alias("early_message"),
    )
    text = F.format_string(
        f"{title}\n  Duration: %ss\n  Files scanned: %d\n  Findings: %d\n"
        "  Refactors attempted: %d\n  Approved: %d\n  Tokens consumed: %s\n  Status: ✅ All clear",
        one_decimal(F.col("duration_seconds")),
        "files_scanned",
        "findings",
        "refactors_attempted",
        "refactors_approved",
        F.format_number("tokens_consumed", 0),
    )
    return rows.withColumn("summary", F.coalesce("early_message", text)).drop("early_message")


JSON_FIELDS = [
    "success",
    "files_scanned",
    "findings",
    "refactors_attempted",
    "refactors_approved",
    "tokens_consumed",
    "duration_seconds",
    "summary",
]


def as_json(report: DataFrame) -> DataFrame:
    return report.select("run_id", F.to_json(F.struct(*JSON_FIELDS)).alias("json"))
