"""Repair plans from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.edits import INLINE_FIX


def plan_key(repo: Column, path: Column, seq: Column) -> Column:
    return F.sha2(F.concat_ws(chr(31), repo, path, seq.cast("string")), 256)


def repair_plans(found: DataFrame, prefix: str = "audit", gate: DataFrame | None = None) -> DataFrame:
    """One inline fix per finding worth fixing; ``seq`` is the finding's place in its file.

    ``gate(repo, success)`` stops work before it is planned: only repos that passed it get
    plans, so nothing of the others is edited.
    """
    if gate is not None:
        found = found.join(gate.filter("success").select("repo"), "repo", "left_semi")
    worth = found.filter(
        ~F.col("severity").isin("info", "low")
        & (F.col("category") == "anti-pattern")
        & F.contains(F.lower("title"), F.lit("except"))
    )
    return worth.select(
        plan_key(F.col("repo"), F.col("path"), F.col("ordinal")).alias("plan_key"),
        F.concat_ws("-", F.lit(prefix), "category", F.col("line").cast("string")).alias("finding_id"),
        "repo",
        "path",
        F.col("ordinal").alias("seq"),
        F.col("line").alias("line_start"),
        F.col("line").alias("line_end"),
        F.lit(INLINE_FIX).alias("strategy"),
        F.col("context").alias("original_snippet"),
        F.replace("context", F.lit("except:"), F.lit("except Exception:")).alias("target_snippet"),
        F.concat(F.lit("Fixed: "), F.col("title")).alias("explanation"),
        F.lit(True).alias("requires_type_check"),
        F.lit(True).alias("requires_lint"),
    )
