"""Single edits: each plan against the file as it is in ``files``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.edits import INLINE_FIX, RESTRUCTURE, edit_error, edited, first_line
from auditlake.sources.tables import fetch


def apply_each(files: DataFrame, plans: DataFrame) -> DataFrame:
    """``before``, ``after`` and ``error`` of every plan taken alone.

    A plan without a file keeps its row, with an error instead of a result; ``present``
    tells whether ``files`` holds a row for it at all, so a file that is there but could not
    be read (null content, the same error) is told from one that is missing. Only the files
    that plans name are fetched (by their keys, see ``fetch``) before they meet the plans, so
    the contents of the other files never move.
    """
    before, strategy = F.col("before"), F.col("strategy")
    snippets = F.col("original_snippet"), F.col("target_snippet")
    bounds = F.col("line_start"), F.col("line_end")
    named = fetch(files.select("repo", "path", "content"), plans)
    found = named.select("repo", "path", F.col("content").alias("before"), F.lit(True).alias("present"))
    joined = plans.join(found, ["repo", "path"], "left")
    return joined.withColumns(
        {
            "present": F.coalesce("present", F.lit(False)),
            "error": edit_error(before, strategy, F.col("path"), *snippets, *bounds),
            "after": edited(before, strategy, *snippets, *bounds),
        }
    )


def degraded(plans: DataFrame) -> DataFrame:
    """The simpler plan to fall back on; only ``restructure`` plans have one."""
    return plans.filter(F.col("strategy") == RESTRUCTURE).withColumns(
        {
            "strategy": F.lit(INLINE_FIX),
            "original_snippet": first_line(F.col("original_snippet")),
            "target_snippet": first_line(F.col("target_snippet")),
            "explanation": F.concat(F.lit("Degraded fix for: "), F.col("explanation")),
        }
    )
