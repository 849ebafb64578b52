"""Unified diffs of two whole texts in Arrow workers, by the anchor alignment of ``linediff``.

For pairs of texts in a table, ``linediff.unified_diffs`` finds the anchors with Spark first;
this is the same alignment for a text that is at hand in a worker already (the fold of edits).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditlake.functions import linediff


def diff_text(before: str, after: str, path: str) -> str:
    """Three context lines; both headers carry the bare path."""
    return linediff.diff_text(linediff.split_lines(before), linediff.split_lines(after), path)


@F.arrow_udf(StringType())
def unified_diff(before: pa.Array, after: pa.Array, path: pa.Array) -> pa.Array:
    rows = zip(before.to_pylist(), after.to_pylist(), path.to_pylist())
    return pa.array([None if None in row else diff_text(*row) for row in rows], type=pa.string())
