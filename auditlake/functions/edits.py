"""Text edits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import lines

# The edit strategies.
INLINE_FIX = "inline-fix"
EXTRACT_FUNCTION = "extract-function"
RENAME = "rename"
RESTRUCTURE = "restructure"
STRATEGIES = [INLINE_FIX, EXTRACT_FUNCTION, RENAME, RESTRUCTURE]


def replace_first(content: Column, original: Column, target: Column) -> Column:
    """An empty ``original`` is found before the first character, as in Python."""
    at = F.instr(content, original)
    return F.when(at > 0, F.overlay(content, target, at, F.length(original))).otherwise(content)


def replace_all(content: Column, original: Column, target: Column) -> Column:
    """An empty ``original`` is found around every character, as in Python."""
    around = F.concat(
        target,
        F.when(content == "", F.lit("")).otherwise(
            F.array_join(F.transform(F.split(content, ""), lambda c: F.concat(c, target)), "")
        ),
    )
    return F.when(original == "", around).otherwise(F.replace(content, original, target))


def replace_lines(content: Column, target: Column, start: Column, end: Column) -> Column:
    """Replace lines ``start`` to ``end`` (1-based, inclusive) by ``target``."""
    rows = lines(content)
    total = F.size(rows)
    before = F.when(
        start > 1, F.concat(F.array_join(F.slice(rows, F.lit(1), start - 1), "\n"), F.lit("\n"))
    ).otherwise("")
    # A negative end counts from the last line.
    resume = F.when(end >= 0, end).otherwise(F.greatest(total + end, F.lit(0)))
    after = F.when(
        end < total,
        F.concat(F.lit("\n"), F.array_join(F.slice(rows, resume + 1, total), "\n")),
    ).otherwise("")
    return F.concat(before, target, after)


def edited(
    content: Column,
    strategy: Column,
    original: Column,
    target: Column,
    start: Column,
    end: Column,
) -> Column:
    """The content after one edit; NULL for an unknown strategy."""
    return (
        F.when(strategy.isin(INLINE_FIX, EXTRACT_FUNCTION), replace_first(content, original, target))
        .when(strategy == RENAME, replace_all(content, original, target))
        .when(strategy == RESTRUCTURE, replace_lines(content, target, start, end))
    )


def edit_error(
    content: Column,
    strategy: Column,
    path: Column,
    original: Column,
    target: Column,
    start: Column,
    end: Column,
) -> Column:
    """Why an edit cannot be made, or NULL."""
    known = F.coalesce(strategy.isin(*STRATEGIES), F.lit(False))
    needed = F.when(strategy == RESTRUCTURE, start.isNull() | end.isNull()).otherwise(
        original.isNull()
    )
    return (
        F.when(content.isNull(), F.concat(F.lit("Cannot refactor: "), path, F.lit(" not found")))
        .when(~known, F.concat(F.lit("Unknown strategy: "), F.coalesce(strategy, F.lit("None"))))
        .when(target.isNull() | needed, F.lit("Incomplete plan"))
    )


def first_line(snippet: Column) -> Column:
    return F.substring_index(snippet, "\n", 1)
