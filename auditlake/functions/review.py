"""Diff review inside the diff's own row: sections, comments, score, summary, body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import (
    ANY,
    FOLD,
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    SP,
    WORD,
    lines,
    strip,
)

# An added line longer than this is too long.
LINE_LIMIT = 100

# Review rule -> severity, message, suggestion.
CATALOGUE = {
    "credential": (
        "critical",
        "Potentially hardcoded credential detected in added line.",
        "Move to environment variables or a secrets manager.",
    ),
    "todo": (
        "suggestion",
        "New TODO comment introduced.",
        "Consider tracking this in your issue tracker instead.",
    ),
    "long_line": (
        "warning",
        "Line too long ({length} chars, limit: 100).",
        "Break the line into multiple shorter lines.",
    ),
    "print_call": (
        "warning",
        "Added print() statement detected.",
        "Replace with proper logging if this is for production.",
    ),
    "removed_handling": (
        "critical",
        "Removal of exception handling detected.",
        "Ensure the error is still handled appropriately.",
    ),
    "removed_annotation": (
        "warning",
        "Return type annotation being removed.",
        "Type annotations improve code documentation and tooling support.",
    ),
}

# Comment severities in ascending order, as the summary lists them.
COMMENT_SEVERITIES = ["critical", "suggestion", "warning"]

# Weights of the score's dimensions, summed in this order.
WEIGHTS = {"correctness": 0.40, "style": 0.20, "safety": 0.25, "completeness": 0.15}

# What a comment costs its dimension.
PENALTY = {"critical": 0.5, "warning": 0.12, "suggestion": 0.04}

# The score from which a diff is approved.
APPROVE_FROM = 75

# The summary of a blank diff.
NO_CHANGES = "No changes to review."

COMMENT_TYPE = (
    "struct<pos:int,file:string,line:int,rule:string,severity:string,message:string,suggestion:string>"
)


def added_rule(text: Column) -> Column:
    """The first check an added line fails, or NULL.

    Most lines fail none, so each pattern stands behind a cheaper test that
    every match also passes: a quoted value after ``=`` or ``:``, the letters
    of the word, the call itself.
    """
    quoted = text.rlike(f"[=:]{SP}*[\"']")
    credential = (
        FOLD + f"(?:token|password|secret|api_key|apikey){SP}*[=:]{SP}*[\"']{ANY}+[\"']"
    )
    todo = FOLD + NOT_AFTER_WORD + "TODO" + NOT_BEFORE_WORD
    return (
        F.when(quoted & text.rlike(credential), F.lit("credential"))
        .when(F.contains(F.lower(text), F.lit("todo")) & text.rlike(todo), F.lit("todo"))
        .when(F.length(text) > LINE_LIMIT, F.lit("long_line"))
        .when(F.contains(text, F.lit("print(")) & text.rlike(rf"^{SP}*print\("), F.lit("print_call"))
    )


def removed_rule(text: Column) -> Column:
    handling = f"try{SP}*:|except{SP}+{WORD}+{SP}*:|raise{SP}+{WORD}"
    return F.when(text.rlike(handling), F.lit("removed_handling")).when(
        F.contains(text, F.lit("->")) & text.rlike(f"->{SP}*{WORD}"), F.lit("removed_annotation")
    )


def line_rule(sign: Column, text: Column) -> Column:
    return F.when(sign == "+", added_rule(text)).when(sign == "-", removed_rule(text))


def diff_rows(diff: Column) -> Column:
    """``array<struct<pos, text>>`` of the diff's lines."""
    return F.transform(lines(diff), lambda t, i: F.struct(i.alias("pos"), t.alias("text")))


def file_headers(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.startswith(r["text"], F.lit("--- ")))


def sections(rows: Column, heads: Column) -> Column:
    """``array<struct<file, body array<struct<pos, text>>>>``: one entry per file header.

    Lines before the first header belong to no section.  ``rows`` and ``heads``
    must be columns, not expressions: they are read for every section, and
    slicing by header position is linear in the diff only if they exist already.
    """

    def section(head: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(heads, k + 1)["pos"], F.size(rows))
        body = F.slice(rows, head["pos"] + 2, stop - head["pos"] - 1)
        return F.struct(
            strip(F.substring(head["text"], 7, 2147483647)).alias("file"),
            F.filter(body, lambda r: ~F.startswith(r["text"], F.lit("+++ "))).alias("body"),
        )

    return F.transform(heads, section)


def section_lines(parts: Column) -> Column:
    """``array<struct<pos, file, sign, text>>`` of all sections."""
    return F.flatten(
        F.transform(
            parts,
            lambda s: F.transform(
                s["body"],
                lambda r: F.struct(
                    r["pos"].alias("pos"),
                    s["file"].alias("file"),
                    F.substring(r["text"], 1, 1).alias("sign"),
                    F.substring(r["text"], 2, 2147483647).alias("text"),
                ),
            ),
        )
    )


def comment(pos: Column, file: Column, rule: Column, text: Column) -> Column:
    """A comment from its rule.  Six fixed entries: a literal map, no join."""
    entry = F.element_at(
        F.create_map(
            *[
                part
                for name, texts in CATALOGUE.items()
                for part in (F.lit(name), F.array(*[F.lit(t) for t in texts]))
            ]
        ),
        rule,
    )
    message = F.replace(entry[1], F.lit("{length}"), F.length(text).cast("string"))
    return F.struct(
        pos.alias("pos"),
        file.alias("file"),
        F.lit(0).alias("line"),
        rule.alias("rule"),
        entry[0].alias("severity"),
        message.alias("message"),
        entry[2].alias("suggestion"),
    ).cast(COMMENT_TYPE)


def comments(changed: Column) -> Column:
    """At most one comment per added or removed line, in diff order."""
    signed = F.filter(changed, lambda r: r["sign"].isin("+", "-"))
    ruled = F.filter(
        F.transform(
            signed,
            lambda r: F.struct(r.alias("at"), line_rule(r["sign"], r["text"]).alias("rule")),
        ),
        lambda r: r["rule"].isNotNull(),
    )
    return F.transform(
        ruled, lambda r: comment(r["at"]["pos"], r["at"]["file"], r["rule"], r["at"]["text"])
    )


def score(severities: Column) -> Column:
    """0 to 100, folded in comment order in doubles, then truncated.

    The order of additions is part of the result: closed forms and exact
    decimals give other points for some diffs.
    """

    def less(value: Column, amount: float) -> Column:
        return F.greatest(F.lit(0.0), value - F.lit(amount))

    def step(acc: Column, severity: Column) -> Column:
        critical, warning = severity == "critical", severity == "warning"
        return F.struct(
            F.when(critical, less(acc["correctness"], PENALTY["critical"]))
            .otherwise(acc["correctness"])
            .alias("correctness"),
            F.when(critical | warning, acc["style"])
            .otherwise(less(acc["style"], PENALTY["suggestion"]))
            .alias("style"),
            F.when(critical, less(acc["safety"], PENALTY["critical"]))
            .when(warning, less(acc["safety"], PENALTY["warning"]))
            .otherwise(acc["safety"])
            .alias("safety"),
        )

    def finish(acc: Column) -> Column:
        total = F.lit(0.0)
        for name, weight in WEIGHTS.items():
            value = F.lit(1.0) if name == "completeness" else acc[name]
            total = total + value * F.lit(weight)
        return F.least(F.lit(100), F.greatest(F.lit(0), (total * 100).cast("int")))

    start = F.struct(*[F.lit(1.0).alias(n) for n in ("correctness", "style", "safety")])
    return F.aggregate(severities, start, step, finish)


def summary(points: Column, approved: Column, severities: Column) -> Column:
    def counted(name: str) -> Column:
        n = F.size(F.filter(severities, lambda s: s == name))
        return F.when(n > 0, F.concat(F.lit(f"  {name}: "), n.cast("string")))

    counts = [counted(name) for name in COMMENT_SEVERITIES]
    total = F.size(severities)
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Score: "), points.cast("string"), F.lit("/100")),
        F.when(approved, F.lit("APPROVED")).otherwise("CHANGES REQUESTED"),
        F.when(total > 0, F.concat(F.lit("Comments: "), total.cast("string"))),
        *counts,
    )


def body(
    approved: Column,
    points: Column,
    notes: Column,
    work_summary: Column,
    title: str = "Auto-Review",
) -> Column:
    """The review as markdown."""
    status = F.when(approved, F.lit("✅ Approved")).otherwise("❌ Changes Requested")
    listed = F.array_join(
        F.transform(
            notes,
            lambda c: F.concat(
                F.lit("\n- **["),
                F.upper(c["severity"]),
                F.lit("]** ("),
                c["file"],
                F.lit("): "),
                c["message"],
                F.when(c["suggestion"] != "", F.concat(F.lit("\n  → "), c["suggestion"])).otherwise(""),
            ),
        ),
        "",
    )
    return F.concat(
        F.lit(f"## {title}\n\n**Status:** "),
        status,
        F.lit("\n**Score:** "),
        points.cast("string"),
        F.lit("/100\n\n### Refactoring Summary\n"),
        work_summary,
        F.lit("\n\n### Review Comments\n"),
        F.when(F.size(notes) > 0, listed).otherwise("\nNo issues found. Clean refactoring."),
    )
