"""The scan rules: predicates, catalogue texts and the in-row findings expression.

A finding is built inside the file's own row, so scanning needs no shuffle and
works unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import ANY, NOT_AFTER_WORD, NOT_BEFORE_WORD, SP, WORD, strip

# Extensions and the language whose rules apply to them.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".go": "go",
}

# Finding severities, most severe first.
SEVERITIES = ["critical", "high", "medium", "low", "info"]

# A function is long when its last line is more than this after its first.
LONG_FUNCTION = 50

# Rule -> severity, category, title, description, suggestion.
# {name} and {amount} stand for the function's name and length.
CATALOGUE = {
    "bare_except": (
        "high",
        "anti-pattern",
        "Bare except clause",
        "Bare except catches ALL exceptions including SystemExit and KeyboardInterrupt.",
        "Replace with `except Exception:` or catch specific exception types.",
    ),
    "mutable_default": (
        "medium",
        "anti-pattern",
        "Mutable default argument",
        "Function '{name}' uses a mutable default argument.",
        "Use `None` as default and initialize inside the function body.",
    ),
    "long_function": (
        "medium",
        "architecture",
        "Function too long",
        "Function '{name}' has {amount} lines (threshold: 50).",
        "Consider breaking it into smaller helper functions.",
    ),
    "ts_any": (
        "medium",
        "architecture",
        "Use of `any` type",
        "Using `any` disables type checking for this expression.",
        "Replace with a proper type or `unknown` if the type is truly uncertain.",
    ),
    "ts_missing_return": (
        "low",
        "style",
        "Missing return type annotation",
        "Exported function/const lacks an explicit return type.",
        "Add a return type annotation for better API documentation.",
    ),
    "js_var": (
        "low",
        "anti-pattern",
        "Use of `var`",
        "`var` has function-level scoping which can cause subtle bugs.",
        "Replace with `const` for immutable bindings or `let` for mutable ones.",
    ),
    "js_console": (
        "info",
        "dead-code",
        "Stray console.log",
        "Debug logging statement found in source code.",
        "Remove or replace with a proper logging framework.",
    ),
    "go_ignored_error": (
        "high",
        "security",
        "Silently ignoring error",
        "Error return value is explicitly discarded with `_ =`.",
        "Handle the error explicitly with a meaningful fallback or log.",
    ),
}

HIT_TYPE = "struct<line:int,rule:string,text:string,name:string,amount:int>"
HITS_TYPE = f"array<{HIT_TYPE}>"


@dataclass(frozen=True)
class LineRule:
    """``needle`` occurs in every line the predicate matches.

    Files without it are not split, lines without it never reach the pattern.
    """

    name: str
    language: str
    needle: str
    matches: Callable[[Column], Column]
    first_only: bool


LINE_RULES = [
    LineRule("ts_any", "typescript", "any", lambda t: t.rlike(f":{SP}*any{NOT_BEFORE_WORD}"), True),
    LineRule(
        "ts_missing_return",
        "typescript",
        "export",
        lambda t: t.rlike(f"^export{SP}+(?:function|const){SP}+{WORD}+{SP}*=")
        & ~F.contains(F.substring_index(t, "{", 1), F.lit(":")),
        False,
    ),
    LineRule("js_var", "javascript", "var", lambda t: t.rlike(f"^{SP}*var{SP}+{WORD}"), True),
    LineRule(
        "js_console",
        "javascript",
        "console.log",
        lambda t: ~t.rlike(f"^{SP}*//"),
        False,
    ),
    LineRule(
        "go_ignored_error",
        "go",
        "rror",
        lambda t: t.rlike(f"^{SP}*_{SP}*={SP}*{ANY}*{NOT_AFTER_WORD}(?:Error|error){NOT_BEFORE_WORD}"),
        True,
    ),
]

RULE_LANGUAGE = {
    "bare_except": "python",
    "mutable_default": "python",
    "long_function": "python",
    **{rule.name: rule.language for rule in LINE_RULES},
}


def language_of(ext: Column) -> Column:
    return reduce(
        lambda chain, item: chain.when(ext == item[0], F.lit(item[1])), LANGUAGES.items(), F
    )


def _hit(line: Column, rule: str, text: Column, name: Column, amount: Column) -> Column:
    return F.struct(
        line.alias("line"),
        F.lit(rule).alias("rule"),
        text.alias("text"),
        name.alias("name"),
        amount.alias("amount"),
    ).cast(HIT_TYPE)


def _no_hits() -> Column:
    return F.array().cast(HITS_TYPE)


def _line_hits(rule: LineRule, content: Column, numbered: Column) -> Column:
    needle = F.lit(rule.needle)
    found = F.filter(
        numbered, lambda row: F.contains(row["text"], needle) & rule.matches(row["text"])
    )
    if rule.first_only:
        found = F.slice(found, 1, 1)
    none = F.lit(None)
    hits = F.transform(
        found,
        lambda row: _hit(row["line"], rule.name, row["text"], none.cast("string"), none.cast("int")),
    )
    return F.when(F.contains(content, needle), hits).otherwise(_no_hits())


def needs_lines(language: Column, content: Column) -> Column:
    """Whether any line rule can hit the file at all."""
    return reduce(
        Column.__or__,
        [(language == r.language) & F.contains(content, F.lit(r.needle)) for r in LINE_RULES],
    )


def needs_facts(language: Column, content: Column) -> Column:
    """Python rules need an ``except`` or a ``def``; other files skip the worker."""
    return (language == "python") & (
        F.contains(content, F.lit("except")) | F.contains(content, F.lit("def"))
    )


def fact_hits(facts: Column) -> Column:
    """Findings of one Python file, in walk order and check order."""

    def judge(fact: Column) -> Column:
        none = F.lit(None)
        bare = _hit(fact["line"], "bare_except", fact["text"], none.cast("string"), none.cast("int"))
        mutable = _hit(fact["line"], "mutable_default", fact["text"], fact["name"], none.cast("int"))
        length = fact["end_line"] - fact["line"]
        long = _hit(fact["line"], "long_function", fact["text"], fact["name"], length)
        return F.when(fact["kind"] == "bare_except", F.array(bare)).when(
            fact["kind"] == "function",
            F.concat(
                F.array_repeat(mutable, fact["mutable_defaults"]),
                F.when(length > LONG_FUNCTION, F.array(long)).otherwise(_no_hits()),
            ),
        ).otherwise(_no_hits())

    return F.coalesce(F.flatten(F.transform(facts, judge)), _no_hits())


def file_hits(language: Column, content: Column, numbered: Column, facts: Column) -> Column:
    """All findings of one file as an array; the position is the reporting order."""
    by_language: dict[str, list[Column]] = {}
    for rule in LINE_RULES:
        by_language.setdefault(rule.language, []).append(_line_hits(rule, content, numbered))
    chain = F.when(language == "python", fact_hits(facts))
    for name, parts in by_language.items():
        chain = chain.when(language == name, F.concat(*parts) if len(parts) > 1 else parts[0])
    return chain.otherwise(_no_hits())


def catalogue_columns(hit: Column) -> list[Column]:
    """The finding's catalogue columns.  Eight fixed entries: a literal map, no join."""
    entry = F.element_at(
        F.create_map(
            *[
                part
                for rule, texts in CATALOGUE.items()
                for part in (F.lit(rule), F.array(*[F.lit(t) for t in texts]))
            ]
        ),
        hit["rule"],
    )
    description = F.replace(
        F.replace(entry[3], F.lit("{amount}"), F.coalesce(hit["amount"].cast("string"), F.lit(""))),
        F.lit("{name}"),
        F.coalesce(hit["name"], F.lit("")),
    )
    return [
        entry[0].alias("severity"),
        entry[1].alias("category"),
        entry[2].alias("title"),
        description.alias("description"),
        entry[4].alias("suggestion"),
        strip(hit["text"]).alias("context"),
    ]
