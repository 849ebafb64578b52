"""File inventories: directory pruning, languages, project tooling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.rules import LANGUAGES, language_of
from auditlake.functions.text import extension, line_count, token_estimate, unix_line_ends

# Directories that hold no sources, at any level.
EXCLUDED_DIRS = [
    ".git",
    "__pycache__",
    "node_modules",
    "venv",
    ".venv",
    "dist",
    "build",
    ".tox",
    ".eggs",
]

# Root files that name a test runner, first match wins.
RUNNER_MARKERS = [
    ("pyproject.toml", "pytest"),
    ("pytest.ini", "pytest"),
    ("setup.cfg", "pytest"),
    ("package.json", "npm"),
    ("go.mod", "go"),
]

# Root files that name a linter.
LINTER_MARKERS = [
    ("flake8", [".flake8"]),
    ("eslint", [".eslintrc.js", ".eslintrc.json"]),
    ("golangci-lint", [".golangci.yml"]),
]

# What is reported where nothing can be run; such a repo passes.
NO_RUNNER = "No test runner config found — skipping verification (safe fallback)."
NO_LINTER = "No linter config found — skipping lint."


def in_excluded_dir(path: Column) -> Column:
    """Only directories count: a file may carry an excluded name."""
    names = "|".join(name.replace(".", r"\.") for name in EXCLUDED_DIRS)
    return path.rlike(f"(?:^|/)(?:{names})/")


def with_language(files: DataFrame) -> DataFrame:
    ext = extension(F.col("path"))
    return files.withColumn("ext", ext).withColumn("language", language_of(F.col("ext")))


def source_files(files: DataFrame, prune: bool = True) -> DataFrame:
    """The files a scan visits: a supported extension, outside the excluded directories.

    Line ends become ``\n`` whatever table the contents come from.
    """
    kept = files.filter(extension(F.col("path")).isin(*LANGUAGES))
    if "content" in files.columns:
        # What could not be read is skipped, and not counted.
        kept = kept.filter(F.col("content").isNotNull())
        kept = kept.withColumn("content", unix_line_ends(F.col("content")))
    if prune:
        kept = kept.filter(~in_excluded_dir(F.col("path")))
    return with_language(kept)


def language_inventory(files: DataFrame) -> DataFrame:
    return (
        with_language(files)
        .groupBy("ext", "language")
        .agg(F.count("*").alias("files"))
    )


def file_metrics(files: DataFrame, *keys: str) -> DataFrame:
    content = F.col("content")
    return files.select(
        *keys,
        line_count(content).alias("n_lines"),
        token_estimate(content).alias("est_tokens"),
        F.sha2(content, 256).alias("sha256"),
    )


def test_runners(files: DataFrame) -> DataFrame:
    """``files(repo, path)`` to one row per repo; ``skip`` and a message where no marker is found.

    One aggregate over the whole inventory keeps repos without markers without a
    join, and partial aggregation takes care of repos of any size.
    """
    ranks = reduce(
        lambda chain, item: chain.when(F.col("path") == item[1][0], F.lit(item[0])),
        enumerate(RUNNER_MARKERS),
        F,
    )
    runners = F.array(*[F.lit(runner) for _, runner in RUNNER_MARKERS])
    best = files.groupBy("repo").agg(F.min(ranks).alias("best"))
    return best.select(
        "repo",
        F.coalesce(F.get(runners, F.col("best")), F.lit("skip")).alias("runner"),
        F.when(F.col("best").isNull(), F.lit(NO_RUNNER)).alias("message"),
    )


def linters(files: DataFrame) -> DataFrame:
    """Linters per repo, sorted; an empty list where none is configured."""
    flags = [
        F.when(F.bool_or(F.col("path").isin(*markers)), F.lit(name))
        for name, markers in sorted(LINTER_MARKERS)
    ]
    found = files.groupBy("repo").agg(F.array_compact(F.array(*flags)).alias("linters"))
    return found.withColumn("message", F.when(F.size("linters") == 0, F.lit(NO_LINTER)))
