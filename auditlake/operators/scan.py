"""Scanning: one narrow pass over the files, then counts.

``scan_files`` yields one row per file holding its metrics and its findings.
Findings are exploded from it, summaries are a single partial-then-final
aggregate; the corpus is read once and file contents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from auditlake.functions import rules
from auditlake.functions.pyfacts import python_facts
from auditlake.functions.text import line_count, numbered, token_estimate


def scan_files(sources: DataFrame, *carry: str, partitions: int | None = None) -> DataFrame:
    """``sources(repo, path, language, content)`` to one scanned row per file.

    Input splits are balanced by bytes, which suits most tables.  Where Python
    files sit together, parsing makes their splits slow: ``partitions`` then
    spreads the files by key first, at the price of moving them.
    """
    if partitions is not None:
        sources = sources.repartition(partitions, "repo", "path")
    keys = ["repo", "path", "language", *carry]
    language, content = F.col("language"), F.col("content")
    with_facts = sources.select(
        *keys,
        "content",
        python_facts(F.when(rules.needs_facts(language, content), content)).alias("facts"),
    )
    with_lines = with_facts.select(
        *keys,
        "content",
        "facts",
        F.when(rules.needs_lines(language, content), numbered(content)).alias("numbered"),
    )
    return with_lines.select(
        *keys,
        line_count(content).alias("n_lines"),
        token_estimate(content).alias("est_tokens"),
        rules.file_hits(language, content, F.col("numbered"), F.col("facts")).alias("hits"),
    )


def syntax_facts(sources: DataFrame) -> DataFrame:
    """All syntax facts of the Python files, quarantined files included."""
    python = sources.filter(F.col("language") == "python")
    facts = python.select("repo", "path", python_facts("content").alias("facts"))
    return facts.select("repo", "path", F.inline_outer("facts")).filter(F.col("kind").isNotNull())


def unparsed(sources: DataFrame, store: DataFrame | None) -> DataFrame:
    """(sha256, content): one row per distinct Python content whose facts aren't in ``store``.

    Hashes are compared first, so known contents never move; of the new ones each hash
    keeps one content, copies merged before the exchange."""
    python = sources.filter(F.col("language") == "python").select(F.sha2("content", 256).alias("sha256"), "content")
    new = python if store is None else python.join(store.select("sha256"), "sha256", "left_anti")
    return new.groupBy("sha256").agg(F.min("content").alias("content"))


def _store(spark, store_dir: str) -> DataFrame | None:
    """The facts stored so far, or None before the first run."""
    try:
        return spark.read.parquet(store_dir)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def stored_facts(sources: DataFrame, store_dir: str) -> DataFrame:
    """``syntax_facts`` by content: facts are kept in ``store_dir`` (a shared folder) under the
    sha256 of the content they belong to, each distinct content is parsed once, and a later run
    over contents seen before parses none. New facts are appended before facts are returned;
    a run that fails before its write leaves the store as it was."""
    spark = sources.sparkSession
    new = unparsed(sources, _store(spark, store_dir))
    new.select("sha256", python_facts("content").alias("facts")).write.mode("append").parquet(store_dir)
    python = sources.filter(F.col("language") == "python").select("repo", "path", F.sha2("content", 256).alias("sha256"))
    facts = python.join(spark.read.parquet(store_dir), "sha256")
    return facts.select("repo", "path", F.inline_outer("facts")).filter(F.col("kind").isNotNull())


def findings(scanned: DataFrame, *carry: str) -> DataFrame:
    """One row per finding; ``ordinal`` is its position in the file's report.

    The outer explode is deliberate: for an inner one the optimizer adds a
    filter on the array's size and pushes it below the scan, which would then
    be evaluated twice, Python workers included.
    """
    exploded = scanned.select(
        "repo", "path", *carry, F.posexplode_outer("hits").alias("ordinal", "hit")
    )
    return exploded.filter(F.col("ordinal").isNotNull()).select(
        "repo",
        "path",
        *carry,
        "ordinal",
        F.col("hit.line").alias("line"),
        F.col("hit.rule").alias("rule"),
        *rules.catalogue_columns(F.col("hit")),
    )


def findings_of(sources: DataFrame, rule: str) -> DataFrame:
    """The findings of one rule; files of other languages are dropped before any work."""
    language = rules.RULE_LANGUAGE[rule]
    return findings(scan_files(sources.filter(F.col("language") == language))).filter(
        F.col("rule") == rule
    )


def scan_summary(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row per repo, or per repo and ``keys``: pass "snapshot" where a table holds several."""
    return scanned.groupBy("repo", *keys).agg(
        F.count("*").alias("files_scanned"),
        F.sum("n_lines").alias("lines_analyzed"),
        F.sum("est_tokens").alias("tokens"),
        F.sum(F.size("hits")).cast("bigint").alias("findings"),
    )


def severity_counts(found: DataFrame) -> DataFrame:
    """One row per severity, most severe first in ``rank``, zero counts included."""
    totals = found.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(s).alias("severity"), F.col(s).alias("findings"))
            for i, s in enumerate(rules.SEVERITIES)
        ]
    )
    return totals.select(F.inline(pairs))


def over_budget(tokens: Column, budget: int | None) -> Column:
    """No budget, or zero, never trips the gate."""
    return tokens > F.lit(budget) if budget else F.lit(False)


def budget_message(tokens: Column, budget: int | None) -> Column:
    return F.concat(
        F.lit("Token budget exceeded ("), tokens.cast("string"), F.lit(f" > {budget})")
    )


def token_budget_gate(summary: DataFrame, budget: int | None) -> DataFrame:
    tripped = over_budget(F.col("tokens"), budget)
    return summary.select(
        "repo",
        "tokens",
        (~tripped).alias("success"),
        F.when(tripped, budget_message(F.col("tokens"), budget)).alias("message"),
    )


# The message of a run without findings.
CLEAN_MESSAGE = "No issues found. Codebase is clean."


def clean_gate(summary: DataFrame) -> DataFrame:
    clean = F.col("findings") == 0
    return summary.select(
        "repo", "findings", clean.alias("clean"), F.when(clean, F.lit(CLEAN_MESSAGE)).alias("message")
    )
