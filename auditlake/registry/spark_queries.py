"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each runs one operator over whole tables, or over corpora Spark derives from
all of their rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import decode, extension
from auditlake.functions import linediff
from auditlake.operators import batch, edits, inventory, report, review, scan
from auditlake.plans.repair import repair_plans
from auditlake.plans.run import audit_run
from auditlake.registry import corpus
from auditlake.session import fresh_dir, written
from auditlake.sources import snapshots
from auditlake.streaming import continuous

TOKEN_BUDGET = 8_000
RUN_SECONDS = 12.5
# Bytes of every bad kind, and what they decode to (the text after the newline).
BAD_BYTES = "0D61E28262FFF09F9263"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.source_files(corpus.code_files(spark, sf_dir))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_files(_sources(spark, sf_dir))


def lang_inventory(spark, sf_dir):
    return inventory.language_inventory(corpus.path_inventory(spark, sf_dir))


def excluded_dirs(spark, sf_dir):
    kept = inventory.source_files(corpus.path_inventory(spark, sf_dir))
    return kept.select("o_orderkey", "repo", "path", "language")


def path_extensions(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    return pages.select("page_id", extension(F.col("url")).alias("ext"))


def decoded_text(spark, sf_dir):
    crlf = F.regexp_replace("text", "\n", "\r\n")
    raw = F.concat(F.encode(crlf, "UTF-8"), F.unhex(F.lit(BAD_BYTES)))
    text = corpus.table(spark, sf_dir, "documents").select("doc_id", decode(raw).alias("content"))
    return inventory.file_metrics(text, "doc_id")


def file_metrics(spark, sf_dir):
    documents = corpus.table(spark, sf_dir, "documents")
    return inventory.file_metrics(documents.withColumnRenamed("text", "content"), "doc_id")


def _one_rule(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        return scan.findings_of(_sources(spark, sf_dir), rule)

    return query


def py_facts(spark, sf_dir):
    files = inventory.source_files(corpus.code_files(spark, sf_dir), prune=False)
    return scan.syntax_facts(files).select(
        "repo", "path", "kind", "line", "end_line", "name", "mutable_defaults", "text"
    )


def py_facts_by_content(spark, sf_dir):
    """Facts kept by content hash: the base snapshot is parsed first, then the current one,
    whose unchanged files are not parsed again. The facts of the current files."""
    store = fresh_dir(spark, "facts-by-content")
    scan.stored_facts(inventory.source_files(corpus.code_files(spark, sf_dir, "base"), prune=False), store)
    files = inventory.source_files(corpus.code_files(spark, sf_dir), prune=False)
    return scan.stored_facts(files, store).select(
        "repo", "path", "kind", "line", "end_line", "name", "mutable_defaults", "text"
    )


def py_facts_any_line_end(spark, sf_dir):
    """The same sources with other line ends: a lone CR in some files, CR LF in others."""
    files = corpus.code_files(spark, sf_dir)
    ends = F.when(F.crc32("path") % 2 == 0, "\r").otherwise("\r\n")
    files = files.withColumn("content", F.replace("content", F.lit("\n"), ends))
    return scan.syntax_facts(inventory.source_files(files, prune=False)).select(
        "repo", "path", "kind", "line", "end_line", "name", "mutable_defaults", "text"
    )


def findings_union(spark, sf_dir):
    return scan.findings(_scanned(spark, sf_dir))


def scan_summary(spark, sf_dir):
    return scan.scan_summary(_scanned(spark, sf_dir))


def severity_counts(spark, sf_dir):
    return scan.severity_counts(findings_union(spark, sf_dir)).drop("rank")


def js_severity(spark, sf_dir):
    js = _sources(spark, sf_dir).filter(F.col("language") == "javascript")
    return scan.severity_counts(scan.findings(scan.scan_files(js))).drop("rank")


def scan_summary_snapshots(spark, sf_dir):
    """Two snapshots in one table, summed up apart."""
    both = [
        corpus.code_files(spark, sf_dir, name).withColumn("snapshot", F.lit(name))
        for name in ("current", "base")
    ]
    sources = inventory.source_files(both[0].unionByName(both[1]))
    return scan.scan_summary(scan.scan_files(sources, "snapshot"), "snapshot")


def token_budget(spark, sf_dir):
    return scan.token_budget_gate(scan_summary(spark, sf_dir), TOKEN_BUDGET)


def clean_gate(spark, sf_dir):
    """Each file is a run of its own, so clean and unclean runs both occur."""
    each = _sources(spark, sf_dir).withColumn("repo", F.concat_ws("/", "repo", "path"))
    return scan.clean_gate(scan.scan_summary(scan.scan_files(each)))


def toolchain(spark, sf_dir):
    return inventory.test_runners(corpus.marker_inventory(spark, sf_dir))


def linters(spark, sf_dir):
    found = inventory.linters(corpus.marker_inventory(spark, sf_dir))
    return found.select("repo", F.array_join("linters", ",").alias("linters"), "message")


def changed_files(spark, sf_dir):
    current = corpus.code_files(spark, sf_dir)
    return snapshots.changes(current, corpus.code_files(spark, sf_dir, "base"))


# Buckets of stored snapshots; both sides of a comparison must have the same number.
SNAPSHOT_BUCKETS = 16


def stored_changed_files(spark, sf_dir):
    """``changed_files`` of the two snapshots once they are stored as bucketed tables."""
    now = snapshots.stored(corpus.code_files(spark, sf_dir), "snapshot_current", SNAPSHOT_BUCKETS)
    was = snapshots.stored(corpus.code_files(spark, sf_dir, "base"), "snapshot_base", SNAPSHOT_BUCKETS)
    return snapshots.stored_changes(now, was)


def incremental_findings(spark, sf_dir):
    visited = snapshots.incremental_scan_set(
        corpus.code_files(spark, sf_dir), corpus.code_files(spark, sf_dir, "base")
    )
    return scan.findings(scan.scan_files(inventory.source_files(visited, prune=False)))


def path_list_scan(spark, sf_dir):
    """The list names the base snapshot's files; some of them are gone, and one repo has none."""
    listed = corpus.code_files(spark, sf_dir, "base").select("repo", "path")
    visited = snapshots.listed_scan_set(corpus.code_files(spark, sf_dir), listed)
    metrics = inventory.source_files(visited, prune=False)
    return inventory.file_metrics(metrics, "repo", "path")


def plans(spark, sf_dir):
    return repair_plans(findings_union(spark, sf_dir))


def _gated(spark, sf_dir):
    """Plans of the repos within the token budget."""
    scanned = written(_scanned(spark, sf_dir), "scanned")
    gate = scan.token_budget_gate(scan.scan_summary(scanned), TOKEN_BUDGET)
    return repair_plans(scan.findings(scanned), gate=gate)


def gated_plans(spark, sf_dir):
    return _gated(spark, sf_dir).select("plan_key", "repo", "path", "seq")


def edited_files_budget(spark, sf_dir):
    """Files after the repairs of a run whose budget some repos exceed: theirs stay as they are."""
    made = written(_gated(spark, sf_dir), "plans")
    log = batch.edit_log(corpus.code_files(spark, sf_dir), made, corpus.verdicts_for(made))
    return batch.edited_files(log)


def degraded_plan(spark, sf_dir):
    return edits.degraded(corpus.event_plans(spark, sf_dir))


def _single_edit(*strategies: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        chosen = corpus.event_plans(spark, sf_dir).filter(F.col("strategy").isin(*strategies))
        done = edits.apply_each(corpus.code_files(spark, sf_dir), chosen)
        made = done.filter(F.col("error").isNull())
        return made.select(
            "plan_key",
            "repo",
            "path",
            F.sha2("after", 256).alias("sha256"),
            F.length("after").alias("length"),
        )

    return query


def edit_invalid(spark, sf_dir):
    done = edits.apply_each(corpus.code_files(spark, sf_dir), corpus.event_plans(spark, sf_dir))
    return done.filter(F.col("error").isNotNull()).select("plan_key", "repo", "path", "error")


def _event_log(spark, sf_dir):
    made = corpus.event_plans(spark, sf_dir)
    return batch.edit_log(corpus.code_files(spark, sf_dir), made, corpus.verdicts_for(made))


def edit_batch(spark, sf_dir):
    versions = batch.file_versions(_event_log(spark, sf_dir))
    return versions.select(
        "repo",
        "path",
        "version",
        "seq",
        "plan_key",
        "step",
        F.sha2("before", 256).alias("before_sha256"),
        "sha256",
    )


def edited_files(spark, sf_dir):
    return batch.edited_files(_event_log(spark, sf_dir))


def rollback(spark, sf_dir):
    """Roll back the edited files named by the base snapshot."""
    named = corpus.code_files(spark, sf_dir, "base").select("repo", "path")
    return batch.rolled_back_files(_event_log(spark, sf_dir), named)


def rollback_all(spark, sf_dir):
    return batch.rolled_back_files(_event_log(spark, sf_dir))


def outcomes(spark, sf_dir):
    return batch.outcomes(_event_log(spark, sf_dir))


def outcomes_repeated_verdicts(spark, sf_dir):
    """Tests ran twice after each plan; it stands if both runs passed."""
    made = corpus.event_plans(spark, sf_dir)
    twice = made.select(
        "plan_key", F.expr(corpus.SECOND_PASSED).alias("passed"), F.expr(corpus.VERDICT_OUTPUT).alias("output")
    ).union(made.select("plan_key", F.expr(corpus.VERDICT_PASSED), F.expr(corpus.VERDICT_OUTPUT)))
    return batch.outcomes(batch.edit_log(corpus.code_files(spark, sf_dir), made, twice))


def outcomes_untested(spark, sf_dir):
    """Tests switched off: every plan that can be applied stands."""
    made = corpus.event_plans(spark, sf_dir)
    log = batch.edit_log(
        corpus.code_files(spark, sf_dir), made, corpus.verdicts_for(made), run_tests=False
    )
    return batch.outcomes(log)


def outcomes_left_edited(spark, sf_dir):
    """The same edits without automatic rollback: failed plans stay in the files."""
    made = corpus.event_plans(spark, sf_dir)
    log = batch.edit_log(
        corpus.code_files(spark, sf_dir), made, corpus.verdicts_for(made), auto_rollback=False
    )
    return batch.outcomes(log)


def unified_diffs(spark, sf_dir):
    """The diff of every plan of the batch."""
    return batch.outcomes_with_diff(_event_log(spark, sf_dir))


def snapshot_diffs(spark, sf_dir):
    """The diff of every file both snapshots have."""
    now = corpus.code_files(spark, sf_dir)
    was = corpus.code_files(spark, sf_dir, "base").withColumnRenamed("content", "was")
    both = now.join(was, ["repo", "path"])
    return linediff.unified_diffs(both, ["repo", "path"], "was", "content", "path").select("repo", "path", "diff")


def diff_lines(spark, sf_dir):
    return review.diff_lines(corpus.code_diffs(spark, sf_dir))


def diff_lines_by_range(spark, sf_dir):
    return review.ranged_diff_lines(review.numbered_lines(corpus.code_diffs(spark, sf_dir)))


def _one_check(*checks: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        found = review.line_comments(corpus.code_diffs(spark, sf_dir))
        return found.filter(F.col("rule").isin(*checks)).select(
            "diff_id", "pos", "file", "severity", "message"
        )

    return query


def review_comments(spark, sf_dir):
    return review.line_comments(corpus.code_diffs(spark, sf_dir))


def review_scores(spark, sf_dir):
    reports = review.review_reports(corpus.code_diffs(spark, sf_dir))
    return reports.select("diff_id", "approved", "score", F.size("comments").alias("n_comments"))


def review_summary(spark, sf_dir):
    return review.review_reports(corpus.code_diffs(spark, sf_dir)).select("diff_id", "summary")


def review_body(spark, sf_dir):
    reports = review.review_reports(corpus.code_diffs(spark, sf_dir))
    about = F.concat(F.lit("Change set "), F.col("diff_id").cast("string"))
    return review.review_bodies(reports, about)


def _texts(spark, sf_dir):
    columns = {
        "documents": ("doc_id", "0", "text"),
        "pages": ("page_id", "0", "html"),
        "conversations": ("conv_id", "turn", "text"),
    }
    parts = [
        corpus.table(spark, sf_dir, name).select(
            F.lit(name).alias("kind"),
            F.col(key).alias("id"),
            F.expr(part).cast("bigint").alias("part"),
            F.col(text).alias("text"),
        )
        for name, (key, part, text) in columns.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def text_line_checks(spark, sf_dir):
    """Documents, pages and conversations checked as if every line had been added."""
    return review.added_text_comments(_texts(spark, sf_dir), "kind", "id", "part")


def _repair_run(spark, sf_dir):
    """Scan, plan and edit; what two consumers read is written once."""
    scanned = written(_scanned(spark, sf_dir), "scanned")
    made = written(repair_plans(scan.findings(scanned)), "plans")
    # Only files that mention an except clause can have a repair plan.
    files = corpus.code_files(spark, sf_dir).filter(F.contains("content", F.lit("except")))
    log = batch.edit_log(files, made, corpus.verdicts_for(made))
    return scanned, batch.outcomes_with_diff(log)


def repair_diffs(spark, sf_dir):
    """The diff of every repair plan that stands."""
    _, done = _repair_run(spark, sf_dir)
    return done.filter(F.col("diff") != "").select("repo", "path", "seq", "plan_key", "diff")


def repair_reviews(spark, sf_dir):
    """The review of every repair plan that stands."""
    _, done = _repair_run(spark, sf_dir)
    reports = review.outcome_reports(done.filter(F.col("diff") != ""))
    return reports.select("repo", "path", "plan_key", "approved", "score", "summary")


def failed_reports(spark, sf_dir):
    _, done = _repair_run(spark, sf_dir)
    return review.outcome_reports(done).filter(F.startswith("summary", F.lit("Refactoring failed"))).select(
        "repo", "path", "plan_key", "approved", "score", "summary"
    )


def run_report(spark, sf_dir):
    scanned, done = _repair_run(spark, sf_dir)
    reports = review.outcome_reports(done)
    return report.run_report(scanned, reports, duration=F.lit(RUN_SECONDS))


def run_report_budget(spark, sf_dir):
    """The same run under a token budget that some repos exceed."""
    scanned, done = _repair_run(spark, sf_dir)
    reports = review.outcome_reports(done)
    return report.run_report(scanned, reports, budget=TOKEN_BUDGET, duration=F.lit(RUN_SECONDS))


def incremental_run_report(spark, sf_dir):
    """The default run: what changed since the base snapshot, under a token budget."""
    return audit_run(
        corpus.code_files(spark, sf_dir),
        base=corpus.code_files(spark, sf_dir, "base"),
        verdicts=corpus.verdicts_for,
        budget=TOKEN_BUDGET,
        duration=F.lit(RUN_SECONDS),
    ).report


def repair_bodies(spark, sf_dir):
    """The review text of every repair, rejected ones included."""
    run = audit_run(corpus.code_files(spark, sf_dir), verdicts=corpus.verdicts_for)
    about = F.concat(F.lit("Repair of "), F.col("path"))
    return review.review_bodies(run.reports, about, keys=("plan_key",))


def run_report_json(spark, sf_dir):
    return report.as_json(run_report(spark, sf_dir))


def stream_findings(spark, sf_dir):
    """Every event arrives as a small file; findings are appended to a table."""
    schema = corpus.table(spark, sf_dir, "events").schema
    arriving = corpus.event_files(
        continuous.stream_rows(spark, f"{sf_dir}/events*.parquet", schema)
    )
    found = continuous.stream_findings(arriving)
    sink = fresh_dir(spark, "findings")
    continuous.append_available(found, sink, fresh_dir(spark, "findings-progress"))
    return spark.read.schema(found.schema).parquet(sink)


def stream_changed_findings(spark, sf_dir):
    """The base snapshot arrives, then the current one; files that arrive unchanged emit
    nothing, changed ones replace their findings. Findings of each file's latest version."""
    where, sink, progress = (fresh_dir(spark, n) for n in ("arrivals", "changed", "changed-progress"))
    for arrival, snapshot in enumerate(("base", "current")):
        files = corpus.code_files(spark, sf_dir, snapshot).withColumn("arrival", F.lit(arrival).cast("long"))
        files.write.mode("append").parquet(where)
        schema = spark.read.parquet(where).schema
        continuous.keep_changed(continuous.stream_rows(spark, where, schema), "arrival", sink, progress)
    template = continuous.changed_findings(
        continuous.changed_only(spark.read.parquet(where).limit(0), "arrival")
    )
    return continuous.latest_findings(spark, sink, template.schema)


def stream_severity_totals(spark, sf_dir):
    """Running totals of findings per severity over the stream of events, as last handed on."""
    schema = corpus.table(spark, sf_dir, "events").schema
    arriving = corpus.event_files(continuous.stream_rows(spark, f"{sf_dir}/events*.parquet", schema))
    sink = fresh_dir(spark, "totals")

    def write(totals, batch_id):
        totals.write.mode("overwrite").parquet(sink)

    continuous.keep_severity_totals(continuous.stream_findings(arriving), write, fresh_dir(spark, "totals-progress"))
    return spark.read.parquet(sink)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lang_inventory": lang_inventory,
    "excluded_dirs": excluded_dirs,
    "path_extensions": path_extensions,
    "decoded_text": decoded_text,
    "file_metrics": file_metrics,
    "py_facts": py_facts,
    "py_facts_any_line_end": py_facts_any_line_end,
    "py_facts_by_content": py_facts_by_content,
    "py_bare_except": _one_rule("bare_except"),
    "py_mutable_default": _one_rule("mutable_default"),
    "py_long_function": _one_rule("long_function"),
    "ts_any": _one_rule("ts_any"),
    "ts_missing_return": _one_rule("ts_missing_return"),
    "js_var": _one_rule("js_var"),
    "js_console": _one_rule("js_console"),
    "go_ignored_error": _one_rule("go_ignored_error"),
    "findings_union": findings_union,
    "scan_summary": scan_summary,
    "scan_summary_snapshots": scan_summary_snapshots,
    "severity_counts": severity_counts,
    "js_severity": js_severity,
    "token_budget": token_budget,
    "clean_gate": clean_gate,
    "toolchain": toolchain,
    "linters": linters,
    "changed_files": changed_files,
    "stored_changed_files": stored_changed_files,
    "incremental_findings": incremental_findings,
    "path_list_scan": path_list_scan,
    "plans": plans,
    "gated_plans": gated_plans,
    "edited_files_budget": edited_files_budget,
    "degraded_plan": degraded_plan,
    "edit_inline_fix": _single_edit("inline-fix"),
    "edit_rename": _single_edit("rename"),
    "edit_extract_function": _single_edit("extract-function"),
    "edit_restructure": _single_edit("restructure"),
    "edit_invalid": edit_invalid,
    "edit_batch": edit_batch,
    "edited_files": edited_files,
    "rollback": rollback,
    "rollback_all": rollback_all,
    "outcomes": outcomes,
    "outcomes_left_edited": outcomes_left_edited,
    "outcomes_repeated_verdicts": outcomes_repeated_verdicts,
    "outcomes_untested": outcomes_untested,
    "unified_diffs": unified_diffs,
    "snapshot_diffs": snapshot_diffs,
    "diff_lines": diff_lines,
    "diff_lines_by_range": diff_lines_by_range,
    "added_credential": _one_check("credential"),
    "added_todo": _one_check("todo"),
    "added_long_line": _one_check("long_line"),
    "added_print": _one_check("print_call"),
    "removed_lines": _one_check("removed_handling", "removed_annotation"),
    "review_comments": review_comments,
    "review_scores": review_scores,
    "review_summary": review_summary,
    "review_body": review_body,
    "text_line_checks": text_line_checks,
    "repair_diffs": repair_diffs,
    "repair_reviews": repair_reviews,
    "failed_reports": failed_reports,
    "run_report": run_report,
    "run_report_budget": run_report_budget,
    "incremental_run_report": incremental_run_report,
    "repair_bodies": repair_bodies,
    "run_report_json": run_report_json,
    "stream_findings": stream_findings,
    "stream_changed_findings": stream_changed_findings,
    "stream_severity_totals": stream_severity_totals,
}
