"""The composed run: what changed is scanned, gated, planned, edited, reviewed and reported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from auditlake.operators import batch, inventory, report, review, scan
from auditlake.plans.repair import repair_plans
from auditlake.session import written
from auditlake.sources import snapshots


@dataclass(frozen=True)
class AuditRun:
    """The tables of one run; ``scanned``, ``plans`` and ``log`` are stored, the rest derived."""

    scanned: DataFrame
    gate: DataFrame
    plans: DataFrame
    log: DataFrame
    outcomes: DataFrame
    reports: DataFrame
    report: DataFrame


def audit_run(
    files: DataFrame,
    base: DataFrame | None = None,
    verdicts: Callable[[DataFrame], DataFrame] | None = None,
    budget: int | None = None,
    run_tests: bool = True,
    auto_rollback: bool = True,
    duration: Column | None = None,
) -> AuditRun:
    """Run over ``files(repo, path, content)``: in full, or what changed since ``base``.

    ``verdicts`` takes the stored plans and returns how their tests went.  The tables that
    several steps read are cut points here, so the corpus is parsed once.
    """
    if base is None:
        sources = inventory.source_files(files)
    else:
        visited = snapshots.incremental_scan_set(files, base)
        sources = inventory.source_files(visited, prune=False)
    scanned = written(scan.scan_files(sources), "scanned")
    gate = scan.token_budget_gate(scan.scan_summary(scanned), budget)
    plans = written(repair_plans(scan.findings(scanned), gate=gate), "plans")
    judged = verdicts(plans) if verdicts else None
    log = written(
        batch.edit_log(files, plans, judged, run_tests=run_tests, auto_rollback=auto_rollback), "log"
    )
    outcomes = batch.outcomes_with_diff(log)
    reports = review.outcome_reports(outcomes)
    rolled_up = report.run_report(scanned, reports, budget=budget, duration=duration)
    return AuditRun(scanned, gate, plans, log, outcomes, reports, rolled_up)
