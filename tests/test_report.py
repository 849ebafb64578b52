import json

from pyspark.sql import functions as F

from auditlake.operators import batch, inventory, report, review, scan
from auditlake.plans.repair import repair_plans

BARE = "try:\n    f()\nexcept:\n    pass\n"


def run(files_df, verdicts=None, **options):
    scanned = scan.scan_files(inventory.source_files(files_df))
    plans = repair_plans(scan.findings(scanned))
    if verdicts is not None:
        verdicts = verdicts(plans)
    outcomes = batch.outcomes_with_diff(batch.edit_log(files_df, plans, verdicts))
    return report.run_report(scanned, review.outcome_reports(outcomes), **options)


def rows(df):
    return {r.run_id: r for r in df.collect()}


def test_plans_come_from_bare_excepts_only(files):
    tree = files(
        {
            "a.py": BARE + "def f(a=[]):\n    pass\n",
            "b.py": "try:\n    f()\nexcept :  # why\n    pass\n",
            "c.js": "var x = 1",
            "d.go": "_ = f(error)",
        }
    )
    got = repair_plans(scan.findings(scan.scan_files(inventory.source_files(tree))), prefix="p").orderBy("path").collect()
    assert [
        (r.path, r.finding_id, r.seq, r.line_start, r.line_end, r.strategy, r.original_snippet, r.target_snippet, r.explanation)
        for r in got
    ] == [
        ("a.py", "p-anti-pattern-3", 1, 3, 3, "inline-fix", "except:", "except Exception:", "Fixed: Bare except clause"),
        ("b.py", "p-anti-pattern-3", 0, 3, 3, "inline-fix", "except :  # why", "except :  # why", "Fixed: Bare except clause"),
    ]
    assert len({r.plan_key for r in got}) == 2


def test_run_report(files, spark):
    tree = files({"a.py": BARE + BARE, "b.py": "# except: here\n" + BARE, "c.py": BARE.replace("except:", "except :")})
    tree = tree.unionByName(files({"x.go": "package x\n"}, repo="clean"))
    got = rows(run(tree, duration=F.lit(3.25)))
    assert got["clean"].summary == "No issues found. Codebase is clean."
    assert (got["clean"].success, got["clean"].tokens_consumed, got["clean"].duration_seconds) == (True, 0, 0.0)
    r = got["r"]
    # Two edits of a.py and the one that hits the comment in b.py; c.py's changes nothing.
    assert (r.files_scanned, r.findings, r.refactors_attempted, r.refactors_approved) == (3, 4, 4, 3)
    assert r.summary.split("\n")[:2] == ["Audit Complete", "  Duration: 3.2s"]
    assert r.summary.split("\n")[-1] == "  Status: ✅ All clear"


def test_the_comment_is_edited_when_it_comes_first(files):
    tree = files({"b.py": "# except: here\n" + BARE})
    plans = repair_plans(scan.findings(scan.scan_files(inventory.source_files(tree))))
    edited = batch.edited_files(batch.edit_log(tree, plans)).first().content
    assert edited == "# except Exception: here\n" + BARE


def test_thousands_and_json(files):
    tree = files({"a.py": BARE + "# " + "x" * 8000})
    (row,) = report.as_json(run(tree)).collect()
    parsed = json.loads(row.json)
    assert list(parsed) == report.JSON_FIELDS
    assert parsed["tokens_consumed"] == (len(BARE) + 8002) // 4
    assert "  Tokens consumed: 2,008\n" in parsed["summary"]


def test_budget_ends_the_run_early(files):
    tree = files({"a.py": BARE})
    row = run(tree, budget=5, duration=F.lit(9.0)).first()
    assert (row.success, row.refactors_attempted, row.refactors_approved, row.tokens_consumed, row.duration_seconds) == (
        False, 0, 0, 0, 0.0,
    )
    assert row.summary == f"Token budget exceeded ({len(BARE) // 4} > 5)"
    assert (row.files_scanned, row.findings) == (1, 1)


def test_rolled_back_and_failed_edits_are_rejected(files, spark):
    tree = files({"a.py": BARE, "b.py": BARE})

    def failing(plans):
        return plans.filter("path = 'a.py'").select("plan_key", F.lit(False).alias("passed"), F.lit("boom").alias("output"))

    scanned = scan.scan_files(inventory.source_files(tree))
    plans = repair_plans(scan.findings(scanned))
    outcomes = batch.outcomes_with_diff(batch.edit_log(tree, plans, failing(plans)))
    got = {r.path: r for r in review.outcome_reports(outcomes).collect()}
    assert (got["a.py"].approved, got["a.py"].score, got["a.py"].summary) == (False, 0, "Refactoring failed: None")
    assert (got["b.py"].approved, got["b.py"].score) == (True, 100)
    left = batch.outcomes_with_diff(batch.edit_log(tree, plans, failing(plans), auto_rollback=False))
    got = {r.path: r for r in review.outcome_reports(left).collect()}
    assert got["a.py"].summary == "Refactoring failed: Tests failed: boom"
