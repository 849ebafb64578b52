import random

from pyspark.sql import functions as F

from auditlake.functions import review as R
from auditlake.operators import review

HEAD = "--- a/file.py\n+++ b/file.py\n@@ -1 +1 @@\n"


def reports(spark, diffs):
    rows = spark.createDataFrame(list(diffs.items()), "diff_id string, diff string")
    return {r.diff_id: r for r in review.review_reports(rows).collect()}


def rules(spark, *texts):
    diff = HEAD + "\n".join(texts)
    rows = spark.createDataFrame([("d", diff)], "diff_id string, diff string")
    found = {r.pos: r.rule for r in review.line_comments(rows).collect()}
    return [found.get(i + 3) for i in range(len(texts))]


def test_clean_diff_is_approved(spark):
    diff = HEAD + " rows = load(path)\n-total = len(rows)\n+total = sum(r.size for r in rows)\n"
    report = reports(spark, {"d": diff})["d"]
    assert report.approved and report.score == 100 and report.summary == "Score: 100/100 | APPROVED"


def test_credential_is_rejected(spark):
    diff = HEAD + "-secret = vault.read(name)\n+secret = 'tops3cret'\n"
    report = reports(spark, {"d": diff})["d"]
    assert not report.approved and report.score == 67
    assert [(c.severity, c.file, c.line) for c in report.comments] == [("critical", "file.py", 0)]


def test_long_line_warns(spark):
    report = reports(spark, {"d": HEAD + "-x = 1\n+" + "y" * 120 + "\n"})["d"]
    assert [(c.severity, c.message) for c in report.comments] == [
        ("warning", "Line too long (120 chars, limit: 100).")
    ]


def test_blank_diffs(spark):
    got = reports(spark, {"a": "", "b": " \n\t\u2003\x1c"})
    assert {(r.approved, r.score, r.summary, len(r.comments)) for r in got.values()} == {
        (True, 100, "No changes to review.", 0)
    }


def test_removed_handling_is_critical(spark):
    diff = HEAD + " for job in jobs:\n-    try:\n-        job.run()\n-    finally:\n-        job.close()\n+    job.run()\n"
    assert [c.rule for c in reports(spark, {"d": diff})["d"].comments] == ["removed_handling"]


def test_added_line_checks(spark):
    texts = {
        "+token: 'x'": "credential",
        "+to\u212aen = 'x'": "credential",
        "+pa\u017fsword\u2003=\"x\"": "credential",
        "+api_key = ''": None,
        "+secret = x": None,
        "+# todo": "todo",
        "+mastodon TODO2": None,
        "+\u00e9todo": None,
        "+TODO\u00e9": None,
        "+todo_": None,
        "+fixme": None,
        "+" + "x" * 100: None,
        "+" + "x" * 101: "long_line",
        "+\u3000print(x)": "print_call",
        "+x; print(x)": None,
        "+# print(x)": None,
        "+secret='k' # TODO " + "x" * 101: "credential",
        "+TODO print(" + "x" * 101: "todo",
        "+++x TODO": "todo",
        " TODO": None,
    }
    assert rules(spark, *texts) == list(texts.values())


def test_removed_line_checks(spark):
    texts = {
        "-try :": "removed_handling",
        "-except \u00e9rror:": "removed_handling",
        "-except:": None,
        "-except E as e:": None,
        "-raise E -> int": "removed_handling",
        "-def f() -> int:": "removed_annotation",
        "-def f() ->\u2003x": "removed_annotation",
        "-def f() -> 'x'": None,
        "-retry:": "removed_handling",
        "-TODO": None,
    }
    assert rules(spark, *texts) == list(texts.values())


def test_sections(spark):
    diff = "+before TODO\n--- x/y/a.py \n+++ b\n@@ x\n+1\n--- \n-2\n\n--- a/b\n+++3"
    rows = spark.createDataFrame([("d", diff), ("none", "+x"), ("blank", "")], "diff_id string, diff string")
    got = [tuple(r)[1:] for r in review.diff_lines(rows).orderBy("pos").collect()]
    assert got == [
        (3, "y/a.py", "@", "@ x"), (4, "y/a.py", "+", "1"), (6, "", "-", "2"), (7, "", "", ""), (9, "b", "+", "++3"),
    ]


def test_many_sections_and_lines_in_one_diff(spark):
    """A diff with as many headers as lines is read in linear time."""
    n = 20_000
    diff = "\n".join(f"--- a/f{i}\n+++ b/f{i}\n+TODO" for i in range(n))
    rows = spark.createDataFrame([("d", diff)], "diff_id string, diff string")
    found = review.line_comments(rows).agg(F.count("*"), F.countDistinct("file")).first()
    assert tuple(found) == (n, n)


def points(severities):
    """The score in Python floats, added from left to right."""
    dims = dict.fromkeys(R.WEIGHTS, 1.0)
    for severity in severities:
        hit = {"critical": ("correctness", "safety"), "warning": ("safety",)}.get(severity, ("style",))
        for name in hit:
            dims[name] = max(0.0, dims[name] - R.PENALTY[severity])
    total = 0.0
    for name, weight in R.WEIGHTS.items():
        total += dims[name] * weight
    return int(total * 100)


def test_scores_equal_float_arithmetic(spark):
    rng = random.Random(1)
    lists = [["critical"] * c + ["warning"] * w + ["suggestion"] * s for c in range(4) for w in range(12) for s in range(30)]
    for one in lists[::2]:
        rng.shuffle(one)
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, s array<string>")
    got = {r.i: r.p for r in rows.select("i", R.score(F.col("s")).alias("p")).collect()}
    assert [got[i] for i in range(len(lists))] == [points(one) for one in lists]
    by_kind = {}
    for one, i in zip(lists, range(len(lists))):
        by_kind.setdefault(("critical" in one, "suggestion" in one), []).append(got[i])
    assert max(by_kind[(True, False)] + by_kind[(True, True)]) == 67
    assert min(by_kind[(False, False)]) == 75
    assert min(by_kind[(False, True)]) == 55


def test_summary_lists_severities_in_order(spark):
    diff = HEAD + "+print(1)\n+TODO\n+print(2)\n-raise E\n"
    report = reports(spark, {"d": diff})["d"]
    assert report.summary == (
        f"Score: {report.score}/100 | CHANGES REQUESTED | Comments: 4 |   critical: 1 |   suggestion: 1 |   warning: 2"
    )
    assert report.score == points(["warning", "suggestion", "warning", "critical"])


def test_approval_threshold_is_a_parameter(spark):
    rows = spark.createDataFrame([("d", HEAD + "+api_key='x'")], "diff_id string, diff string")
    assert review.review_reports(rows, approve_from=60).first().approved


def test_body(spark):
    rows = spark.createDataFrame([("bad", HEAD + "+print(1)\n-raise E"), ("good", HEAD)], "diff_id string, diff string")
    bodies = review.review_bodies(review.review_reports(rows), F.lit("Fixed 1 issue"), "Review")
    got = {r.diff_id: r.body for r in bodies.collect()}
    assert got["good"] == (
        "## Review\n\n**Status:** ✅ Approved\n**Score:** 100/100\n\n### Refactoring Summary\nFixed 1 issue\n\n"
        "### Review Comments\n\nNo issues found. Clean refactoring."
    )
    assert got["bad"].endswith(
        "### Review Comments\n\n"
        "- **[WARNING]** (file.py): Added print() statement detected.\n"
        "  → Replace with proper logging if this is for production.\n"
        "- **[CRITICAL]** (file.py): Removal of exception handling detected.\n"
        "  → Ensure the error is still handled appropriately."
    )
    assert "❌ Changes Requested" in got["bad"]


def test_review_moves_no_rows(spark):
    rows = spark.createDataFrame([("d", HEAD)], "diff_id string, diff string")
    assert "Exchange" not in review.review_reports(rows)._jdf.queryExecution().executedPlan().toString()


def test_own_diffs_lose_two_path_characters(spark):
    """Diffs of edits carry bare paths; the header rule still drops six characters."""
    rows = spark.createDataFrame([("d", "--- src/a.py\n+++ src/a.py\n+TODO")], "diff_id string, diff string")
    assert review.line_comments(rows).first().file == "c/a.py"


def _both(spark, rows, range_lines):
    whole = sorted(tuple(r) for r in review.diff_lines(rows).collect())
    ranged = review.ranged_diff_lines(review.numbered_lines(rows), range_lines)
    return whole, sorted(tuple(r) for r in ranged.collect())


def test_ranged_diff_lines_equal_whatever_the_range(spark):
    diff = "+before TODO\n--- x/y/a.py \n+++ b\n@@ x\n+1\n--- \n-2\n\n--- a/b\n+++3"
    pick = random.Random(7)
    kinds = ["--- a/f", "--- b/g ", "+++ b/f", "+x", "-y", " z", "", "@@ -1 +1 @@", "+++ ", "---"]
    diffs = [("d", diff), ("none", "+x"), ("blank", ""), ("null", None)]
    diffs += [(f"r{k}", "\n".join(pick.choice(kinds) for _ in range(pick.randint(1, 60)))) for k in range(30)]
    rows = spark.createDataFrame(diffs, "diff_id string, diff string")
    for range_lines in (1, 2, 3, 7, 64, 65_536):
        whole, ranged = _both(spark, rows, range_lines)
        assert ranged == whole and whole


def test_ranged_diff_lines_of_the_corpus(spark):
    from auditlake.registry import corpus

    rows = corpus.code_diffs(spark, "/root/testdata/sf0.001")
    whole, ranged = _both(spark, rows, 5)
    assert ranged == whole and whole
