import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions.udiff import unified_diff
from auditlake.operators import batch, edits

SAMPLE = "import queue\n\n\ndef drain(jobs):\n    while True:\n        try:\n            jobs.get_nowait().run()\n        except:\n            return\n"

PLAN = (
    "plan_key string, repo string, path string, seq int, strategy string, original_snippet string, "
    "target_snippet string, line_start int, line_end int, explanation string"
)


def plan(key, path, strategy, original, target, start=1, end=1, seq=None, why="why"):
    return (key, "r", path, int(key) if seq is None else seq, strategy, original, target, start, end, why)


def after_edit(text, strategy, original, target, start, end):
    """The edit in plain Python, on lists of lines."""
    if strategy == "rename":
        return target.join(text.split(original)) if original else text.replace(original, target)
    if strategy != "restructure":
        return text.replace(original, target, 1)
    rows = text.split("\n")
    kept = rows[: start - 1] if start > 1 else []
    rest = rows[end:] if end < len(rows) else []
    return "\n".join(kept + [target] + rest)


TEXTS = ["", "\n", "a", "a\n", "aXa\nb\n\naXa", "x\ny\nz", "é𝒳a\n𝒳", SAMPLE]
SNIPPETS = ["", "a", "aX", "\n", "x\ny", "𝒳", "except:", "zz"]


def cases():
    rng = random.Random(3)
    made = []
    for i in range(400):
        made.append(
            (
                i,
                rng.choice(TEXTS),
                rng.choice(["inline-fix", "extract-function", "rename", "restructure", "restructure"]),
                rng.choice(SNIPPETS),
                rng.choice(SNIPPETS),
                rng.randint(-1, 9),
                rng.randint(-3, 9),
            )
        )
    return made


def test_single_edits_equal_the_model(spark):
    made = cases()
    files = spark.createDataFrame([("r", str(c[0]), c[1]) for c in made], "repo string, path string, content string")
    plans = spark.createDataFrame([plan(str(i), str(i), *rest) for i, _, *rest in made], PLAN)
    done = {int(r.plan_key): r for r in edits.apply_each(files, plans).collect()}
    for i, text, *rest in made:
        assert done[i].error is None
        assert done[i].after == after_edit(text, *rest), (text, rest)


def test_recorded_changes_equal_the_model():
    for _, text, *rest in cases():
        assert batch._change(text, *rest).on(text) == after_edit(text, *rest), (text, rest)


def test_invalid_plans_are_reported_not_raised(files, spark):
    plans = spark.createDataFrame(
        [
            plan("1", "a", "reformat", "x", "y"),
            plan("2", "b", "inline-fix", "x", "y"),
            plan("3", "a", "inline-fix", None, "y"),
            plan("4", "a", "restructure", None, "y", None, 1),
            plan("5", "a", "restructure", None, "y", 1, 1),
            plan("6", "a", None, "x", "y"),
        ],
        PLAN,
    )
    expected = {
        "1": "Unknown strategy: reformat",
        "2": "Cannot refactor: b not found",
        "3": "Incomplete plan",
        "4": "Incomplete plan",
        "5": None,
        "6": "Unknown strategy: None",
    }
    single = edits.apply_each(files({"a": "x"}), plans).collect()
    assert {r.plan_key: r.error for r in single} == expected
    log = batch.edit_log(files({"a": "x"}), plans)
    assert {r.plan_key: r.error for r in batch.outcomes(log).collect()} == expected


def test_present_tells_unreadable_from_missing(spark):
    files = spark.createDataFrame([("r", "a", "x"), ("r", "c", None)], "repo string, path string, content string")
    plans = spark.createDataFrame([plan("1", "a", "inline-fix", "x", "y"), plan("2", "b", "inline-fix", "x", "y"),
                                   plan("3", "c", "inline-fix", "x", "y")], PLAN)
    got = {r.plan_key: (r.present, r.error, r.after) for r in edits.apply_each(files, plans).collect()}
    assert got == {
        "1": (True, None, "y"),
        "2": (False, "Cannot refactor: b not found", None),
        "3": (True, "Cannot refactor: c not found", None),
    }


def test_degraded_plans(spark):
    plans = spark.createDataFrame(
        [plan("1", "a", "restructure", "l1\nl2", "t1\nt2", 2, 3), plan("2", "a", "rename", "x", "y")], PLAN
    )
    (row,) = edits.degraded(plans).collect()
    assert (row.strategy, row.original_snippet, row.target_snippet) == ("inline-fix", "l1", "t1")
    assert (row.line_start, row.line_end, row.explanation) == (2, 3, "Degraded fix for: why")


def test_inline_fix_diff(files, spark):
    plans = spark.createDataFrame(
        [plan("1", "drain.py", "inline-fix", "        except:", "        except queue.Empty:", 8, 8)], PLAN
    )
    (row,) = batch.outcomes_with_diff(batch.edit_log(files({"drain.py": SAMPLE}), plans)).collect()
    assert row.success and row.diff.startswith("--- drain.py\n+++ drain.py\n@@ ")
    assert "-        except:\n+        except queue.Empty:\n" in row.diff


def test_rename_diff(files, spark):
    plans = spark.createDataFrame([plan("1", "o.go", "rename", "fetchRow", "readRow")], PLAN)
    log = batch.edit_log(files({"o.go": "row := fetchRow(id)\nlog(row)\nreturn fetchRow(next)\n"}), plans)
    assert batch.outcomes_with_diff(log).first().diff.count("+") == 2 + 3 + 1


def test_diff_of_a_file_without_last_newline(spark):
    rows = spark.createDataFrame([("a", "b", "p"), ("a\n", "a\n", "p"), ("", "x\n", "p")], "b string, a string, p string")
    got = [r[0] for r in rows.select(unified_diff("b", "a", "p")).collect()]
    assert got == [
        "--- p\n+++ p\n@@ -1 +1 @@\n-a+b",
        "",
        "--- p\n+++ p\n@@ -0,0 +1 @@\n+x\n",
    ]


def test_rollback(files, spark):
    plans = spark.createDataFrame(
        [plan("1", "a", "rename", "x", "y"), plan("2", "a", "rename", "y", "z"), plan("3", "b", "rename", "x", "y")],
        PLAN,
    )
    tree = files({"a": "x", "b": "x", "c": "x"})
    log = batch.edit_log(tree, plans)
    assert {r.path: r.content for r in batch.edited_files(log).collect()} == {"a": "z", "b": "y"}
    assert {r.path: r.content for r in batch.rolled_back_files(log).collect()} == {"a": "y", "b": "x"}
    one = batch.rolled_back_files(log, tree.filter("path = 'b'"))
    assert {r.path: r.content for r in one.collect()} == {"b": "x"}


def walk(content, plans, verdicts, auto_rollback, run_tests):
    """Apply plans in order in plain Python: outcomes by key, versions, and the rolled-back text."""
    outcomes, versions, undo = {}, [], None
    for key, strategy, original, target, start, end in plans:
        if content is None:
            outcomes[key] = (False, False, "Cannot refactor: f not found", None)
            continue
        if strategy == "reformat":
            outcomes[key] = (False, False, "Unknown strategy: reformat", None)
            versions.append((content, content))
            undo = content
            continue
        passed, output = verdicts.get(key, (True, "")) if run_tests else (True, "")
        before, content = content, after_edit(content, strategy, original, target, start, end)
        outcomes[key] = (True, False, None, (before, content))
        if not passed and not auto_rollback:
            outcomes[key] = (False, False, f"Tests failed: {output[:200]}", None)
        elif not passed and strategy == "restructure":
            versions.append((before, content))
            before, content = content, content.replace(original.split("\n")[0], target.split("\n")[0], 1)
            outcomes[key] = (True, False, None, (before, content))
        elif not passed:
            content = before
            outcomes[key] = (True, True, None, None)
        versions.append((before, content))
        undo = before
    return outcomes, versions, undo, content


@pytest.mark.parametrize("auto_rollback, run_tests, segment", [(True, True, 1), (False, True, 3), (True, False, 64)])
def test_batches_equal_the_model(spark, auto_rollback, run_tests, segment):
    """Random batches on many files; segments so short that most files have several."""
    rng = random.Random(segment)
    contents, plans, verdicts, expected = [], [], [], {}
    for f in range(40):
        repo, text = f"r{f}", (None if f % 10 == 9 else rng.choice(TEXTS))
        if text is not None:
            contents.append((repo, "f", text))
        mine, judged = [], {}
        favourite = SNIPPETS[f // 2 % len(SNIPPETS)]
        for seq in range(rng.randint(1, 150 if f == 0 else 12)):
            key = f"{f}-{seq}"
            strategy = rng.choice(["inline-fix", "extract-function", "rename", "restructure", "reformat"])
            target = rng.choice([s for s in SNIPPETS if len(s) < 3])
            original = favourite if f % 2 else rng.choice(SNIPPETS)
            if f % 4 == 1:
                strategy = "inline-fix"
            body = (strategy, original, target, rng.randint(0, 5), rng.randint(0, 5))
            mine.append((key, *body))
            plans.append((key, repo, "f", seq, *body, "why"))
            if rng.random() < 0.6:
                judged[key] = (rng.random() < 0.5, "o" * rng.randint(0, 300))
                verdicts.append((key, *judged[key]))
        expected[repo] = walk(text, mine, judged, auto_rollback, run_tests)
    rng.shuffle(plans)
    log = batch.edit_log(
        spark.createDataFrame(contents, "repo string, path string, content string"),
        spark.createDataFrame(plans, PLAN),
        spark.createDataFrame(verdicts, "plan_key string, passed boolean, output string"),
        run_tests=run_tests,
        auto_rollback=auto_rollback,
        segment_size=segment,
    ).cache()
    by_repo = {}
    for row in batch.outcomes_with_diff(log).collect():
        by_repo.setdefault(row.repo, {})[row.plan_key] = row
    bare = {r.plan_key: (r.success, r.rolled_back, r.error) for r in batch.outcomes(log).collect()}
    versions = {}
    for row in batch.file_versions(log).orderBy("repo", "version").collect():
        versions.setdefault(row.repo, []).append(row)
    undone = {r.repo: r.content for r in batch.rolled_back_files(log).collect()}
    final = {r.repo: r.content for r in batch.edited_files(log).collect()}
    from auditlake.functions.udiff import diff_text

    for repo, (outcomes, steps, undo, content) in expected.items():
        got = by_repo[repo]
        assert set(got) == set(outcomes)
        for key, (success, rolled_back, error, change) in outcomes.items():
            assert (got[key].success, got[key].rolled_back, got[key].error) == (success, rolled_back, error)
            assert bare[key] == (success, rolled_back, error)
            assert got[key].diff == (diff_text(*change, "f") if change else "")
        assert [(r.before, r.content) for r in versions.get(repo, [])] == steps
        assert [r.version for r in versions.get(repo, [])] == list(range(1, len(steps) + 1))
        assert undone.get(repo) == undo
        assert final.get(repo) == (content if steps else None)


def test_a_much_edited_file_is_replayed_in_parallel(spark, monkeypatch):
    """One file with nearly all plans: few full texts in the log, many replay groups."""
    n = 3000
    text = "\n".join(f"word{i} old" for i in range(n))
    plans = spark.range(n).selectExpr(
        "cast(id as string) plan_key", "'r' repo", "'hot' path", "cast(id as int) seq", "'inline-fix' strategy",
        "'old' original_snippet", "'new' target_snippet", "1 line_start", "1 line_end",
    )
    files = spark.createDataFrame([("r", "hot", text)], "repo string, path string, content string")
    log = batch.edit_log(files, plans, segment_size=4).cache()
    heads = log.filter("base is not null and step <> 'final'")
    assert 64 < heads.count() < 64 * 6
    assert heads.agg(F.max("segment")).first()[0] == heads.count() - 1
    last = batch.file_versions(log).filter(f"version = {n}").first()
    assert last.content == text.replace("old", "new")
    assert batch.edited_files(log).first().content == last.content


def test_results_do_not_depend_on_partitioning(files, spark):
    tree = files({f"{i}.py": SAMPLE for i in range(20)})
    plans = spark.createDataFrame(
        [plan(str(i), f"{i % 20}.py", "inline-fix", "print", f"log{i}", seq=i) for i in range(80)], PLAN
    )
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        log = batch.edit_log(tree.repartition(int(n)), plans.repartition(int(n)))
        results.append(sorted(batch.outcomes_with_diff(log).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_two_contents_for_a_file_are_refused(files, spark):
    plans = spark.createDataFrame([plan("1", "a.py", "rename", "x", "y")], PLAN)
    twice = files({"a.py": "x"}).union(files({"a.py": "x x"}))
    with pytest.raises(Exception, match="two contents"):
        batch.edit_log(twice, plans).collect()


def test_several_verdicts_are_one(files, spark):
    plans = spark.createDataFrame([plan("1", "a.py", "rename", "x", "y"), plan("2", "b.py", "rename", "x", "y")], PLAN)
    rows = [("1", True, "ok"), ("1", False, "e" * 300), ("2", True, "ok"), ("2", None, None)]
    verdicts = spark.createDataFrame(rows, "plan_key string, passed boolean, output string")
    log = batch.edit_log(files({"a.py": "x", "b.py": "x"}), plans, verdicts, auto_rollback=False)
    got = {r.plan_key: (r.success, r.output) for r in log.filter("is_outcome").collect()}
    assert got == {"1": (False, "e" * 300), "2": (True, "ok")}
