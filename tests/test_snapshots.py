from auditlake.operators import inventory, scan
from auditlake.sources import snapshots, tables


def paths(df):
    return {(r.repo, r.path) for r in df.select("repo", "path").collect()}


def two(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


NOW = [
    ("part", "same.py", "1"), ("part", "edited.py", "2"), ("part", "new.py", "3"), ("part", "dist/new.py", "4"),
    ("quiet", "a.py", "1"), ("quiet", "build/b.py", "2"),
    ("fresh", "a.py", "1"), ("fresh", "build/b.py", "2"),
    ("shrunk", "a.py", "1"), ("shrunk", "b.py", "1"),
]
WAS = [
    ("part", "same.py", "1"), ("part", "edited.py", "1"), ("part", "gone.py", "0"),
    ("quiet", "a.py", "1"), ("quiet", "build/b.py", "2"),
    ("shrunk", "a.py", "1"), ("shrunk", "b.py", "1"), ("shrunk", "c.py", "1"),
    ("dead", "a.py", "1"),
]


def test_changes(spark):
    rows = snapshots.changes(two(spark, NOW), two(spark, WAS)).filter("repo = 'part'").collect()
    assert {r.path: r.status for r in rows} == {
        "same.py": "same", "edited.py": "modified", "new.py": "added", "dist/new.py": "added", "gone.py": "deleted",
    }


def test_incremental_scan_set(spark):
    """Changed files of a changed repo, excluded directories included; all of a repo without
    changes or without a base; nothing of a repo that only lost files."""
    got = paths(snapshots.incremental_scan_set(two(spark, NOW), two(spark, WAS)))
    assert got == {
        ("part", "edited.py"), ("part", "new.py"), ("part", "dist/new.py"),
        ("quiet", "a.py"), ("fresh", "a.py"),
    }


def test_first_snapshot_is_scanned_in_full(files, spark):
    current = files({"test.py": "x = 1\n"})
    visited = snapshots.incremental_scan_set(current, current.limit(0))
    summary = scan.scan_summary(scan.scan_files(inventory.source_files(visited, prune=False)))
    assert summary.first().files_scanned == 1


def test_listed_scan_set(spark):
    listed = spark.createDataFrame(
        [("part", "same.py"), ("part", "dist/new.py"), ("part", "absent.py")], "repo string, path string"
    )
    got = paths(snapshots.listed_scan_set(two(spark, NOW), listed))
    assert got == {
        ("part", "same.py"), ("part", "dist/new.py"), ("quiet", "a.py"), ("fresh", "a.py"),
        ("shrunk", "a.py"), ("shrunk", "b.py"),
    }


def test_an_empty_list_means_a_full_scan(spark):
    files = two(spark, NOW)
    assert paths(snapshots.listed_scan_set(files, files.limit(0))) == paths(snapshots.full_scan_set(files))


def test_fetch_gives_the_same_rows_either_way(spark):
    files = two(spark, NOW)
    keys = files.filter("path like '%new%'").select("repo", "path")
    keys = keys.unionByName(keys)
    small, large = tables.fetch(files, keys), tables.fetch(files, keys, limit=0)
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.count() == 2
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_stored_snapshots_are_compared_without_a_shuffle(spark):
    tables.store_files(two(spark, NOW), "snap_now", 4)
    tables.store_files(two(spark, WAS), "snap_was", 4)
    now, was = spark.table("snap_now"), spark.table("snap_was")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changed = snapshots.changes(now, was)
        plan = changed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert "content" not in plan
        fetched = tables.fetch(now, changed.filter("status = 'added'"), limit=0)
        files_side = fetched._jdf.queryExecution().executedPlan().toString().split("snap_now")[0]
        assert "hashpartitioning" not in files_side
        assert changed.count() == snapshots.changes(two(spark, NOW), two(spark, WAS)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_repo_with_most_files(spark):
    rows = [("hot", f"d/{i}.py", str(i % 7)) for i in range(3000)] + [("cold", "a.py", "1")]
    base = [(r, p, "x" if int(c) == 3 else c) for r, p, c in rows]
    got = paths(snapshots.incremental_scan_set(two(spark, rows), two(spark, base)))
    assert got == {(r, p) for r, p, c in rows if c == "3"} | {("cold", "a.py")}


def test_stored_snapshots_compare_without_a_shuffle(spark):
    now = snapshots.stored(two(spark, NOW), "now", 4)
    was = snapshots.stored(two(spark, WAS), "was", 4)
    compared = snapshots.stored_changes(now, was)
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    plain = snapshots.changes(two(spark, NOW), two(spark, WAS))
    assert sorted(compared.collect()) == sorted(plain.collect())
    # Every call stores under a name of its own.
    again = snapshots.stored(two(spark, NOW), "now", 4)
    assert sorted(again.collect()) == sorted(now.collect())


def test_facts_by_content_parse_each_content_once(spark, tmp_path):
    store = str(tmp_path / "facts")
    code = "def f(x=[]):\n    try:\n        pass\n    except:\n        pass\n"
    first = two(spark, [("r", "a.py", code), ("r", "b.py", code), ("r", "c.py", "x = 1\n"), ("r", "d.md", "# no")])
    sources = inventory.source_files(first, prune=False)
    assert scan.unparsed(sources, None).count() == 2  # two contents, one of them twice
    got = scan.stored_facts(sources, store)
    assert sorted(got.collect()) == sorted(scan.syntax_facts(sources).collect())
    # A second run over the same contents and one new file parses that file alone.
    again = inventory.source_files(first.union(two(spark, [("s", "e.py", "def g():\n    return 2\n")])), prune=False)
    assert [r.content for r in scan.unparsed(again, spark.read.parquet(store)).collect()] == ["def g():\n    return 2\n"]
    got = scan.stored_facts(again, store)
    assert sorted(got.collect()) == sorted(scan.syntax_facts(again).collect())
    assert spark.read.parquet(store).count() == 3  # each content's facts stored once
    assert scan.unparsed(again, spark.read.parquet(store)).count() == 0
