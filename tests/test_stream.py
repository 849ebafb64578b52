import random

import pytest

from auditlake.streaming import continuous

BATCHES = [
    {"a.py": "try:\n  f()\nexcept:\n  pass", "b.js": "console.log(1)\nvar x"},
    {"node_modules/c.ts": "let z: any", "d.md": "console.log"},
    {"e.go": "_ = f(error)\n_ = g(error)"},
]


def test_stream_equals_batch(files, spark, tmp_path):
    where, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = files(BATCHES[0]).schema
    arrived = None
    for contents in BATCHES:
        new = files(contents)
        new.write.mode("append").parquet(where)
        arrived = new if arrived is None else arrived.unionByName(new)
        found = continuous.stream_findings(continuous.stream_rows(spark, where, schema))
        assert found.isStreaming
        continuous.append_available(found, sink, progress)
        got = spark.read.parquet(sink)
        expected = continuous.stream_findings(arrived)
        assert sorted(got.select(*expected.columns).collect()) == sorted(expected.collect())
    assert got.count() == 5


def test_running_totals(files, spark, tmp_path):
    where, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    seen = []
    for contents in BATCHES:
        files(contents).write.mode("append").parquet(where)
        found = continuous.stream_findings(continuous.stream_rows(spark, where, files(contents).schema))
        continuous.keep_severity_totals(
            found, lambda df, _: seen.append({r.severity: r["count"] for r in df.collect()}), progress
        )
    assert seen[-1] == {"high": 2, "info": 1, "low": 1, "medium": 1}


ARRIVALS = [
    [("r", "a.py", "try:\n  f()\nexcept:\n  pass", 1), ("r", "b.js", "var x", 2)],
    # a.py again unchanged, b.js twice in one batch: changed, then back as it was
    [("r", "a.py", "try:\n  f()\nexcept:\n  pass", 3), ("r", "b.js", "var y\nvar z", 4), ("r", "b.js", "var x", 5)],
    # a.py mended: its finding must go; c.go new
    [("r", "a.py", "f()", 6), ("r", "c.go", "_ = f(error)", 7)],
]


def test_changed_only_stream(spark, tmp_path):
    where, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "repo string, path string, content string, arrival long"
    emitted = []
    for rows in ARRIVALS:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(where)
        arriving = spark.readStream.schema(schema).parquet(where)
        continuous.keep_changed(arriving, "arrival", sink, progress)
        emitted.append(spark.read.parquet(f"{sink}/versions").count())
    # Batch 1: two files; batch 2: b.js twice (a.py unchanged emits nothing); batch 3: two.
    assert emitted == [2, 4, 6]
    versions = {(r.path, r.version) for r in spark.read.parquet(f"{sink}/versions").collect()}
    assert versions == {("a.py", 1), ("b.js", 1), ("b.js", 2), ("b.js", 3), ("a.py", 2), ("c.go", 1)}
    found = continuous.changed_findings(continuous.changed_only(spark.createDataFrame(ARRIVALS[0], schema), "arrival"))
    latest = continuous.latest_findings(spark, sink, found.schema)
    final = spark.createDataFrame(
        [("r", "a.py", "f()", 6), ("r", "b.js", "var x", 5), ("r", "c.go", "_ = f(error)", 7)], schema
    )
    expected = continuous.stream_findings(final.drop("arrival"))
    got = latest.drop("version")
    assert sorted(got.select(*expected.columns).collect()) == sorted(expected.collect())
    assert {r.path for r in got.collect()} == {"b.js", "c.go"}


def test_changed_only_keeps_files_apart_within_a_bucket(spark, tmp_path):
    """Many files share one call and one state, in frames of a few rows, with nulls, over two batches."""
    where, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "repo string, path string, content string, arrival long"
    rng, last, want, calls = random.Random(3), {}, set(), spark.sparkContext.accumulator(0)
    names = [(r, p) for r in ("r", "s", None) for p in (*(f"{i}.js" for i in range(20)), None)]
    emit = continuous._emit_changed

    def counted(order):
        def run(key, frames, state):
            calls.add(1)
            yield from emit(order)(key, frames, state)

        return run

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(continuous, "_emit_changed", counted)
        patch.setattr(continuous, "BUCKETS", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            for batch in range(2):
                rows = [(*rng.choice(names), rng.choice(["var x", "var y", None]), 1000 * batch + i) for i in range(400)]
                for repo, path, content, _ in rows:
                    before, version = last.get((repo, path), ("none", 0))
                    if before != content:
                        last[repo, path] = content, version + 1
                        want.add((repo, path, version + 1))
                rng.shuffle(rows)
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
                arriving = spark.readStream.schema(schema).parquet(where)
                continuous.keep_changed(arriving, "arrival", sink, progress)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [(r.repo, r.path, r.version) for r in spark.read.parquet(f"{sink}/versions").collect()]
    assert len(got) == len(want) and set(got) == want
    assert calls.value <= 6  # a call a bucket and batch, not a call a file
