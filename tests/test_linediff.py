"""The anchor-aligned diff against the standard library's unified diff, and its Spark anchors."""

import difflib
import random

from auditlake.functions import linediff
from auditlake.registry import corpus

SF_DIR = "/root/testdata/sf0.01"


def library(a, b, path):
    return "".join(difflib.unified_diff(a, b, path, path))


def test_edits_of_distinct_lines_equal_the_library():
    rng = random.Random(5)
    for _ in range(2000):
        a = [f"statement {k}\n" for k in rng.sample(range(200), rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            op = rng.random()
            if op < 0.3 and b:
                del b[rng.randrange(len(b))]
            elif op < 0.6:
                b.insert(rng.randint(0, len(b)), f"new {rng.random()}\n")
            elif b:
                b[rng.randrange(len(b))] = "changed\n"
        assert linediff.diff_text(a, b, "p") == library(a, b, "p")


def test_repeated_lines_give_a_correct_script():
    rng = random.Random(9)
    for _ in range(2000):
        vocab = [f"l{k}\n" for k in range(rng.choice([2, 4, 9]))]
        a = [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        b = [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        pairs = linediff.matches(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        # The hunks rebuild both sides.
        rebuilt_a, rebuilt_b = [], []
        for t, i1, i2, j1, j2 in linediff.opcodes(len(a), len(b), pairs):
            rebuilt_a += a[i1:i2]
            rebuilt_b += b[j1:j2]
        assert (rebuilt_a, rebuilt_b) == (a, b)


def test_line_ends_split_as_splitlines(spark):
    text = "a\r\nb\rc\nd\x0be\x85f g"
    df = spark.createDataFrame([(text,)], "t string")
    (row,) = df.select(linediff.lines_of(df.t).alias("l")).collect()
    assert row.l == text.splitlines(keepends=True)


def test_snapshot_pairs_equal_the_library(spark):
    now = corpus.code_files(spark, SF_DIR)
    was = corpus.code_files(spark, SF_DIR, "base").withColumnRenamed("content", "was")
    both = now.join(was, ["repo", "path"])
    got = linediff.unified_diffs(both, ["repo", "path"], "was", "content", "path").collect()
    assert got
    for r in got:
        assert r.diff == library(r.was.splitlines(True), r.content.splitlines(True), r.path)


def test_repeated_keys_nulls_and_empty(spark):
    rows = [("k", "a\nb\n", "a\nc\n", "p"), ("k", "x\n", "y\n", "p"), ("n", None, "a\n", "p"), ("e", "", "", "p")]
    df = spark.createDataFrame(rows, "key string, b string, a string, p string")
    got = sorted((r.key, r.diff) for r in linediff.unified_diffs(df, ["key"], "b", "a", "p").collect())
    assert got == sorted(
        [
            ("k", library(["a\n", "b\n"], ["a\n", "c\n"], "p")),
            ("k", library(["x\n"], ["y\n"], "p")),
            ("n", None),
            ("e", ""),
        ]
    )
    assert linediff.unified_diffs(df.limit(0), ["key"], "b", "a", "p").count() == 0
