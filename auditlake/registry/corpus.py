"""Source corpora derived from the given tables.

The tables hold almost no code, so files, diffs, inventories and plans are
derived from their rows.  The derivations are SQL expressions that Spark and
DuckDB read alike; each exists once here and serves both sides of the check.
No row is left out: snapshots differ by what a row turns into, not by which
rows are kept.

A derived file takes the events of one user inside one range of event ids, so
its size is bounded however many events a user has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event ids per derived file range.
FILE_RANGE = 20_000

LANG = "CAST(user_id % 5 AS INT)"
KIND = "CAST(event_id % 10 AS INT)"
CHUNK = f"CAST(floor(event_id / {FILE_RANGE}) AS BIGINT)"

BLOCK = f"""CASE
  WHEN {LANG} = 0 THEN CASE {KIND}
    WHEN 0 THEN concat('try:', chr(10), '    f', event_id, '()', chr(10), 'except:', chr(10), '    pass')
    WHEN 1 THEN concat('def f', event_id, '(a, b=[], c={{}}):', chr(10), '    return a')
    WHEN 2 THEN concat('def g', event_id, '(a=None):', chr(10), repeat(concat('    a = 1', chr(10)), CAST(event_id % 60 AS INT)), '    return a')
    WHEN 3 THEN concat('try:', chr(10), '    f', event_id, '()', chr(10), 'except :', chr(10), '    pass')
    WHEN 4 THEN concat('try:', chr(10), '    f', event_id, '()', chr(10), 'except ValueError:', chr(10), '    pass')
    WHEN 5 THEN '# except: in a comment'
    WHEN 6 THEN concat('async def h', event_id, '(a=[]):', chr(10), '    return a')
    ELSE concat('x = ', event_id) END
  WHEN {LANG} IN (1, 2) THEN CASE {KIND}
    WHEN 0 THEN 'let z: any = 2;'
    WHEN 1 THEN 'export const f = (a) => {{'
    WHEN 2 THEN 'export const g: T = 1'
    WHEN 3 THEN 'export const h = {{ a: 1 }}'
    WHEN 4 THEN 'const company: anything = 1'
    WHEN 5 THEN 'export const m = (a: T) => {{'
    ELSE concat('ok(', event_id, ')') END
  WHEN {LANG} = 3 THEN CASE {KIND}
    WHEN 0 THEN '  var x = 1;'
    WHEN 1 THEN 'console.log(x)'
    WHEN 2 THEN '  // console.log(y)'
    WHEN 3 THEN 'variable = 1'
    ELSE concat('ok(', event_id, ')') END
  ELSE CASE {KIND}
    WHEN 0 THEN '  _ = f() // error'
    WHEN 1 THEN '_ = g(errors)'
    WHEN 2 THEN '_ = h.Error()'
    ELSE concat('ok(', event_id, ')') END END"""

# Called names are distinct, so lines rarely repeat and a line diff has one reading.
# In the base snapshot late events of most users were still plain statements,
# some users' files lay in another directory, one repo has not changed since,
# and one repo had another name (so it has no base).
LATE = "(ts >= TIMESTAMP '2024-01-29 00:00:00' AND user_id % 3 <> 0 AND user_id % 6 <> 4)"
BASE_BLOCK = f"CASE WHEN {LATE} THEN 'x = 0' ELSE {BLOCK} END"
REPO = "concat('r', CAST(user_id % 6 AS INT))"
BASE_REPO = f"CASE WHEN user_id % 6 = 5 THEN 'old5' ELSE {REPO} END"
_EXT = f"CASE {LANG} WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '.js' ELSE '.go' END"
_FILE = f"concat('c', {CHUNK}, '/u', user_id, {_EXT})"
PATH = f"concat(CASE WHEN user_id % 7 = 3 THEN 'node_modules/' ELSE 'src/' END, {_FILE})"
BASE_PATH = (
    "concat(CASE WHEN user_id % 7 = 3 THEN 'node_modules/' "
    f"WHEN user_id % 11 = 5 AND user_id % 6 <> 4 THEN 'lib/' ELSE 'src/' END, {_FILE})"
)

SNAPSHOTS = {"current": (REPO, PATH, BLOCK), "base": (BASE_REPO, BASE_PATH, BASE_BLOCK)}

# One diff per ten events; a header opens it and sometimes a second section.
DIFF_ID = "CAST(floor(event_id / 10) AS BIGINT)"
DIFF_BLOCK = """CASE
  WHEN event_id % 10 = 0 THEN concat('--- a/f', event_id, '.py', chr(10), '+++ b/f', event_id, '.py', chr(10), '@@ -1 +1 @@')
  WHEN event_id % 10 = 6 AND user_id % 3 = 0 THEN concat('--- a/g', event_id, '.py', chr(10), '+++ b/g', event_id, '.py', chr(10), '@@ -1 +1 @@')
  ELSE CASE CAST((event_id * 7 + user_id) % 61 AS INT)
    WHEN 0 THEN '+api_key = "k-1"'
    WHEN 1 THEN '+# todo later'
    WHEN 2 THEN concat('+', repeat('y', 101))
    WHEN 3 THEN '+  print(x)'
    WHEN 4 THEN '-    try:'
    WHEN 5 THEN '-def f() -> int'
    WHEN 6 THEN '-    except E as e:'
    WHEN 7 THEN '+TODO print'
    WHEN 8 THEN '-    raise E'
    WHEN 9 THEN concat('+', repeat('z', 100))
    ELSE concat(' ctx', event_id) END END"""
# Every fiftieth diff is blank text.
DIFF_TEXT = "CASE WHEN diff_id % 50 = 7 THEN ' ' ELSE text END"

# Paths by order key: directories and names that pruning and the extension rule must tell apart.
INVENTORY_PATH = """concat(
  CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'node_modules/p/'
    WHEN 3 THEN 'a/build/b/' WHEN 4 THEN 'build.d/' WHEN 5 THEN '.git/' WHEN 6 THEN 'x/.venv/lib/'
    WHEN 7 THEN 'distant/' ELSE 'a/.eggs/' END,
  CASE CAST(floor(o_orderkey / 9) AS BIGINT) % 12 WHEN 0 THEN 'm.py' WHEN 1 THEN 'm.ts' WHEN 2 THEN 'm.tsx'
    WHEN 3 THEN 'm.js' WHEN 4 THEN 'm.go' WHEN 5 THEN 'm.jsx' WHEN 6 THEN 'm.PY' WHEN 7 THEN 'm.d.ts'
    WHEN 8 THEN '.py' WHEN 9 THEN 'dist' WHEN 10 THEN 'README.md' ELSE 'venv.py' END)"""
INVENTORY_REPO = "concat('r', CAST(o_custkey % 40 AS INT))"

# Files by customer: each customer is a repo with three root files and a nested one.
MARKERS = [
    "pyproject.toml",
    "pytest.ini",
    "setup.cfg",
    "package.json",
    "go.mod",
    ".flake8",
    ".eslintrc.js",
    ".eslintrc.json",
    ".golangci.yml",
    "README.md",
    "main.go",
]
MARKER_LIST = ", ".join(f"'{m}'" for m in MARKERS)
# Per-event plans: the strategies in turn, unknown ones and missing files among them.
PLAN_STRATEGY = """CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'inline-fix' WHEN 1 THEN 'rename'
  WHEN 2 THEN 'restructure' WHEN 3 THEN 'extract-function' WHEN 4 THEN 'inline-fix'
  WHEN 5 THEN 'restructure' ELSE CASE WHEN user_id % 13 = 1 THEN 'reformat' ELSE 'rename' END END"""
PLAN_ORIGINAL = """CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'except:' WHEN 1 THEN 'ok('
  WHEN 2 THEN concat('try:', chr(10), 'f') WHEN 3 THEN 'return a' WHEN 4 THEN 'const'
  WHEN 5 THEN concat('x = ', event_id) ELSE 'absent' END"""
PLAN_TARGET = """CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'except Exception:' WHEN 1 THEN 'okay('
  WHEN 2 THEN concat('# block ', event_id, chr(10), 'end') WHEN 3 THEN concat('return helper(a)', chr(10), '# helper')
  WHEN 4 THEN 'let' WHEN 5 THEN concat('y = ', event_id) ELSE 'present' END"""
PLAN_START = "CAST(1 + event_id % 4 AS INT)"
PLAN_END = "CAST(1 + event_id % 4 + event_id % 3 AS INT)"
PLAN_PATH = f"CASE WHEN user_id % 13 = 2 THEN concat('gone/', {PATH}) ELSE {PATH} END"
PLAN_SEQ = f"CAST(event_id % {FILE_RANGE} AS INT)"
PLAN_COLUMNS = {
    "repo": REPO,
    "path": PLAN_PATH,
    "seq": PLAN_SEQ,
    "strategy": PLAN_STRATEGY,
    "original_snippet": PLAN_ORIGINAL,
    "target_snippet": PLAN_TARGET,
    "line_start": PLAN_START,
    "line_end": PLAN_END,
    "explanation": "concat('plan ', event_id)",
}

# Verdicts: one in five fails; one in seven is about a plan nobody made, so that plan has none.
VERDICT_PASSED = "seq % 5 <> 0"
SECOND_PASSED = "seq % 3 <> 0"  # of a second test run after each plan
VERDICT_KEY = "CASE WHEN seq % 7 = 0 THEN concat('other ', plan_key) ELSE plan_key END"
VERDICT_OUTPUT = "concat('exit ', seq, ' ', repeat('e', 210))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_files(spark: SparkSession, sf_dir: str, snapshot: str = "current") -> DataFrame:
    repo, path, block = (F.expr(text) for text in SNAPSHOTS[snapshot])
    rows = table(spark, sf_dir, "events").select(
        repo.alias("repo"), path.alias("path"), "event_id", block.alias("block")
    )
    joined = F.expr("listagg(block, chr(10)) WITHIN GROUP (ORDER BY event_id)")
    return rows.groupBy("repo", "path").agg(joined.alias("content"))


def event_files(events: DataFrame) -> DataFrame:
    """One small file per event, for streams: nothing is grouped."""
    return events.select(
        F.expr(REPO).alias("repo"),
        F.expr(f"concat('e', event_id, '/', {PATH})").alias("path"),
        F.expr(BLOCK).alias("content"),
    )


def code_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.expr(DIFF_ID).alias("diff_id"), "event_id", F.expr(DIFF_BLOCK).alias("block")
    )
    joined = F.expr("listagg(block, chr(10)) WITHIN GROUP (ORDER BY event_id)")
    return (
        rows.groupBy("diff_id")
        .agg(joined.alias("text"))
        .select("diff_id", F.expr(DIFF_TEXT).alias("diff"))
    )


def path_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(INVENTORY_REPO).alias("repo"), F.expr(INVENTORY_PATH).alias("path")
    )


def marker_slots() -> str:
    """Four paths per customer as an array expression."""
    names = f"array({MARKER_LIST})"
    n = len(MARKERS)
    picks = [
        f"{names}[CAST((c_custkey * {a} + {b}) % {n} AS INT)]" for a, b in ((1, 0), (3, 2), (5, 7))
    ]
    nested = f"concat('sub/', {names}[CAST((c_custkey * 7) % {n} AS INT)])"
    return f"array({', '.join([*picks, nested])})"


def marker_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("repo"), F.explode(F.expr(marker_slots())).alias("path")
    )


def event_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.expr(text).alias(name) for name, text in PLAN_COLUMNS.items()]
    return table(spark, sf_dir, "events").select(
        F.expr("concat('p', event_id)").alias("plan_key"), *columns
    )


def verdicts_for(plans: DataFrame) -> DataFrame:
    return plans.select(
        F.expr(VERDICT_KEY).alias("plan_key"),
        F.expr(VERDICT_PASSED).alias("passed"),
        F.expr(VERDICT_OUTPUT).alias("output"),
    )
