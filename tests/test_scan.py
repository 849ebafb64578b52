import ast
import pathlib
import random
import re

import pytest

from auditlake.functions import pyfacts
from auditlake.operators import inventory, scan


def found(files_df, *columns):
    """Findings of a full scan as ``{path: [(columns), ...]}`` in reporting order."""
    rows = scan.findings(scan.scan_files(inventory.source_files(files_df))).collect()
    by_path = {}
    for row in sorted(rows, key=lambda r: (r.path, r.ordinal)):
        by_path.setdefault(row.path, []).append(tuple(row[c] for c in columns))
    return by_path


def test_discovers_supported_files(files):
    wanted = {"jobs/nightly.py", "ui/grid.tsx", "ui/legacy.js", "cmd/serve.go"}
    tree = files({p: "\n" for p in wanted} | {"docs/notes.txt": "a", "Makefile": "all:\n", "jobs/nightly.pyc": "b"})
    assert {r.path for r in inventory.source_files(tree).collect()} == wanted


def test_unsupported_files_are_not_scanned(files):
    tree = files({"logo.svg": "<svg/>", "conf/site.toml": "a = 1", "lib.so": "\x7fELF"})
    assert scan.scan_files(inventory.source_files(tree)).count() == 0


def test_bare_except(files):
    tree = files({"test.py": "\ntry:\n    do_something()\nexcept:\n    pass\n"})
    assert found(tree, "rule", "line", "title", "context") == {
        "test.py": [("bare_except", 4, "Bare except clause", "except:")]
    }


def test_mutable_defaults(files):
    source = (
        "def a(items=[]):\n    return items\n"
        "def b(x={}, y={1}, z=None, w=()):\n    pass\n"
        "def c(*, k=[]):\n    pass\n"
        "async def d(x=[]):\n    pass\n"
        "f = lambda x=[]: x\n"
        "def e(x=list()):\n    pass\n"
        "class K:\n    def m(self, x=[]):\n        pass\n"
    )
    assert found(files({"m.py": source}), "line", "description") == {
        "m.py": [
            (1, "Function 'a' uses a mutable default argument."),
            (3, "Function 'b' uses a mutable default argument."),
            (3, "Function 'b' uses a mutable default argument."),
            (13, "Function 'm' uses a mutable default argument."),
        ]
    }


@pytest.mark.parametrize("body, reported", [(60, True), (51, True), (50, False)])
def test_long_function(files, body, reported):
    got = found(files({"l.py": "def long_func():\n" + "    pass\n" * body}), "rule", "description")
    text = f"Function 'long_func' has {body} lines (threshold: 50)."
    assert got == ({"l.py": [("long_function", text)]} if reported else {})


def test_findings_follow_the_breadth_first_walk(files):
    source = (
        "def outer(a=[]):\n    try:\n        def inner(b={}):\n            pass\n    except:\n        pass\n"
        "try:\n    pass\nexcept:\n    pass\n"
    )
    assert found(files({"w.py": source}), "rule", "line") == {
        "w.py": [("mutable_default", 1), ("bare_except", 9), ("mutable_default", 3), ("bare_except", 5)]
    }


def test_facts_follow_the_walk_of_whole_trees():
    """On the standard library's own sources, against a walk over every node."""
    seen = 0
    for path in sorted(pathlib.Path(ast.__file__).parent.glob("*.py")):
        source = path.read_text(encoding="utf-8")
        walked = [
            (node.lineno, node.end_lineno, getattr(node, "name", None))
            for node in ast.walk(ast.parse(source))
            if isinstance(node, ast.FunctionDef) or isinstance(node, ast.ExceptHandler) and not node.type
        ]
        facts = pyfacts.facts_of(source)
        assert [(f["line"], f["end_line"], f.get("name")) for f in facts] == walked
        seen += len(walked)
    assert seen > 5000


def test_files_that_do_not_parse_count_but_yield_nothing(files, spark):
    sources = {
        "syntax.py": "def (:\nexcept:",
        "null.py": "x = 1\x00\ndef f(a=[]): pass",
        "bom.py": "\ufefftry:\n  f()\nexcept:\n  pass",
        "deep.py": "def f(): return " + "(" * 5000 + ")" * 5000,
        "good.py": "def f(a=[]):\n    pass",
    }
    prepared = inventory.source_files(files(sources))
    assert scan.scan_summary(scan.scan_files(prepared)).first().files_scanned == 5
    assert set(found(files(sources), "rule")) == {"good.py"}
    facts = scan.syntax_facts(prepared).collect()
    assert {r.path: r.kind for r in facts} == {
        "syntax.py": "parse_error",
        "null.py": "parse_error",
        "bom.py": "parse_error",
        "deep.py": "parse_error",
        "good.py": "function",
    }


# Independent statements of the line rules, in Python's own terms.
MODEL = {
    "ts": [
        ("ts_any", lambda t: re.search(r":\s*any\b", t), True),
        ("ts_missing_return", lambda t: re.match(r"export\s+(?:function|const)\s+\w+\s*=", t) and ":" not in t.partition("{")[0], False),
    ],
    "js": [
        ("js_var", lambda t: re.match(r"\s*var\s+\w", t), True),
        ("js_console", lambda t: "console.log" in t and not t.strip().startswith("//"), False),
    ],
    "go": [("go_ignored_error", lambda t: re.match(r"\s*_\s*=.*(?<!\w)[Ee]rror(?!\w)", t), True)],
}


def model(path, content):
    got = []
    for rule, matches, first_only in MODEL[path.rsplit(".", 1)[1][:2]]:
        hits = [(rule, i, t.strip()) for i, t in enumerate(content.split("\n"), 1) if matches(t)]
        got += hits[:1] if first_only else hits
    return got


PIECES = {
    "ts": [": any", ":any", ": anyé", "a: Array<any>", ":\u00a0any\u2028", "export const f =", "export function é =", "export  const x_1=", " export const f =", "{ a: 1 }", "(a: T) => {", "export const \u00b2 =", "\x1c"],
    "js": ["var x", "  var é = 1", "variable", "\x1fvar\u3000_x", "console.log(1)", "// ", "\u2003//", "var", "\t"],
    "go": ["_ = ", "\u00a0_ =", "_=", "Error", "error", "errors", "é", "error\u2028", "x\u2028", "_ = f() // error", "Error()"],
}


def test_line_rules_equal_the_model(files):
    rng = random.Random(7)
    contents = {}
    for ext in ("ts", "tsx", "js", "go"):
        for i in range(60):
            rows = ["".join(rng.choices(PIECES[ext[:2]], k=rng.randint(0, 4))) for _ in range(rng.randint(1, 8))]
            contents[f"d/{i}.{ext}"] = "\n".join(rows)
    expected = {p: m for p, c in contents.items() if (m := model(p, c))}
    assert len(expected) > 100
    assert found(files(contents), "rule", "line", "context") == expected


def test_catalogue_columns(files):
    tree = files({"a.go": "\t_ = f(Error)  ", "b.js": "console.log(1)"})
    assert found(tree, "severity", "category", "suggestion", "context") == {
        "a.go": [("high", "security", "Handle the error explicitly with a meaningful fallback or log.", "_ = f(Error)")],
        "b.js": [("info", "dead-code", "Remove or replace with a proper logging framework.", "console.log(1)")],
    }


def test_scan_visits_each_file_once(files):
    """Neither the rules nor the Python workers may run twice per file, and nothing is shuffled."""
    plan = scan.findings(scan.scan_files(inventory.source_files(files({"a.py": "x"}))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    assert "Exchange" not in text


def test_summary_counts_and_gates(files, spark):
    tree = files({"a.py": "try:\n  f()\nexcept:\n  pass", "b.js": "console.log(1)\n"}).unionByName(
        files({"c.go": "package main\n"}, repo="clean")
    )
    scanned = scan.scan_files(inventory.source_files(tree))
    summary = {r.repo: r.asDict() for r in scan.scan_summary(scanned).collect()}
    assert summary["r"] == dict(repo="r", files_scanned=2, lines_analyzed=6, tokens=6 + 3, findings=2)
    assert summary["clean"] == dict(repo="clean", files_scanned=1, lines_analyzed=2, tokens=3, findings=0)
    counts = scan.severity_counts(scan.findings(scanned)).orderBy("rank").collect()
    assert [(r.severity, r.findings) for r in counts] == [
        ("critical", 0), ("high", 1), ("medium", 0), ("low", 0), ("info", 1),
    ]
    gate = {r.repo: (r.clean, r.message) for r in scan.clean_gate(scan.scan_summary(scanned)).collect()}
    assert gate == {"r": (False, None), "clean": (True, "No issues found. Codebase is clean.")}

    def budget(limit):
        rows = scan.token_budget_gate(scan.scan_summary(scanned), limit).collect()
        return {r.repo: (r.success, r.message) for r in rows}

    assert budget(8) == {"r": (False, "Token budget exceeded (9 > 8)"), "clean": (True, None)}
    for limit in (9, 0, None):
        assert budget(limit) == {"r": (True, None), "clean": (True, None)}
