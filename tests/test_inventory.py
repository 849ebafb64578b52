import pytest

from auditlake.operators import inventory
from auditlake.sources.tree import load_tree, unread_files


def test_pruning_applies_to_directories_at_any_level(files):
    kept = ["a.py", "distant/b.py", "src/venv.py", "dist", "x/build.py"]
    dropped = ["dist/a.py", "src/node_modules/p/b.js", ".git/c.py", "a/.venv/d.py", "a/b/.eggs/e.go", "build/.tox/f.ts"]
    tree = files({p: "" for p in kept + dropped})
    assert {r.path for r in inventory.source_files(tree).collect()} == set(kept) - {"dist"}
    assert inventory.source_files(tree, prune=False).count() == len(kept + dropped) - 1


def test_extensions_and_languages(files):
    tree = files({p: "" for p in ("a.py", "b.PY", "c.tsx", "d.jsx", "e.d.ts", ".py", "f.go", "g.js")})
    got = {r.path: r.language for r in inventory.source_files(tree).collect()}
    assert got == {"a.py": "python", "c.tsx": "typescript", "e.d.ts": "typescript", "f.go": "go", "g.js": "javascript"}


def test_no_file_is_too_large(files):
    tree = files({"a.py": "x" * 600_000, "b.py": "x"})
    assert inventory.source_files(tree).count() == 2


def test_line_ends_of_any_table(files):
    tree = files({"a.py": "x = 1\rdef f(a=[]):\r  pass", "b.py": "x\r\ny", "c.py": "x\ny"})
    got = {r.path: r.content for r in inventory.source_files(tree).collect()}
    assert got == {"a.py": "x = 1\ndef f(a=[]):\n  pass", "b.py": "x\ny", "c.py": "x\ny"}


def test_runner_priority(spark):
    rows = [
        ("a", "setup.cfg"), ("a", "package.json"), ("b", "go.mod"), ("b", "package.json"), ("c", "main.go"),
        ("d", "sub/pyproject.toml"), ("e", "pyproject.toml"), ("f", "pytest.ini"), ("g", "go.mod"),
    ]
    found = inventory.test_runners(spark.createDataFrame(rows, "repo string, path string")).collect()
    assert {r.repo: r.runner for r in found} == {
        "a": "pytest", "b": "npm", "c": "skip", "d": "skip", "e": "pytest", "f": "pytest", "g": "go",
    }
    assert {r.repo for r in found if r.message} == {"c", "d"}
    assert all("No test runner" in r.message for r in found if r.message)


def test_linters(spark):
    rows = [
        ("a", ".flake8"), ("a", ".eslintrc.json"), ("a", ".eslintrc.js"), ("b", ".golangci.yml"), ("c", "x/.flake8"),
    ]
    found = inventory.linters(spark.createDataFrame(rows, "repo string, path string")).collect()
    assert {r.repo: list(r.linters) for r in found} == {
        "a": ["eslint", "flake8"], "b": ["golangci-lint"], "c": [],
    }
    assert {r.repo: r.message for r in found}["c"] == "No linter config found — skipping lint."


def test_load_tree(spark, tmp_path):
    contents = {
        "a.py": b"x = 1\r\n", "deep/er/b.ts": b"caf\xe9\n", "README.md": b"#", "node_modules/c.js": b"var x", "bin": b"\x00",
    }
    for name, raw in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path: r.content for r in load_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"a.py": "x = 1\n", "deep/er/b.ts": "caf\ufffd\n", "node_modules/c.js": "var x"}
    everything = load_tree(spark, f"file://{tmp_path}", "r", sources_only=False)
    assert {r.path for r in everything.select("path").collect()} == set(contents)


def test_many_repositories_in_one_read(spark, tmp_path):
    for name in ("one/a.py", "one/src/b.go", "two/a.py", "stray.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = sorted(tuple(r) for r in load_tree(spark, str(tmp_path), None).select("repo", "path", "content").collect())
    assert got == [("one", "a.py", "one/a.py"), ("one", "src/b.go", "one/src/b.go"), ("two", "a.py", "two/a.py")]


def test_vanished_files_fail_unless_skipping_is_asked_for(spark, tmp_path):
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text(name)
    strict = load_tree(spark, str(tmp_path), "r")
    lenient = load_tree(spark, str(tmp_path), "r", skip_unreadable=True)
    loaded = spark.createDataFrame([("r", "a.py")], "repo string, path string")
    assert [r.path for r in unread_files(spark, str(tmp_path), "r", loaded).collect()] == ["b.py"]
    (tmp_path / "b.py").unlink()  # listed before, gone when it is read
    assert [r.path for r in lenient.collect()] == ["a.py"]
    with pytest.raises(Exception):
        strict.collect()
