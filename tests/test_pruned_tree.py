import os

import pytest

from auditlake.operators.inventory import source_files
from auditlake.sources.pruned import load_pruned_tree
from auditlake.sources.tree import load_tree


def _tree(root, contents):
    for name, raw in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)


def _rows(df):
    return sorted(tuple(r) for r in df.select("repo", "path", "content").collect())


def test_same_files_as_a_listing_pruned_afterwards(spark, tmp_path):
    _tree(tmp_path, {
        "a.py": b"x = 1\r\n", "deep/er/b.ts": b"caf\xe9\n", "README.md": b"#", "node_modules/c.js": b"var x",
        "bin": b"\x00", "x/y/z/w/v.go": b"package v", "x/y/z/dist/u.go": b"package u", "q/build.py": b"ok",
    })
    expected = _rows(source_files(load_tree(spark, str(tmp_path), "r")).drop("ext", "language"))
    for depth in (0, 1, 2, 5):
        assert _rows(load_pruned_tree(spark, str(tmp_path), "r", split_depth=depth)) == expected
    assert _rows(load_pruned_tree(spark, f"file://{tmp_path}", "r")) == expected
    everything = load_pruned_tree(spark, str(tmp_path), "r", sources_only=False)
    assert {r.path for r in everything.collect()} == {
        "a.py", "deep/er/b.ts", "README.md", "bin", "x/y/z/w/v.go", "q/build.py",
    }


def test_unreadable_excluded_directories_are_never_entered(spark, tmp_path):
    _tree(tmp_path, {"src/a.py": b"a", "src/lib/deep/.git/ok.py": b"never"})
    # A pipe can't be read as a file (opening it would wait for a writer); a link loop
    # has no end. Neither is touched inside an excluded directory.
    (tmp_path / "node_modules").mkdir()
    os.mkfifo(tmp_path / "node_modules" / "pipe.js")
    os.symlink(tmp_path / "node_modules", tmp_path / "node_modules" / "loop")
    os.mkfifo(tmp_path / "src" / "lib" / "deep" / ".git" / "pipe.py")
    got = _rows(load_pruned_tree(spark, str(tmp_path), "r"))
    assert got == [("r", "src/a.py", "a")]
    # The same unreadable file outside an excluded directory fails the job, unless skipped.
    os.mkfifo(tmp_path / "src" / "pipe.py")
    with pytest.raises(Exception):
        load_pruned_tree(spark, str(tmp_path), "r").collect()
    assert _rows(load_pruned_tree(spark, str(tmp_path), "r", skip_unreadable=True)) == got


def test_many_repositories_and_empty_trees(spark, tmp_path):
    _tree(tmp_path, {"one/a.py": b"one/a.py", "one/src/b.go": b"one/src/b.go", "two/a.py": b"two/a.py", "stray.py": b"s"})
    (tmp_path / "empty" / "deeper").mkdir(parents=True)
    assert _rows(load_pruned_tree(spark, str(tmp_path), None)) == [
        ("one", "a.py", "one/a.py"), ("one", "src/b.go", "one/src/b.go"), ("two", "a.py", "two/a.py"),
    ]
    assert load_pruned_tree(spark, str(tmp_path / "empty"), None).count() == 0
    with pytest.raises(Exception):
        load_pruned_tree(spark, str(tmp_path / "absent"), "r").collect()
