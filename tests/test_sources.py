"""Listing and reading of source trees by the tasks."""

import os

import pytest

from wayweft.sources import tree as trees


def _plain(root, include_hidden):
    found = {}
    for folder, inside, names in os.walk(root):
        inside[:] = [d for d in inside if not trees._skipped(d, include_hidden) and not os.path.islink(f"{folder}/{d}")]
        for n in names:
            if not trees._skipped(n, include_hidden) and os.path.isfile(f"{folder}/{n}"):
                found[os.path.relpath(f"{folder}/{n}", root)] = os.path.getsize(f"{folder}/{n}")
    return found


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """50,000 files in folders of many shapes: one of 20,000 files, long chains, hidden and underscore names."""
    root = tmp_path_factory.mktemp("large")

    def put(path):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.touch()

    for i in range(20_000):
        put(f"flat/f{i}.py")
    for i in range(29_000):
        put(f"wide/{i % 700}/{i % 7}/f{i}.md")
    put("/".join("d" * 1 for _ in range(60)) + "/deep.txt")
    for name in (".github/workflows/ci.yml", ".hidden/a.py", "_private/b.py", "wide/_c.py", ".env", "node_modules/x/y.js", "a/.git/config", "build/z.c", "ü/ñ.py"):
        put(name)
    for i in range(1000):
        put(f"_under/{i}/.keep")
    (root / "link.py").symlink_to(root / "flat" / "f1.py")
    (root / "loop").symlink_to(root)
    (root / "broken").symlink_to(root / "nothing")
    return root


@pytest.mark.parametrize(("hidden", "at_once"), [(False, 10_000), (True, 500)])
def test_listing_of_a_large_tree(spark, large, monkeypatch, hidden, at_once):
    monkeypatch.setattr(trees, "LISTED_AT_ONCE", at_once)
    got = [(r.path, r.size) for r in trees.list_files(spark, str(large), hidden).collect()]
    want = _plain(large, hidden)
    assert len(got) == len(want) > 49_000 and dict(got) == want
    assert (".env" in want) == hidden and ".github/workflows/ci.yml" in want and "_private/b.py" in want and "link.py" in want


def test_stamp_and_limit(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"f{i:02}.md").write_text(f"# {i}")
    stamp = lambda: trees.tree_stamp(trees.list_files(spark, str(tmp_path)))
    first = stamp()
    assert first == stamp()
    (tmp_path / "f03.md").write_text("# longer")
    second = stamp()
    (tmp_path / "f04.md").unlink()
    assert len({first, second, stamp()}) == 3
    some = trees.files_from_tree(spark, str(tmp_path), max_files=5).collect()
    assert sorted(r.path for r in some) == ["f00.md", "f01.md", "f02.md", "f03.md", "f05.md", "f06.md"]
    with pytest.raises(ValueError):
        trees.list_files(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert trees.files_from_tree(spark, str(tmp_path / "empty")).count() == 0


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "b.py").write_text("x" * 50)
    rows = {r.path: r.text for r in trees.files_from_tree(spark, str(tmp_path), max_bytes=20).collect()}
    assert rows == {"a.md": "ok �� end", "b.py": None}
    there = trees.files_from_tree(spark, f"file://{tmp_path}").collect()
    assert {r.path for r in there} == {"a.md", "b.py"}
