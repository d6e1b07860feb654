"""Patch analytics on hand-written patches, review inputs and patch application."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wayweft.functions.patching import _apply
from wayweft.operators import diffs, evidence, overlay
from wayweft.sources import pulls

PATCH = "@@ -3,4 +3,5 @@ def x\n ctx\n-old\n+new\n+def added_one(a):\n\n@@ -20,2 +21,1 @@\n-class Gone:\n end\n\\ No newline"


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("a/b.py", "modified", 2, 2, PATCH, 0), ("bin.png", "added", 0, 0, None, 1),
        ("c.go", "added", 3, 0, "+++ x\n+func (r *R) Run() {\n+func run2() {}\n+type T struct\n", 2),
        ("d.ts", "added", 2, 0, "@@ -0,0 +1,2 @@\n+export const go1 = 2\n+const go1 = 3\n", 3),
    ]
    return spark.createDataFrame(rows, pulls.FILE_SCHEMA)


def test_annotate(files):
    got = {r.filename: r.annotated for r in diffs.annotate(files).collect()}
    assert got["a/b.py"].split("\n") == [
        "@@ -3,4 +3,5 @@ def x", "  [N3] ctx", "- [O4] old", "+ [N4] new", "+ [N5] def added_one(a):", "  [N6] ",
        "@@ -20,2 +21,1 @@", "- [O20] class Gone:", "  [N21] end", "\\ No newline",
    ]
    assert got["c.go"].split("\n")[:2] == ["+++ x", "+ [N0] func (r *R) Run() {"] and "bin.png" not in got


def test_hunk_lines(files):
    rows = {(r.side, r.line) for r in diffs.hunk_lines(files).filter("filename = 'a/b.py'").collect()}
    assert rows == {("RIGHT", n) for n in (3, 4, 5, 6, 21)} | {("LEFT", n) for n in (3, 4, 5, 20, 21)}


def test_long_patch_is_numbered_as_a_loop_does(spark):
    """Headers, signs and other lines in a patch of many blocks, against a plain loop; no text is shuffled."""
    rng = random.Random(3)
    lines = [rng.choice(["+a", "-b", " c", "", "+++ d", "\\ e", "é", f"@@ -{rng.randint(0, 99)},2 +{rng.randint(0, 99)} @@ f"]) for _ in range(9000)]
    want, spans, old, new = [], set(), 0, 0
    for i, line in enumerate(lines):
        head = re.match(diffs.HUNK, line)
        if head:
            old, new = int(head[1]), int(head[2])
        want.append((i, line, old, new))
        if line in ("-b", " c", ""):
            spans.add(("LEFT", old))
            old += 1
        if line in ("+a", " c", ""):
            spans.add(("RIGHT", new))
            new += 1
    row = ("x", "modified", 0, 0, "\n".join(lines), 0)
    files = spark.createDataFrame([row, ("y", "added", 0, 0, "", 1), ("z", "added", 0, 0, None, 2)], pulls.FILE_SCHEMA)
    numbered = diffs.numbered_lines(files)
    assert [(r.pos, r.line, r.old_line, r.new_line) for r in numbered.orderBy("pos").collect()] == want
    assert {(r.side, r.line) for r in diffs.hunk_lines(files).collect()} == spans
    for frame in (numbered, diffs.annotate(files), diffs.render_chunks(files)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_changed_symbols_and_names(files):
    top = diffs.changed_symbols(files)
    got = [(r.name, r.score) for r in top.orderBy("pos").collect()]
    assert got == [("added_one", 3), ("Gone", 3), ("Run", 3), ("T", 3), ("go1", 2), ("run2", 1)] or got == [
        ("added_one", 3), ("Gone", 3), ("Run", 3), ("go1", 2), ("run2", 1),
    ]
    names = [r.name for r in diffs.trace_names(files, top, 6).orderBy("pos").collect()]
    assert names == ["b", "bin", "c", "d", "added_one", "Gone"]


def test_render(files):
    rows = {r.filename: r for r in diffs.render_chunks(files, 40).collect()}
    assert rows["bin.png"].chunk == "\n### bin.png (added +0/-0)\n(no patch — binary or too large)\n"
    assert rows["a/b.py"].truncated and rows["a/b.py"].chunk.endswith("\n... [truncated]\n```\n")


def test_validate_inline(spark, files):
    rows = [
        ("1", "a/b.py", 4, "RIGHT", " ok ", 3, "LEFT"), ("2", "a/b.py", 4, "LEFT", "x", 9, None), ("3", "a/b.py", 99, None, "x", None, None),
        ("4", "nope.py", 4, None, "x", None, None), ("5", "a/b.py", 5, "odd", "  ", None, None), ("6", "a/b.py", 21, None, "y", 5, None),
        ("7", None, None, None, None, None, None), ("8", "a/b.py", 6, None, "z", 7, None),
    ]
    schema = "comment_id string, path string, line int, side string, body string, start_line int, start_side string"
    out = {r.comment_id: r for r in diffs.validate_inline(spark.createDataFrame(rows, schema), diffs.hunk_spans(files)).collect()}
    assert {k for k, r in out.items() if r.kept} == {"1", "2", "6", "8"}
    assert (out["1"].body, out["1"].start_line, out["1"].start_side) == ("ok", 3, "LEFT")
    assert out["2"].start_line is None and (out["6"].start_line, out["6"].start_side) == (5, None) and out["8"].start_line is None


def test_reviews(spark):
    texts = [
        ("a", "**Verdict** — Request Changes\nx\n```inline\n[{\"path\":\"p\",\"line\":\"3\",\"body\":\"b\",\"startLine\":2}]\n```\n \n"),
        ("b", "Verdict: approve"), ("c", "nothing\n```json\nnot json\n```"), ("d", "my verdict: approve"),
    ]
    df = spark.createDataFrame(texts, "id string, text string")
    assert [r.v for r in df.select(diffs.verdict(F.col("text")).alias("v")).collect()] == ["request_changes", "approve", "comment", "comment"]
    split = diffs.split_inline_block(df)
    got = {r.id: (r.review_body, len(r.inline)) for r in split.collect()}
    assert got["a"] == ("**Verdict** — Request Changes\nx", 1) and got["c"] == ("nothing", 0)
    row = diffs.inline_comments(split, "id").first()
    assert (row.comment_id, row.path, row.line, row.start_line) == ("a#0", "p", 3, 2)


def test_coordinates_and_headers(spark):
    rows = [
        ("https://github.com/o/r/pull/7/files", None), ("o/r#8", None), (" 9 ", "https://github.com/me/x.git"), ("9", "https://other.org/a/b"), ("zz", None),
    ]
    out = pulls.coordinates(spark.createDataFrame(rows, "input string, remote string")).collect()
    assert [(r.owner, r.repo, r.number) for r in out] == [("o", "r", 7), ("o", "r", 8), ("me", "x", 9), (None, None, None), (None, None, None)]
    head = pulls.pull_headers(
        spark.createDataFrame([(None, "b", None, "me/x", "up/x")], "title string, body string, author string, head_repo string, base_repo string")
    ).first()
    assert (head.title, head.author, head.is_fork) == ("", "", True)


def test_evidence_markdown(spark):
    text = 'pre\n```json\n{"symbol_summary":[{"symbol":"s","total_refs":3,"out_of_pr_files":1}],"verified_docs":[{"source":"a","target_path":"b.md","line":4,"kind":"odd","snippet":"q"}],"notes":" n "}\n```'
    df = spark.createDataFrame([("1", text, ["t", "t"]), ("2", "prose", [])], "id string, text string, tools array<string>")
    rows = evidence.evidence_markdown(df.select("id", "tools").join(evidence.evidence_rows(df, "id"), "id")).collect()
    got = {r.id: r.markdown for r in rows}
    assert got["1"] == (
        "**Localizer evidence** (tools used: t; tool calls: 2)\n\nPer-symbol reference counts (repo-wide, from tools):\n"
        "- `s`: total_refs=3, out_of_pr_files=1\n\nDoc cross-references (verified):\n- [related] `a` → `b.md:4` — `q`\n\nNotes: n"
    )
    assert "WARNING" in got["2"] and "ZERO tool calls" in got["2"]


def test_patch_application():
    base = "a\nb\nc\nd\ne\n"
    assert _apply(base, "@@ -2,2 +2,3 @@\n b\n-c\n+C\n+C2\n@@ -5,1 +6,1 @@\n-e\n+E\n") == "a\nb\nC\nC2\nd\nE\n"
    assert _apply("x\n" + base, "@@ -2,2 +2,1 @@\n b\n-c\n") == "x\na\nb\nd\ne\n"
    assert _apply(base, "@@ -2,1 +2,1 @@\n-zzz\n+y\n") is None
    assert _apply("", "@@ -0,0 +1,2 @@\n+one\n+two\n").startswith("one\ntwo")


def test_eviction(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "used_at int, size int")
    assert sorted((r.used_at, r.evicted) for r in overlay.evict_over_budget(rows, 35).collect()) == [(1, True), (2, True), (3, False)]
    assert not any(r.evicted for r in overlay.evict_over_budget(rows, 60).collect())


def test_archives(spark, tmp_path):
    import tarfile

    from tests.trees import write_tree
    from wayweft.sources.tree import files_from_archives

    write_tree(tmp_path / "repo-abc", {"a/b.py": "x = 1\n", "node_modules/c.js": "no", "d.md": "# t"})
    (tmp_path / "other.txt").write_text("outside")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "repo-abc", "repo-abc")
        tar.add(tmp_path / "other.txt", "other.txt")
    rows = files_from_archives(spark, [str(tmp_path / "t.tar.gz")]).collect()
    assert sorted((r.path, r.text) for r in rows) == [("a/b.py", "x = 1\n"), ("d.md", "# t")]


def test_hosted_slug(spark):
    rows = spark.createDataFrame([("git@github.com:o/r.git",), ("https://github.com/o/r",), ("http://x/y.git",)], "u string")
    assert [r.s for r in rows.select(pulls.hosted_slug(F.col("u")).alias("s")).collect()] == ["o/r", "o/r", "http://x/y"]


def test_requests_stay_apart(spark, files):
    """Two requests that touch a file of the same name are numbered, ranked and checked on their own."""
    other = files.filter("filename = 'a/b.py'").withColumn("patch", F.lit("@@ -50,1 +50,1 @@\n-def lost(a):\n+def found(a):"))
    both = files.withColumn("request", F.lit("r1")).unionByName(other.withColumn("request", F.lit("r2")))
    got = {(r.request, r.side, r.line) for r in diffs.hunk_lines(both).filter("filename = 'a/b.py'").collect()}
    assert got == {("r1", "RIGHT", n) for n in (3, 4, 5, 6, 21)} | {("r1", "LEFT", n) for n in (3, 4, 5, 20, 21)} | {("r2", "RIGHT", 50), ("r2", "LEFT", 50)}
    symbols = diffs.changed_symbols(both)
    names = {(r.request, r.pos): r.name for r in symbols.collect()}
    assert {n for (r, _), n in names.items() if r == "r2"} == {"lost", "found"} and ("r1", 1) in names and ("r2", 1) in names
    traced = diffs.trace_names(both, symbols, 3).collect()
    assert sorted(r.pos for r in traced if r.request == "r2") == [1, 2, 3]
    alone = [tuple(r) for r in diffs.annotate(files).collect()]
    assert {tuple(r)[1:] for r in diffs.annotate(both).filter("request = 'r1'").collect()} == set(alone)
    comment = spark.createDataFrame(
        [(q, "c", "a/b.py", 50, "RIGHT", "note", None, None) for q in ("r1", "r2")],
        "request string, comment_id string, path string, line int, side string, body string, start_line int, start_side string",
    )
    assert {r.request: r.kept for r in diffs.validate_inline(comment, diffs.hunk_spans(both)).collect()} == {"r1": False, "r2": True}


def test_lone_object_is_no_comment(spark):
    text = "Fine.\n```json\n{\"path\": \"a.py\", \"line\": 3, \"body\": \"x\"}\n```"
    rows = spark.createDataFrame([(1, text), (2, text.replace("{", "[{").replace("}", "}]"))], "id int, text string")
    assert {r.id: len(r.inline) for r in diffs.split_inline_block(rows).collect()} == {1: 0, 2: 1}


def test_comments_without_a_path_are_spread(spark):
    """They meet no file, so no task has to take them all."""
    files = spark.createDataFrame([("a.py", "@@ -1,1 +1,2 @@\n+x\n y")], "filename string, patch string")
    rows = [(f"c{i}", None if i % 3 else "", 1, "RIGHT", "text", None, None) for i in range(200)] + [("k", "a.py", 1, "RIGHT", "text", None, None)]
    comments = spark.createDataFrame(rows, "comment_id string, path string, line int, side string, body string, start_line int, start_side string")
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in kept}
    try:
        for name, value in kept.items():
            spark.conf.set(name, value)
        out = diffs.validate_inline(comments, diffs.hunk_spans(files)).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {r.comment_id for r in out if r.kept} == {"k"} and len(out) == 201
    assert len({r.p for r in out if r.path is None}) > 1 and len({r.p for r in out if r.path == ""}) > 1
