import io
import json

import pytest

from tests.trees import TREE
from wayweft.sinks import store


def test_overview_and_entrypoints(engine, tree):
    out = engine.repo_localizer(str(tree))
    assert out["stats"]["edge_count"] > 100 and out["stats"]["node_count"] == sum(out["node_kinds"].values())
    top = out["top_files_by_edges"]
    assert [t["edge_count"] for t in top] == sorted((t["edge_count"] for t in top), reverse=True)
    assert out["warnings"] == []
    points = engine.repo_localizer(str(tree), view="entrypoints", limit=2)
    assert all(len(v) <= 2 for v in points.values()) and points["workflows"][0]["label"] == "Main CI"


def test_arguments_are_checked(engine, tree):
    for call in (
        lambda: engine.code_localizer(str(tree), op="trace"),
        lambda: engine.code_localizer(str(tree), op="path", start_node_id="a"),
        lambda: engine.code_localizer(str(tree), op="nope"),
        lambda: engine.code_localizer(str(tree), op="context", node_ids=["a"], depth=9),
        lambda: engine.doc_localizer(str(tree), op="resolve_link", source_file="a"),
        lambda: engine.repo_localizer(str(tree), top_k=0),
        lambda: engine.repo_localizer(str(tree / "README.md")),
    ):
        with pytest.raises(ValueError):
            call()


def test_artifact_contracts_and_path(engine, tree):
    art = engine.code_localizer(str(tree), op="artifact", artifact="out/app.tar.gz")
    assert art["producers"] == ["script:tools/pack.sh", "target:Makefile:all"]
    assert art["consumers"][0] == "file:Dockerfile" and len(art["consumers"]) == 2
    none = engine.code_localizer(str(tree), op="artifact", artifact="zzz")
    assert none == {"op": "artifact", "artifact": "zzz", "producers": [], "consumers": []}
    gaps = engine.code_localizer(str(tree), op="contracts")
    assert "artifact:models/m.ckpt" in gaps["missing_producer"] and gaps["missing_consumer"] == []
    found = engine.code_localizer(str(tree), op="path", start_node_id="workflow:Main_CI", end_node_id="module:gha:actions/checkout@v4")
    assert found["path"] == [
        "workflow:Main_CI", "workflow_job:Main_CI:lint", "workflow_step:Main_CI:lint:step_0", "module:gha:actions/checkout@v4",
    ]
    assert engine.code_localizer(str(tree), op="path", start_node_id="q", end_node_id="q")["found"]
    assert not engine.code_localizer(str(tree), op="path", start_node_id="q", end_node_id="r")["found"]


def test_context(engine, tree):
    out = engine.code_localizer(str(tree), op="context", node_ids=["target:Makefile:all", " ", "target:Makefile:all", "nobody"])
    assert out["queries"] == 2
    down = out["results"][0]["neighborhood"]["downstream"]
    assert {"from": "target:Makefile:lib", "to": "target:Makefile:%.o", "kind": "depends_on"} in down
    assert out["results"][1]["neighborhood"] == {"upstream": [], "downstream": []}


def test_trace(engine, tree):
    out = engine.code_localizer(str(tree), op="trace", queries=["all", "Run Lint", "", "all", "zz_none", "boot"], limit_per_query=4)
    assert out["queries"] == 4 and not out["truncated"]
    kinds = [m["match_kind"] for m in out["results"][0]["matches"]]
    assert "build_target" in kinds
    lint = out["results"][1]["matches"][0]
    assert lint["match_kind"] == "ci_runner" and any(n.get("command") == "bash tools/lint.sh" for n in lint["outgoing"])
    assert out["results"][2]["matches"] == []
    capped = engine.code_localizer(str(tree), op="trace", queries=["all", "lint", "build"], max_total_matches=1)
    assert capped["total_matches"] == 1 and capped["truncated"]


def test_trace_symbol_chain(spark, tmp_path):
    from tests.trees import write_tree
    from wayweft.engine import Engine

    root = write_tree(tmp_path, {"scripts/build.py": "def main():\n    pass\n", "run.sh": "python scripts/build.py\n", "x.sh": "bash build.py\n"})
    out = Engine(spark).code_localizer(str(root), op="trace", queries=["main"])
    got = [(m["script_source"]["id"], m["invoked_script"]["id"]) for m in out["results"][0]["matches"]]
    assert got == [("script:run.sh", "script:scripts/build.py"), ("script:x.sh", "script:build.py")]
    # No index row for a substring that is no prefix: the fallback pass answers.
    loose = Engine(spark).code_localizer(str(root), op="trace", queries=["ain"], limit_per_query=1)
    assert loose["total_matches"] == 1


def test_document_search(engine, tree):
    hit = engine.doc_localizer(str(tree), query="calibrate nation")["matches"][0]
    assert (hit["path"], hit["section"], hit["start_line"]) == ("docs/setup.md", "Calibration", 6)
    assert hit["snippet"] == "<mark>Calibrating</mark> the <mark>nations</mark> of models."
    assert engine.doc_localizer(str(tree), query="calibrate", path_glob="other/*")["matches"] == []
    assert engine.doc_localizer(str(tree), query="!!")["matches"] == []


def test_resolve_link(engine, tree):
    ok = engine.doc_localizer(str(tree), op="resolve_link", source_file="docs/guide.md", target="./setup#x")
    assert ok["canonical"] == "docs/setup.md" and ok["exists_on_disk"]
    up = engine.doc_localizer(str(tree), op="resolve_link", source_file="docs/guide.md", target="../../README.md")
    assert up["canonical"] == "README.md"
    bad = engine.doc_localizer(str(tree), op="resolve_link", source_file="docs/guide.md", target="#only")
    assert bad["reason"] == "empty target"


def test_workspace_overlay(engine, tree):
    diff = (
        "diff --git a/README.md b/README.md\n--- a/README.md\n+++ b/README.md\n@@ -1,1 +1,2 @@\n hello\n+# Added Words\n"
        "diff --git a/tools/new.sh b/tools/new.sh\nnew file mode 100644\n--- /dev/null\n+++ b/tools/new.sh\n@@ -0,0 +1,1 @@\n+make shiny\n"
        "diff --git a/src/bad.py b/src/bad.py\n--- a/src/bad.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-def ok():\n-    pass\n-class (:\n"
    )
    made = engine.pr_workspace(str(tree), "0123456789abcdef", diff)
    assert made["applied_diff"] and made == engine.pr_workspace(str(tree), "0123456789abcdef", diff)
    snap = engine.snapshot(made["worktree_path"])
    ids = {r.id for r in snap.nodes.select("id").collect()}
    assert "target:shiny" in ids and "file:src/bad.py" not in ids
    assert not engine.pr_workspace(str(tree), "0123456789abcdef")["applied_diff"]
    with pytest.raises(ValueError):
        engine.pr_workspace(str(tree), "short")


def test_snapshot_is_reused_and_renewed(spark, tmp_path):
    from tests.trees import write_tree
    from wayweft.engine import Engine

    root = write_tree(tmp_path / "t", {"a.sh": "make one\n"})
    own = Engine(spark, cache_folder=str(tmp_path / "cache"), capacity=1)
    first = own.snapshot(str(root))
    assert own.snapshot(str(root)) is first
    (root / "a.sh").write_text("make second\n")
    second = own.snapshot(str(root))
    assert {r.target for r in second.edges.collect()} == {"target:second"}
    assert len(list((tmp_path / "cache").iterdir())) == 2
    again = Engine(spark, cache_folder=str(tmp_path / "cache")).snapshot(str(root))
    assert {r.target for r in again.edges.collect()} == {"target:second"}
    assert store.clear_store(spark, str(tmp_path / "cache")) == 2


def test_export(snapshot):
    out = io.StringIO()
    store.export_json(snapshot, out)
    doc = json.loads(out.getvalue())
    assert [n["id"] for n in doc["nodes"]] == sorted(n["id"] for n in doc["nodes"])
    keys = [(e["kind"], e["source"], e["target"]) for e in doc["edges"]]
    assert keys == sorted(keys) and doc["stats"]["edge_count"] == len(keys)
    assert len(TREE) > 20
