"""Facts of every format, on the fixture tree and on awkward inputs."""

import pytest
from pyspark.sql import functions as F

from wayweft.functions import helpers
from wayweft.plans.extract import build, ci, commands, containers, markdown
from wayweft.plans.extract.facts import WARNING


@pytest.fixture(scope="module")
def edges(snapshot):
    return {(r.source, r.kind, r.target) for r in snapshot.edges.select("source", "kind", "target").collect()}


@pytest.fixture(scope="module")
def nodes(snapshot):
    return {r.id: r for r in snapshot.nodes.collect()}


def facts(spark, extractor, path, text):
    rows = extractor(spark.createDataFrame([(path, text)], "path string, text string"), 0).orderBy("at").collect()
    return rows


def links(rows):
    return [(r.source, r.ekind, r.id) for r in rows if r.source]


def test_python(edges, nodes):
    f = "file:src/app.py"
    assert {e for e in edges if e[0] == f} == {
        (f, "defines", f"code_symbol:src/app.py:{n}") for n in ("App", "run", "stop", "main")
    } | {(f, "imports", f"module:{m}") for m in ("json", "os.path", ".util", ".")} | {
        (f, "calls", "code_symbol:deco"), (f, "calls", "code_symbol:main"),
    }
    assert ("code_symbol:src/app.py:run", "calls", "code_symbol:dumps") in edges
    assert nodes["code_symbol:src/app.py:run"].metadata == {"line": "9"}
    assert ("file:src/bad.py", "defines", "code_symbol:src/bad.py:ok") in edges


@pytest.mark.parametrize(
    "path,defs,mods",
    [
        ("src/web.ts", {"boot", "Router", "run", "execute"}, {"path", "fs", "./helper"}),
        ("src/lib.go", {"Do", "Top"}, {"fmt", "os/exec"}),
        ("src/lib.rs", {"P", "Q", "go"}, {"std::fs::{self,_File}"}),
        ("src/Main.java", {"Main", "run", "I", "size"}, {"java.util.List", "org.x.Y"}),
        ("src/native.cpp", {"add", "go"}, {"vector", "a.h"}),
    ],
)
def test_brace_languages(edges, path, defs, mods):
    f = f"file:{path}"
    assert {e[2].split(":")[-1] for e in edges if e[:2] == (f, "defines")} == defs
    assert {e[2].removeprefix("module:") for e in edges if e[:2] == (f, "imports")} == mods


def test_calls_know_their_scope(edges):
    for caller, callee in (
        ("code_symbol:src/web.ts:run", "Widget"), ("code_symbol:src/web.ts:execute", "read"), ("file:src/web.ts", "boot"),
        ("code_symbol:src/lib.rs:go", "println!"), ("code_symbol:src/Main.java:run", "Helper"), ("code_symbol:src/native.cpp:add", "sum"),
    ):
        assert (caller, "calls", f"code_symbol:{callee}") in edges
    assert not any(e[2] in ("code_symbol:x", "code_symbol:call(x)", "code_symbol:if") for e in edges if e[0].endswith("web.ts"))


def test_pruned_files_leave_no_trace(edges):
    assert not any("never" in e[2] for e in edges)


def test_workflows(edges, nodes):
    assert nodes["workflow:Main_CI"].label == "Main CI"
    step = "workflow_step:Main_CI:lint:Run_Lint"
    assert (step, "invokes", "script:.github/workflows/tools/lint.sh") in edges and (step, "sets_env", "env_var:MODE") in edges
    assert ("workflow_job:Main_CI:deploy", "depends_on", "workflow_job:Main_CI:lint") in edges
    assert nodes["workflow_step:Main_CI:deploy:step_1"].label == "step_1"
    assert ("workflow_step:gitlab:.gitlab-ci.yml:build:0", "invokes", "target:all") in edges
    assert nodes["workflow_step:gitlab:.gitlab-ci.yml:build:0"].label == "build-step-0"
    assert ("workflow_job:gitlab:.gitlab-ci.yml:deploy", "depends_on", "workflow_job:gitlab:.gitlab-ci.yml:<unknown>") in edges
    assert not any(n.startswith("workflow_job:gitlab:.gitlab-ci.yml:image") for n in nodes)
    jenkins = [e for e in edges if e[0] == "workflow:jenkins:Jenkinsfile"]
    assert {e[2].split(":")[-1] for e in jenkins} == {"Compile", "Ship"}


@pytest.mark.parametrize("extractor", [ci.github_actions, ci.gitlab, containers.compose])
@pytest.mark.parametrize("text", ["a: [", "- 1\n- 2\n"])
def test_bad_yaml_becomes_a_warning(spark, extractor, text):
    rows = facts(spark, extractor, "x.yml", text)
    assert [r.kind for r in rows] == [WARNING] and rows[0].label.startswith("parse error x.yml:")


def test_odd_shapes(spark):
    assert [r.kind for r in facts(spark, ci.github_actions, "a/b.yml", "on: x\njobs: [1]\n")] == ["workflow", WARNING]
    assert [r.kind for r in facts(spark, containers.compose, "c.yml", "services: [a]\n")] == [WARNING]
    assert facts(spark, ci.github_actions, "a/b.yml", " \n") == []


def test_shell_forms(spark):
    def run(text):
        return links(facts(spark, commands.shell_script, "scripts/x.sh", text))

    me = "script:scripts/x.sh"
    assert run("cd src && bash inside.sh\npython publish.py | tee log.txt\n") == [
        (me, "invokes", "script:inside.sh"), (me, "invokes", "script:publish.py"),
    ]
    assert run("PYTHONPATH=src python lib/foo.py\n") == [
        (me, "sets_env", "env_var:PYTHONPATH"), (me, "invokes", "script:scripts/lib/foo.py"),
    ]
    assert run("OUT=models/model.ckpt\n") == [(me, "sets_env", "env_var:OUT"), (me, "consumes", "artifact:models/model.ckpt")]
    assert run("cat <<EOF > /tmp/note\nbash text.sh\nEOF\nbash real.sh\n") == [(me, "invokes", "script:real.sh")]
    assert run("for f in a b; do bash \"sub/$f.sh\"; done") == [(me, "invokes", "script:scripts/sub/$f.sh")]
    assert run("X=$(bash in.sh) # bash no.sh\nif true; then ./go; fi\npython -m mod\nnpm run build\nyarn add x\n") == [
        (me, "invokes", "script:in.sh"), (me, "invokes", "script:scripts/go"), (me, "invokes", "script:-m"),
        (me, "invokes", "target:pkg:build"), (me, "sets_env", "env_var:X"),
    ]
    assert run("docker build . ; podman run x") == [(me, "invokes", "service:container-runtime")] * 2
    assert run("tool a.csv b.json -o c.tar.gz") == [
        (me, "produces", f"artifact:{a}") for a in ("a.csv", "b.json", "c.tar.gz")
    ]


def test_makefile(spark):
    text = "A=1\nall test: dep $(VAR) \\\n  more | order\n\t@-bash \\\n\t  go.sh\nifdef X\n\tmake sub\nendif\n%.o: %.c ; cc x.bin\n$(OBJ): y\nB := 2\n\tnot a recipe\n"
    got = links(facts(spark, build.makefile, "Makefile", text))
    t = "target:Makefile:"
    assert (t + "all", "depends_on", t + "order") in got and (t + "all", "depends_on", t + "dep") not in got
    assert (t + "test", "invokes", "script:go.sh") in got and (t + "all", "invokes", "target:sub") in got
    assert (t + "%.o", "depends_on", t + "%.c") in got and (t + "%.o", "consumes", "artifact:x.bin") in got
    assert not any("OBJ" in e[0] or e[2].endswith(":y") for e in got)


def test_build_files(edges):
    assert ("target:CMakeLists.txt:tool", "depends_on", "target:CMakeLists.txt:m") in edges
    assert ("target:BUILD.bazel:base", "depends_on", "target://ext:z") in edges


def test_containers(edges):
    f = "file:Dockerfile"
    assert {e[1:] for e in edges if e[0] == f} == {
        ("builds_from", "container_image:python:3.12"), ("builds_from", "container_image:debian:12"),
        ("builds_from", "container_image:${BASE}"), ("depends_on", "container_image:builder"),
        ("consumes", "artifact:out/app.tar.gz"), ("consumes", "artifact:conf/"), ("consumes", "artifact:one.zip"),
    }
    assert ("service:web", "depends_on", "service:cache") in edges and ("service:db", "runs_in", "container_image:postgres:16") in edges


def test_markdown(edges, spark):
    f = "file:docs/guide.md"
    assert {e[2] for e in edges if e[0] == f} == {
        "file:docs/setup.md", "file:docs/../README.md", "file:docs/other_file.md", "module:tool:grep", "module:tool:terminal",
        "module:tool:fooBar", "module:tool:inline",
    }
    rows = facts(spark, markdown.markdown, "a/b.md", "[![i](i.png)](in.md 'T') [x](y(1).md) \\[no](no.md)\n\n~~~\n[z](z.md)\n~~~\n* __init__\n1. tool_x\n   more\n")
    assert [r.id for r in rows if r.source] == ["file:a/in.md", "file:a/y(1).md"]


def test_odd_files_end_no_job():
    from wayweft.functions import helpers

    assert helpers._python("x = " + " + ".join(["f(1)"] * 3000) + "\n") is not None
    value, error = helpers._yaml("a: &x [*x]\n")
    assert value is None and error
    assert helpers._all_commands("echo " + "$(" * 4000 + ")" * 4000) is not None


def test_error_budget(spark):
    """Prose and binary contents are refused, code is not; what stands before a fault is kept."""
    from wayweft.plans.extract import code
    from wayweft.plans.extract.facts import WARNING

    prose = "this is a story about words\nthat never were any code\n" * 5
    rows = [
        ("a.js", prose), ("b.js", "function f(a) { return g(a); }\n// " + "plain words in a comment " * 20), ("c.go", "package main\nfunc main() { run() }\n"),
        ("d.java", "public class A {\n  private static final int b = 1;\n  void c() { d(); }\n}\n"), ("e.cpp", "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f"),
        ("f.rs", "pub fn a() { b(); }\n" + "} ) ]\n" * 40), ("g.js", "a b c"), ("h.js", ""), ("i.py", "def ok():\n    pass\n\ndef broken(:\n"), ("j.py", "x = 1\n"), ("m.py", prose),
        ("k.cpp", "unsigned long int x;\nstruct A { virtual void f() const; };\n"), ("l.ts", "export default async function go() { await run(); }\n"),
    ]
    facts = code.code(spark.createDataFrame(rows, "path string, text string"), 0).collect()
    told = {r.path: r.label for r in facts if r.kind == WARNING}
    assert set(told) == {"a.js", "e.cpp", "f.rs", "m.py"} and "96%" in told["a.js"]
    names = {(r.path, r.label) for r in facts if r.kind == "code_symbol"}
    assert ("i.py", "ok") in names and ("b.js", "f") in names and not {p for p, _ in names} & {"a.js", "e.cpp", "f.rs"}
    assert {r.path for r in facts if r.kind == "file"} == {p for p, _ in rows}


@pytest.mark.parametrize("extract, shown", [(ci.github_actions, "name: W\njobs:\n  a:\n    steps:\n    - run: make a\n    - run: make b\n"), (ci.gitlab, "a:\n  script: [make a, make b]\n")])
def test_pipelines_are_read_once(spark, extract, shown):
    """One pass over the files: the YAML of a file is read by one step of the plan, however many kinds of facts it gives."""
    files = spark.createDataFrame([("x/.gitlab-ci.yml", shown)], "path string, text string")
    made = extract(files, 4)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [yaml_object") == 1
    assert plan.count("ArrowEvalPython [shell_commands") == 1
    assert sorted(r.id for r in made.filter("ekind = 'invokes'").collect()) == ["target:a", "target:b"]
    assert made.filter("source IS NULL").count() == 1


@pytest.mark.parametrize("extract", [ci.github_actions, ci.gitlab])
def test_pipelines_without_jobs_keep_their_own_facts(spark, extract):
    texts = ["name: only\n", "", "a: [", "jobs: [x]\n", "jobs: {a: {steps: [1, {run: ' '}]}, b: 3}\n"]
    files = spark.createDataFrame([(f"x/f{i}.yml", text) for i, text in enumerate(texts)], "path string, text string")
    kinds = {}
    for r in extract(files, 4).collect():
        kinds.setdefault(r.path, []).append(r.kind)
    assert "x/f1.yml" not in kinds and kinds["x/f2.yml"] == ["warning"]
    assert all(kinds[f"x/f{i}.yml"].count("workflow") == 1 for i in (0, 3, 4))


def test_shell_texts_with_carriage_returns_end():
    assert [c[2:4] for c in helpers._all_commands("echo hi\r\nmake\x0ba\r\n")] == [("echo", ["hi"]), ("make", ["a"])]


@pytest.mark.parametrize("text", ["a: 1\t# c\n", "a: \ufeffb\n", "a: {? b\n}\n", "a: [\n", "a: {b: 2020-01-01, c: [yes, 0x1f, ~, 'é']}\n"])
def test_both_yaml_readers_agree(monkeypatch, text):
    fast = helpers._yaml(text)
    monkeypatch.setattr(helpers, "_FAST_YAML", None)
    assert helpers._yaml(text) == fast


def test_warnings_are_told_in_one_pass(spark):
    """Refusals are those among all facts, without a look at what else a file holds (F20)."""
    from wayweft.plans.extract import code
    from wayweft.plans.extract.facts import WARNING

    prose = "this is a story about words\r\nthat never were any code\n" * 5
    texts = [prose, "f(a);\n", "", " \n", "} ) ]\n" * 40, "ümlaut and çode words\n" * 9, "`a\nb c d e\n`" + prose, "// x\n/* a b c\n d e f */ a b c d\n", "\x01" * 20]
    rows = [(f"d{i}{ending}", text) for i, text in enumerate(texts) for ending in (".js", ".go", ".rs", ".java", ".cpp", ".txt")]
    files = spark.createDataFrame(rows, "path string, text string")
    braces = [".js", ".go", ".rs", ".java", ".cpp"]
    told = code.refusals(files, 0, braces)
    want = code.code(files, 0, braces).filter(F.col("kind") == WARNING)
    assert sorted(told.collect()) == sorted(want.collect()) and told.count() > 15
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "Union" not in plan
    python = spark.createDataFrame([("a.py", prose), ("b.py", "x = 1\n")], "path string, text string")
    assert [r.path for r in code.refusals(python, 0).collect()] == ["a.py"]


def test_prose_is_found_without_rewriting_lines():
    """The pattern for three names in a row agrees with cutting the keywords out first (F20)."""
    import re
    from itertools import product

    from wayweft.plans.extract import budget

    def python(pattern):
        return re.compile(pattern.replace(r"\x{80}", "\x80").replace(r"\x{10ffff}", "\U0010ffff"), re.ASCII)

    words, joined = re.compile(budget._WORDS, re.ASCII), re.compile(budget._PROSE, re.ASCII)
    made = python(budget._prose(budget.KEYWORDS))
    for parts in product(("a", "int", "9b", "9", "é", "inté", "int9", "_x;"), (" ", "\t ", ", "), ("b", "get", "ü", "7", "c"), (" ", "-"), ("c", "void", "é1", "1", "intx")):
        for line in ("".join(parts), "for " + "".join(parts) + " d", "(" + "".join(parts) + " if"):
            plain = words.sub(";", re.sub(r"[^\x00-\x7f]", "x", line))
            assert bool(joined.search(plain)) == bool(made.search(line)), line


def test_tests_on_paths_run_in_all_tasks(spark):
    """The customers are spread as they are; what is asked of the made files comes after that (F9)."""
    from wayweft.plans.catalog import all_queries

    plan = all_queries()["code_facts"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = [part.split("Repartition", 1)[-1] for part in plan.split("Relation")[:-1]]
    assert "Repartition" in plan and not any("Filter" in part or "regexp" in part for part in below)
