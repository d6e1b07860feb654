"""Registered extraction queries: files are put together from table rows, one small file per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayweft.operators.prefix import nearest_before
from wayweft.plans.extract import budget, build, ci, code, commands, containers, markdown
from wayweft.session import spread
from wayweft.sources import tables as t

LF = "chr(10)"


def _edges(facts):
    return facts.filter("source IS NOT NULL").select("path", "source", F.col("ekind").alias("kind"), F.col("id").alias("target"))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def command_classification(spark, folder):
    """What the command of every order runs, through the shell tokenizer."""
    rows = t.command_texts(spark, folder)
    files = rows.select(
        F.lit("jobs/a.sh").alias("path"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source"),
        F.array(F.lit(0)).alias("at"), F.col("command").alias("cmd"),
    )
    return commands.command_facts(files).filter("ekind = 'invokes'").select("source", "kind", "id", "label", "npath", "command")


COMMANDS_SQL = """
cmds AS (
  SELECT o_orderkey, (['bash', 'python3', 'make', 'npm', 'docker', './go.sh', 'echo', 'source'])[o_orderkey % 8 + 1] AS head,
    concat('scripts/', lower(substring(o_orderpriority, 3, 20)), '.sh') AS script,
    concat_ws(' ', (['bash', 'python3', 'make', 'npm', 'docker', './go.sh', 'echo', 'source'])[o_orderkey % 8 + 1],
      CASE WHEN o_orderkey % 8 = 3 THEN 'run' END, concat('scripts/', lower(substring(o_orderpriority, 3, 20)), '.sh'),
      CASE WHEN o_orderkey % 3 = 0 THEN '--output' END, concat('dist/c', o_custkey, '.tar.gz'),
      CASE WHEN o_orderkey % 5 = 0 THEN concat('in-', o_custkey, '.parquet') END) AS command FROM orders)"""

CLASSIFY_SQL = f"""WITH {COMMANDS_SQL}, w AS (
  SELECT *, string_split(regexp_replace(command, ' +', ' ', 'g'), ' ')[2] AS arg FROM cmds),
r AS (
  SELECT concat('order:', o_orderkey) AS source, command,
    CASE WHEN head IN ('bash', 'python3', 'source', './go.sh') THEN 'script' WHEN head IN ('make', 'npm') THEN 'target' WHEN head = 'docker' THEN 'service' END AS kind,
    CASE WHEN head = './go.sh' THEN './go.sh' WHEN head = 'npm' THEN concat('pkg:', string_split(command, ' ')[3]) WHEN head = 'docker' THEN 'container-runtime' ELSE arg END AS label FROM w)
SELECT source, kind, CASE WHEN contains(label, '/') THEN concat(kind, ':jobs/', regexp_replace(label, '^\\./', '')) ELSE concat(kind, ':', label) END AS id, label,
  CASE WHEN contains(label, '/') THEN concat('jobs/', regexp_replace(label, '^\\./', '')) END AS npath, command FROM r WHERE kind IS NOT NULL"""


def artifact_extract(spark, folder):
    text = F.col("command")
    role = F.when(commands.produces(text), "produces").otherwise("consumes")
    rows = t.command_texts(spark, folder).select("o_orderkey", "command", commands.artifacts(text).alias("_a"))
    return rows.select("o_orderkey", role.alias("kind"), F.explode_outer("_a").alias("artifact")).filter("artifact IS NOT NULL")


ARTIFACT_SQL = rf"""WITH {COMMANDS_SQL}
SELECT o_orderkey, CASE WHEN contains(command, '-o') OR contains(command, 'save') OR contains(command, 'write') OR contains(command, 'export') THEN 'produces' ELSE 'consumes' END AS kind,
  unnest(regexp_extract_all(command, '([\w./-]+\.(?:pt|pth|ckpt|bin|jsonl?|csv|parquet|tar(?:\.gz)?|zip))')) AS artifact FROM cmds"""


def shell_scripts(spark, folder):
    """A script per event: environment prefix, pipeline, heredoc, loop and substitution."""
    kind, number = F.upper("event_type"), F.col("event_id").cast("string")
    text = _text(
        "# note; bash no.sh\n", kind, "=1 lower=2 python3 -u jobs/e", number, ".py | tee log && bash \"run ", number, ".sh\"\n",
        "cat <<'END'\nmake hidden\nEND\nfor f in a b; do make t", (F.col("user_id") % 7).cast("string"), "; done\n",
        "OUT_", number, "=$(sh inner.sh) # rest\n",
    )
    files = spread(t.table(spark, folder, "events")).select(F.concat(F.lit("s/e"), number, F.lit(".sh")).alias("path"), text.alias("text"))
    return _edges(commands.shell_script(files, 1))


SHELL_SQL = """WITH e AS (SELECT *, concat('s/e', event_id, '.sh') AS path, concat('script:s/e', event_id, '.sh') AS source FROM events)
SELECT path, source, 'sets_env' AS kind, concat('env_var:', upper(event_type)) AS target FROM e
UNION ALL SELECT path, source, 'invokes', 'script:-u' FROM e
UNION ALL SELECT path, source, 'invokes', concat('script:run_', event_id, '.sh') FROM e
UNION ALL SELECT path, source, 'invokes', concat('target:t', user_id % 7) FROM e
UNION ALL SELECT path, source, 'invokes', 'script:inner.sh' FROM e
UNION ALL SELECT path, source, 'sets_env', concat('env_var:OUT_', event_id) FROM e"""


def jenkins_stage_fill(spark, folder):
    """Documents as pipelines: every fifth line opens a stage, the others are commands of the stage above."""
    def line(text, i):
        first = F.regexp_extract(text, "([A-Za-z]+)", 1)
        return F.when(i % 5 == 1, F.concat(F.lit("  stage('S"), i.cast("string"), F.lit("') {"))).otherwise(
            F.concat(F.lit("    sh 'make "), first, F.lit("'"))
        )

    docs = t.doc_rows(spark, folder)
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/Jenkinsfile"))
    files = docs.select(path.alias("path"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))
    return _edges(ci.jenkins(files, 6))


JENKINS_SQL = f"""WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(text, {LF}) AS x FROM documents)),
s AS (
  SELECT concat('d', doc_id, '/Jenkinsfile') AS path, i, CASE WHEN i % 5 = 1 THEN concat('S', i) END AS own,
    last_value(CASE WHEN i % 5 = 1 THEN concat('S', i) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS stage,
    rtrim(concat('make ', regexp_extract(line, '([A-Za-z]+)', 1))) AS cmd FROM l),
c AS (SELECT *, concat('workflow_step:jenkins:Jenkinsfile:', stage, ':', replace(trim(left(cmd, 30)), ' ', '_')) AS step FROM s WHERE own IS NULL AND stage IS NOT NULL)
SELECT path, 'workflow:jenkins:Jenkinsfile' AS source, 'defines' AS kind, concat('workflow_job:jenkins:Jenkinsfile:', own) AS target FROM s WHERE own IS NOT NULL
UNION ALL SELECT path, concat('workflow_job:jenkins:Jenkinsfile:', stage), 'defines', step FROM c
UNION ALL SELECT path, step, 'invokes', concat('target:', cmd[6:]) FROM c WHERE length(cmd) > 5"""


def markdown_facts(spark, folder):
    """Pages as markdown: their links in several spellings, code, images and tool lists."""
    def line(h, i):
        return (
            F.when(i % 5 == 0, F.concat(F.lit("See [a]("), h, F.lit(".md#x).")))
            .when(i % 5 == 1, F.concat(F.lit("An ![i]("), h, F.lit(") and `[c]("), h, F.lit(")`")))
            .when(i % 5 == 2, F.concat(F.lit("- tool"), i.cast("string"), F.lit("\n")))
            .when(i % 5 == 3, F.concat(F.lit("```\n[n]("), h, F.lit(")\n```")))
            .otherwise(F.concat(F.lit("Use `fn"), i.cast("string"), F.lit("` or [w](https://x.org"), h, F.lit(")")))
        )

    plain = F.filter(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda h: h.rlike("^[A-Za-z]+$"))
    pages = t.table(spark, folder, "pages")
    files = pages.select(
        F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.array_join(F.transform(plain, line), "\n").alias("text"),
    )
    return _edges(markdown.markdown(files, 2)).distinct()


MARKDOWN_SQL = """WITH h AS (
  SELECT page_id, list_filter(regexp_extract_all(html, 'href="/([^"]*)"', 1), lambda x: regexp_matches(x, '^[A-Za-z]+$')) AS l FROM pages),
r AS (SELECT concat('p/', page_id, '.md') AS path, unnest(l) AS h, unnest(range(len(l))) AS i FROM h)
SELECT DISTINCT path, concat('file:', path) AS source, 'depends_on' AS kind, CASE i % 5 WHEN 0 THEN concat('file:p/', h, '.md') WHEN 2 THEN concat('module:tool:tool', i) ELSE concat('module:tool:fn', i) END AS target
FROM r WHERE i % 5 IN (0, 2, 4)"""


def build_facts(spark, folder):
    """A CMake and a Bazel file per part."""
    key, parts = F.col("p_partkey").cast("string"), t.table(spark, folder, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    cmake = parts.select(
        _text("p", key, "/CMakeLists.txt").alias("path"),
        _text("add_library(", name, " a.c)\n  target_link_libraries(", name, " PUBLIC ", F.col("p_brand"), "\n  private ", F.col("p_type"), ")\n").alias("text"),
    )
    bazel = parts.select(
        _text("p", key, "/BUILD").alias("path"),
        _text('r(name = "', name, '", deps = [\n ":', F.col("p_brand"), '",\n "//', F.col("p_type"), '"])\nq(name="z", deps=[":y"])\n').alias("text"),
    )
    return _edges(build.cmake(cmake, 7)).unionByName(_edges(build.bazel(bazel, 8)))


BUILD_SQL = """WITH p AS (SELECT *, replace(p_name, ' ', '_') AS n, concat('p', p_partkey, '/CMakeLists.txt') AS c, concat('p', p_partkey, '/BUILD') AS b FROM part)
SELECT c AS path, concat('target:', c, ':', n) AS source, 'depends_on' AS kind, concat('target:', c, ':', unnest([p_brand, replace(p_type, ' ', '_')])) AS target FROM p
UNION ALL SELECT b, concat('target:', b, ':', n), 'depends_on', concat('target:', unnest([concat(':', p_brand), concat('//', replace(p_type, ' ', '_')), ':y'])) FROM p"""


def makefile_facts(spark, folder):
    key = F.col("c_custkey").cast("string")
    nation = F.col("c_nationkey").cast("string")
    text = _text(
        "V := a b\nall", key, " x: n", nation, " $(V) \\\n  tail # c\n\t@bash go.sh \\\n\t  --out a.csv\nifdef Q\n\tmake sub", nation, "\nendif\n\nn", nation, ":\n\techo hi\n",
    )
    files = spread(t.table(spark, folder, "customer")).select(_text("c", key, "/Makefile").alias("path"), text.alias("text"))
    return _edges(build.makefile(files, 3))


MAKE_SQL = """WITH c AS (SELECT c_nationkey AS n, concat('c', c_custkey, '/Makefile') AS path, concat('target:c', c_custkey, '/Makefile:') AS t, unnest([concat('all', c_custkey), 'x']) AS own FROM customer)
SELECT path, concat(t, own) AS source, 'depends_on' AS kind, concat(t, unnest([concat('n', n), '$(V)', 'tail'])) AS target FROM c
UNION ALL SELECT path, concat(t, own), 'invokes', unnest(['script:go.sh', concat('target:sub', n)]) FROM c
UNION ALL SELECT path, concat(t, own), 'produces', 'artifact:a.csv' FROM c"""


def container_facts(spark, folder):
    """An image definition and a compose file per supplier."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    supplier = t.table(spark, folder, "supplier")
    docker = supplier.select(
        _text("s", key, "/Dockerfile").alias("path"),
        _text("FROM base:", nation, " AS st\n# COPY no /x\nCOPY --from=st /a /b\nADD one", key, ".zip \\\n  two /srv/\nFROM fin:1\n").alias("text"),
    )
    compose = supplier.select(
        _text("s", key, "/compose.yml").alias("path"),
        _text("services:\n  w", key, ":\n    image: img:", nation, "\n    depends_on: [d", nation, ", q]\n  q: {image: r}\n").alias("text"),
    )
    return _edges(containers.dockerfile(docker, 9)).unionByName(_edges(containers.compose(compose, 10)))


CONTAINER_SQL = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, concat('s', s_suppkey, '/Dockerfile') AS d, concat('s', s_suppkey, '/compose.yml') AS c FROM supplier)
SELECT d AS path, concat('file:', d) AS source, 'builds_from' AS kind, concat('container_image:', unnest([concat('base:', n), 'fin:1'])) AS target FROM s
UNION ALL SELECT d, concat('file:', d), 'depends_on', 'container_image:st' FROM s
UNION ALL SELECT d, concat('file:', d), 'consumes', concat('artifact:', unnest([concat('one', k, '.zip'), 'two'])) FROM s
UNION ALL SELECT c, concat('service:w', k), 'runs_in', concat('container_image:img:', n) FROM s
UNION ALL SELECT c, concat('service:w', k), 'depends_on', concat('service:', unnest([concat('d', n), 'q'])) FROM s
UNION ALL SELECT c, 'service:q', 'runs_in', 'container_image:r' FROM s"""


def workflow_facts(spark, folder):
    """A hosted workflow and a GitLab pipeline per customer."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    customer = spread(t.table(spark, folder, "customer"))
    hosted = customer.select(
        _text(".github/workflows/w", key, ".yml").alias("path"),
        _text(
            "name: W ", key, "\njobs:\n  zeta:\n    steps:\n    - uses: act/v@", nation, "\n    - name: Go on\n      run: |\n        make a\n        bash b.sh\n"
            "  alpha:\n    needs: zeta\n    steps: []\n",
        ).alias("text"),
    )
    lab = customer.select(
        _text("g", key, "/.gitlab-ci.yml").alias("path"),
        _text("stages: [x]\njob", key, ":\n  needs: [{job: up}, other]\n  script: [make g, '', 5]\n").alias("text"),
    )
    return _edges(ci.github_actions(hosted, 4)).unionByName(_edges(ci.gitlab(lab, 5)))


WORKFLOW_SQL = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, concat('.github/workflows/w', c_custkey, '.yml') AS p, concat('g', c_custkey, '/.gitlab-ci.yml') AS g,
  concat('W_', c_custkey) AS w, concat('workflow_job:gitlab:.gitlab-ci.yml:job', c_custkey) AS j, concat('workflow_step:gitlab:.gitlab-ci.yml:job', c_custkey, ':0') AS s FROM customer)
SELECT p AS path, concat('workflow:', w) AS source, 'defines' AS kind, concat('workflow_job:', w, ':', unnest(['zeta', 'alpha'])) AS target FROM c
UNION ALL SELECT p, concat('workflow_job:', w, ':alpha'), 'depends_on', concat('workflow_job:', w, ':zeta') FROM c
UNION ALL SELECT p, concat('workflow_job:', w, ':zeta'), 'defines', concat('workflow_step:', w, ':zeta:', unnest(['step_0', 'Go_on'])) FROM c
UNION ALL SELECT p, concat('workflow_step:', w, ':zeta:step_0'), 'uses_env', concat('module:gha:act/v@', n) FROM c
UNION ALL SELECT p, concat('workflow_step:', w, ':zeta:Go_on'), 'invokes', unnest(['target:a', 'script:b.sh']) FROM c
UNION ALL SELECT g, 'workflow:gitlab:.gitlab-ci.yml', 'defines', j FROM c
UNION ALL SELECT g, j, 'depends_on', concat('workflow_job:gitlab:.gitlab-ci.yml:', unnest(['up', 'other'])) FROM c
UNION ALL SELECT g, j, 'defines', s FROM c
UNION ALL SELECT g, s, 'invokes', 'target:g' FROM c"""


def code_facts(spark, folder):
    """A TypeScript and a Python file per customer."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    customer = spread(t.table(spark, folder, "customer"))
    ts = (
        _text("c", key, "/a.ts"),
        _text(
            "import { x } from 'mod", nation, "'; // import y from 'no'\n/* gone() */\nexport class K", key, " {\n  run(a) {\n    work", nation,
            "('call()');\n  }\n}\nconst f = () => { g(); };\nlast();\n",
        ),
    )
    py = (
        _text("c", key, "/a.py"),
        _text("import os.path as p\nfrom .m", nation, " import z\n\ndef f", key, "(a=d()):\n    def g():\n        p.join('x()')\n    return g()\n\nf", key, "()\n"),
    )
    # Unnested pairs: a test on the path stays above the shuffle and runs in all tasks.
    pair = F.array(*[F.struct(path.alias("path"), text.alias("text")) for path, text in (ts, py)])
    files = customer.select(F.explode_outer(pair).alias("file")).select("file.path", "file.text")
    return _edges(code.code(files, 0, [".ts", ".py"]))


CODE_SQL = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, concat('c', c_custkey, '/a.ts') AS t, concat('c', c_custkey, '/a.py') AS p FROM customer)
SELECT t AS path, concat('file:', t) AS source, 'imports' AS kind, concat('module:mod', n) AS target FROM c
UNION ALL SELECT t, concat('file:', t), 'defines', concat('code_symbol:', t, ':', unnest([concat('K', k), 'run', 'f'])) FROM c
UNION ALL SELECT t, concat('code_symbol:', t, ':run'), 'calls', concat('code_symbol:work', n) FROM c
UNION ALL SELECT t, concat('code_symbol:', t, ':f'), 'calls', 'code_symbol:g' FROM c
UNION ALL SELECT t, concat('file:', t), 'calls', 'code_symbol:last' FROM c
UNION ALL SELECT p, concat('file:', p), 'imports', concat('module:', unnest(['os.path', concat('.m', n)])) FROM c
UNION ALL SELECT p, concat('file:', p), 'defines', concat('code_symbol:', p, ':', unnest([concat('f', k), 'g'])) FROM c
UNION ALL SELECT p, concat('code_symbol:', p, ':f', k), 'calls', concat('code_symbol:', unnest(['d', 'g'])) FROM c
UNION ALL SELECT p, concat('code_symbol:', p, ':g'), 'calls', 'code_symbol:join' FROM c
UNION ALL SELECT p, concat('file:', p), 'calls', concat('code_symbol:f', k) FROM c"""


ENDINGS = (".js", ".go", ".rs", ".java", ".cpp")


def parse_warnings(spark, folder):
    """Documents as source files, more or less of their lines put behind calls as comments: which are refused as no code."""
    docs = t.doc_rows(spark, folder)
    number = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (number % 5 + 1).cast("int"))

    def line(text, i):
        return F.when(i % 4 < F.floor(number / 5) % 5, _text("call", i.cast("string"), "(); // ", text)).otherwise(text)

    files = docs.select(
        _text("d", number.cast("string"), ending).alias("path"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text")
    )
    return code.refusals(files, 0, list(ENDINGS)).select("path", F.col("label").alias("message"))


WARNINGS_SQL = rf"""WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(text, {LF}) AS x FROM documents)),
files AS (
  SELECT concat('d', doc_id, (['.js', '.go', '.rs', '.java', '.cpp'])[doc_id % 5 + 1]) AS path, doc_id % 5 AS kind,
    string_agg(CASE WHEN i % 4 < doc_id // 5 % 5 THEN concat('call', i, '(); // ', line) ELSE line END, {LF} ORDER BY i) AS text FROM l GROUP BY doc_id),
code AS (
  SELECT path, kind, strlen(text) AS total, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', {LF}, 'g'), '\\[^\n]', '__', 'g'),
    '("[^"\n]*"|''[^''\n]*''|`[^`]*`)|//[^\n]*|/\*(?s:.*?)\*/', '\1', 'g') AS text FROM files WHERE regexp_matches(text, '[^ \t\n\x0b\f\r]')),
bare AS (
  SELECT path, total, unnest(x) AS line, unnest(range(len(x))) AS i FROM (
    SELECT path, total, string_split(CASE kind WHEN 2 THEN regexp_replace(text, '"[^"\n]*"|`[^`]*`|''[^''\n]''', '""', 'g')
      ELSE regexp_replace(text, '"[^"\n]*"|`[^`]*`|''[^''\n]*''', '""', 'g') END, {LF}) AS x FROM code)),
{budget.SQL}
SELECT path, message FROM refused"""


def call_asof_definition(spark, folder):
    """Per user, the last click before each other event, as definitions before calls."""
    events = t.table(spark, folder, "events")
    marks = events.filter("event_type = 'click'").select("user_id", "ts", "event_id", F.col("props").alias("symbol"))
    calls = events.filter("event_type <> 'click'").select("user_id", "ts", "event_id")
    return nearest_before(marks, calls, "user_id", ["ts", "event_id"], "symbol").select("event_id", F.col("nearest").alias("symbol"))


ASOF_SQL = """
SELECT e.event_id, c.props AS symbol FROM (SELECT * FROM events WHERE event_type <> 'click') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts"""


QUERIES = {
    "command_classification": (command_classification, CLASSIFY_SQL),
    "artifact_regex_extract": (artifact_extract, ARTIFACT_SQL),
    "shell_script_facts": (shell_scripts, SHELL_SQL),
    "jenkins_stage_fill": (jenkins_stage_fill, JENKINS_SQL),
    "markdown_facts": (markdown_facts, MARKDOWN_SQL),
    "build_file_facts": (build_facts, BUILD_SQL),
    "makefile_facts": (makefile_facts, MAKE_SQL),
    "container_facts": (container_facts, CONTAINER_SQL),
    "workflow_facts": (workflow_facts, WORKFLOW_SQL),
    "parse_warnings": (parse_warnings, WARNINGS_SQL),
    "code_facts": (code_facts, CODE_SQL),
    "call_asof_definition": (call_asof_definition, ASOF_SQL),
}
