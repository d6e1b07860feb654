"""Facts of pipeline definitions: hosted workflows, GitLab and Jenkins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions.helpers import yaml_object
from wayweft.functions.strings import basename, lines_of, stem, strip
from wayweft.model import node_id
from wayweft.plans.extract.commands import command_facts
from wayweft.plans.extract.facts import fact, one, union, warning

# Top-level GitLab keys that are no jobs.
GITLAB_RESERVED = (
    "stages", "include", "default", "variables", "workflow", "image", "services", "cache", "before_script", "after_script",
)


def with_yaml(files: DataFrame) -> DataFrame:
    """Add ``json`` and ``error``; blank files have neither."""
    return files.withColumn("_y", F.when(F.col("text").rlike(r"\S"), yaml_object("text"))).select(
        "path", F.col("_y.json").alias("json"), F.col("_y.error").alias("error")
    )


def yaml_warning(turn: int, parser: str) -> Column:
    """The warning of a loaded file, null where nothing is wrong."""
    text = F.concat(F.lit("parse error "), "path", F.lit(f": {parser}: "), "error")
    return F.when(F.col("error").isNotNull(), warning([turn], text))


def yaml_warnings(loaded: DataFrame, turn: int, parser: str) -> DataFrame:
    return one(loaded.filter("error IS NOT NULL"), yaml_warning(turn, parser))


# Loaded values: objects and lists are JSON, a string is ``s:text``, any other scalar ``v:text``.
EMPTY = ("s:", "v:None", "v:False", "v:0", "v:0.0", "{}", "[]")


def is_object(value: Column) -> Column:
    return F.coalesce(value.startswith("{"), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(value.startswith("["), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(value.startswith("s:"), F.lit(False))


def is_empty(value: Column) -> Column:
    """Missing, null, zero, false, or without content."""
    return F.coalesce(value.isin(*EMPTY), F.lit(True))


def members(value: Column) -> Column:
    """``key, value`` of an object in its own order."""
    return F.map_entries(F.from_json(value, "map<string,string>"))


def field(value: Column, name: str) -> Column:
    return F.get_json_object(F.when(is_object(value), value), f"$.{name}")


def items(value: Column) -> Column:
    return F.from_json(value, "array<string>")


def as_text(value: Column) -> Column:
    """The text of a scalar; lists and objects as JSON."""
    return F.when(value.startswith("s:") | value.startswith("v:"), F.substring(value, 3, 2**30)).otherwise(value)


def text_list(value: Column) -> Column:
    """A string or a list as a list; anything else is empty."""
    none = F.array().cast("array<string>")
    return F.when(is_text(value), F.array(value)).when(is_list(value), items(value)).otherwise(none)


def _first(*places: str) -> Column:
    """Whether a row is the first one of what was unnested into ``places``, or the only one where nothing was."""
    out = F.lit(True)
    for place in places:
        out = out & (F.coalesce(F.col(place), F.lit(0)) == 0)
    return out


def _listed(*facts: Column) -> Column:
    """The facts that are there, of columns that are one fact or null."""
    return F.array_compact(F.array(*facts))


def _all_of(*lists: Column) -> Column:
    return F.flatten(F.array_compact(F.array(*lists)))


def github_actions(files: DataFrame, turn: int) -> DataFrame:
    """One pass: a file is read once, its jobs and their steps are unnested, and the first row of each brings its facts."""
    loaded = with_yaml(files)
    full = F.col("json").isNotNull() & (F.col("json") != "{}")
    given_name = field(F.col("json"), "name")
    name = F.when(is_empty(given_name), stem(F.col("path"))).otherwise(as_text(given_name))
    flows = loaded.select("path", "error", full.alias("_full"), name.alias("flow"), field(F.col("json"), "jobs").alias("jobs"))
    flow_id = node_id("workflow", F.col("flow"))
    shape = F.when(is_list(F.col("jobs")), "list").when(is_text(F.col("jobs")), "str").otherwise("scalar")
    bad = F.concat(F.lit("github_actions "), "path", F.lit(": `jobs` is "), shape, F.lit(", expected mapping"))
    of_file = _listed(
        yaml_warning(turn, "github_actions"),
        F.when(F.col("_full"), fact([turn, 0], flow_id, "workflow", F.col("flow"), F.col("path"))),
        F.when(F.col("_full") & ~is_empty(F.col("jobs")) & ~is_object(F.col("jobs")), warning([turn, 1], bad)),
    )
    jobs = flows.select(
        "path", "flow", of_file.alias("_file"), F.posexplode_outer(members(F.when(is_object(F.col("jobs")), F.col("jobs")))).alias("_j", "_e")
    ).select("path", "flow", "_file", "_j", F.col("_e.key").alias("job"), F.col("_e.value").alias("spec"))
    job_id = node_id("workflow_job", F.col("flow"), F.col("job"))
    needs = F.transform(
        text_list(field(F.col("spec"), "needs")),
        lambda n, i: fact(
            [turn, 2, F.col("_j"), 1, i], node_id("workflow_job", F.col("flow"), as_text(n)), "workflow_job", as_text(n),
            F.col("path"), None, job_id, "depends_on",
        ),
    )
    own = fact([turn, 2, F.col("_j"), 0, 0], job_id, "workflow_job", F.col("job"), F.col("path"), None, flow_id, "defines")
    listed = field(F.col("spec"), "steps")
    steps = jobs.withColumn("_job", F.concat(F.array(own), needs)).select(
        "path", "flow", "job", "_j", F.when(_first("_j"), F.col("_file")).alias("_file"), F.when(F.col("_j").isNotNull(), F.col("_job")).alias("_job"),
        F.posexplode_outer(items(F.when(is_list(listed), listed))).alias("_s", "step"),
    )

    def given(key):
        value = field(F.col("step"), key)
        return F.when(~is_empty(value), as_text(value))

    label = F.coalesce(given("name"), given("id"), F.concat(F.lit("step_"), F.col("_s").cast("string")))
    shown = steps.select(
        "*", F.when(is_object(F.col("step")), label).alias("label"), field(F.col("step"), "run").alias("run"), field(F.col("step"), "uses").alias("uses"),
    )
    step_id = node_id("workflow_step", F.col("flow"), F.col("job"), F.col("label"))
    uses = as_text(F.col("uses"))
    action = F.when(
        is_text(F.col("uses")) & (strip(uses) != ""),
        fact([turn, 2, F.col("_j"), 2, F.col("_s"), 2], node_id("module", F.lit("gha"), uses), "module", uses, None, None, step_id, "uses_env"),
    )
    declared = fact([turn, 2, F.col("_j"), 2, F.col("_s"), 0], step_id, "workflow_step", F.col("label"), F.col("path"), None, job_id, "defines")
    of_step = F.when(F.col("label").isNotNull(), _listed(declared, action))
    first = _first("_s")
    rows = shown.select(
        "path", step_id.alias("source"), F.array(F.lit(turn), F.lit(2), "_j", F.lit(2), "_s", F.lit(1)).alias("at"),
        F.when(is_text(F.col("run")), as_text(F.col("run"))).alias("cmd"),
        _all_of(F.when(first, F.col("_file")), F.when(first, F.col("_job")), of_step).alias("own"),
    )
    return command_facts(rows)


def gitlab(files: DataFrame, turn: int) -> DataFrame:
    """One pass, as for hosted workflows."""
    flow = basename(F.col("path"))
    full = F.col("json").isNotNull() & (F.col("json") != "{}")
    loaded = with_yaml(files).select("path", "error", flow.alias("flow"), F.when(full, F.col("json")).alias("json"))
    flow_id = node_id("workflow", F.lit("gitlab"), F.col("flow"))
    of_file = _listed(
        yaml_warning(turn, "gitlab_ci"),
        F.when(F.col("json").isNotNull(), fact([turn, 0], flow_id, "workflow", F.col("flow"), F.col("path"))),
    )
    jobs = loaded.select("path", "flow", of_file.alias("_file"), F.posexplode_outer(members(F.col("json"))).alias("_j", "_e")).select(
        "path", "flow", "_file", "_j", F.col("_e.key").alias("_key"), F.col("_e.value").alias("spec")
    )
    is_job = is_object(F.col("spec")) & ~F.col("_key").isin(*GITLAB_RESERVED)
    jobs = jobs.withColumn("job", F.when(is_job, F.col("_key")))

    def job_id(name):
        return node_id("workflow_job", F.lit("gitlab"), F.col("flow"), name)

    def need_name(n):
        inner = F.when(is_object(n), field(n, "job")).otherwise(n)
        return F.when(F.coalesce(inner, F.lit("v:None")) == "v:None", "<unknown>").otherwise(as_text(inner))

    needs = F.transform(
        text_list(field(F.col("spec"), "needs")),
        lambda n, i: fact(
            [turn, 1, F.col("_j"), 1, i], job_id(need_name(n)), "workflow_job", need_name(n), F.col("path"), None,
            job_id(F.col("job")), "depends_on",
        ),
    )
    own = fact([turn, 1, F.col("_j"), 0, 0], job_id(F.col("job")), "workflow_job", F.col("job"), F.col("path"), None, flow_id, "defines")
    script = F.when(F.col("job").isNotNull(), text_list(field(F.col("spec"), "script")))
    steps = jobs.withColumn("_job", F.concat(F.array(own), needs)).select(
        "path", "flow", "job", "_j", F.when(_first("_j"), F.col("_file")).alias("_file"), F.when(F.col("job").isNotNull(), F.col("_job")).alias("_job"),
        F.posexplode_outer(script).alias("_s", "_cmd"),
    )
    steps = steps.withColumn("cmd", F.when(is_text(F.col("_cmd")) & (strip(as_text(F.col("_cmd"))) != ""), as_text(F.col("_cmd"))))
    number = F.col("_s").cast("string")
    step_id = node_id("workflow_step", F.lit("gitlab"), F.col("flow"), F.col("job"), number)
    label = F.concat("job", F.lit("-step-"), number)
    declared = fact([turn, 1, F.col("_j"), 2, F.col("_s"), 0], step_id, "workflow_step", label, F.col("path"), None, job_id(F.col("job")), "defines")
    first = _first("_s")
    rows = steps.select(
        "path", step_id.alias("source"), F.array(F.lit(turn), F.lit(1), "_j", F.lit(2), "_s", F.lit(1)).alias("at"), "cmd",
        _all_of(F.when(first, F.col("_file")), F.when(first, F.col("_job")), F.when(F.col("cmd").isNotNull(), F.array(declared))).alias("own"),
    )
    return command_facts(rows)


STAGE = "\ufdd6"


def jenkins(files: DataFrame, turn: int) -> DataFrame:
    """Stages and ``sh`` steps by line; a step belongs to the stage line above it."""
    lines = F.transform(lines_of(F.col("text")), lambda l: strip(l))
    quoted = F.filter(
        lines,
        lambda l: (l.startswith("stage(") & (F.contains(l, F.lit('"')) | F.contains(l, F.lit("'")))) | l.startswith("sh "),
    )
    flow = basename(F.col("path"))
    flow_id = node_id("workflow", F.lit("jenkins"), flow)
    marked = F.array_join(F.transform(quoted, lambda l: F.when(l.startswith("stage("), F.concat(F.lit(STAGE), l)).otherwise(l)), "\n")
    blocks = files.select("path", F.posexplode_outer(F.split(marked, STAGE, -1)).alias("_b", "_block")).filter("_b IS NOT NULL").filter("_b > 0")
    rows = blocks.select("path", "_b", F.split("_block", "\n", -1).alias("_lines"))
    head = F.col("_lines")[0]
    name = F.when(F.contains(head, F.lit('"')), F.split(head, '"')[1]).otherwise(F.split(head, "'")[1])
    stages = rows.withColumn("stage", name)
    stage_id = node_id("workflow_job", F.lit("jenkins"), flow, F.col("stage"))
    steps = stages.filter("stage <> ''").select(
        "path", "_b", "stage", F.posexplode_outer(F.slice("_lines", 2, 2**30)).alias("_s", "_line")
    ).filter("_s IS NOT NULL").filter(F.col("_line").startswith("sh "))
    bare = F.btrim(strip(F.substring("_line", 4, 2**30)), F.lit("\"'"))
    steps = steps.withColumn("cmd", bare)
    step_id = node_id("workflow_step", F.lit("jenkins"), flow, F.col("stage"), F.left("cmd", F.lit(30)))
    return union(
        one(files, fact([turn, 0], flow_id, "workflow", flow, F.col("path"))),
        one(stages, fact([turn, 1, F.col("_b"), 0], stage_id, "workflow_job", F.col("stage"), F.col("path"), None, flow_id, "defines")),
        one(
            steps,
            fact([turn, 1, F.col("_b"), 1, F.col("_s"), 0], step_id, "workflow_step", F.left("cmd", F.lit(60)), F.col("path"), None, stage_id, "defines"),
        ),
        command_facts(
            steps.select(
                "path", step_id.alias("source"), F.array(F.lit(turn), F.lit(1), "_b", F.lit(1), "_s", F.lit(1)).alias("at"), "cmd"
            )
        ),
    )
