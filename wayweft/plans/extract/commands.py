"""Facts of shell commands: environment, invocations, artifacts. Shared by all formats that hold commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions.helpers import shell_commands
from wayweft.functions.strings import basename, join_path, parent
from wayweft.model import node_id
from wayweft.plans.extract.facts import emit, fact, one, union

# File endings of artifacts, and the texts that make a command a producer.
ARTIFACT = r"(?U)(?<![\w./-])([\w./-]+\.(?:pt|pth|ckpt|bin|jsonl?|csv|parquet|tar(?:\.gz)?|zip))"
PRODUCER_MARKS = ("--output", "-o", "save", "write", "export")
ENV_NAME = r"^[A-Z_][A-Z0-9_]*$"

# Command heads by what they run.
SCRIPT_HEADS = ("bash", "sh", "zsh", "source", ".", "python", "python3")
PACKAGE_HEADS = ("npm", "pnpm", "yarn")
CONTAINER_HEADS = ("docker", "docker-compose", "compose", "podman")


def artifacts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ARTIFACT), F.lit(1))


def produces(text: Column) -> Column:
    marked = F.contains(text, F.lit(PRODUCER_MARKS[0]))
    for mark in PRODUCER_MARKS[1:]:
        marked = marked | F.contains(text, F.lit(mark))
    return marked


def invocation(head: Column, args: Column) -> Column:
    """``struct<kind, target>`` of what a command runs, null when it runs nothing known."""
    first, second = F.get(args, 0), F.get(args, 1)

    def run(kind: str, target: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), target.alias("target"))

    given = F.size(args) > 0
    return (
        F.when(head.isin(*SCRIPT_HEADS) & given, run("script", first))
        .when(head.startswith("./"), run("script", head))
        .when((head == "make") & given, run("target", first))
        .when(head.isin(*PACKAGE_HEADS) & first.isin("run", "exec") & second.isNotNull(), run("target", F.concat(F.lit("pkg:"), second)))
        .when(head.isin(*CONTAINER_HEADS), run("service", F.lit("container-runtime")))
    )


def command_facts(df: DataFrame) -> DataFrame:
    """Facts of rows ``path, source, at, cmd``: every command in ``cmd``, charged to the node ``source``.

    ``at`` is the order prefix (an array). Bare assignments come after all commands of a text. With a
    column ``own``, an array of facts made before, these come once a row, also from rows without ``cmd``.
    """
    with_own = "own" in df.columns
    kept = ["path", "source", "at", *(["own"] if with_own else [])]
    texts = df if with_own else df.filter(F.col("cmd").rlike(r"\S"))
    cmds = texts.select(*kept, shell_commands("cmd").alias("_cmds"))
    rows = cmds.select(*kept, F.posexplode_outer("_cmds").alias("_n", "_c"))
    text = F.col("_c.text")

    def at(stage: int, i: Column) -> Column:
        return F.concat("at", F.array(F.col("_n"), F.lit(stage), i))

    def of_source(stage: int, i: Column, kind: str, label: Column, ekind: str | Column) -> Column:
        return fact(at(stage, i), node_id(kind, label), kind, label, None, None, F.col("source"), ekind)

    envs = F.transform(F.filter(F.col("_c.env"), lambda e: e.rlike(ENV_NAME)), lambda e, i: of_source(0, i, "env_var", e, "sets_env"))
    raw = F.col("_run.target")
    target = F.when(F.contains(raw, F.lit("/")), join_path(parent(F.col("path")), raw)).otherwise(raw)
    runs = F.when(
        F.coalesce(raw, F.lit("")) != "",
        F.array(
            fact(
                at(1, F.lit(0)), node_id(F.col("_run.kind"), F.col("_target")), F.col("_run.kind"), raw,
                F.when(F.contains("_target", F.lit("/")), F.col("_target")), None, F.col("source"), "invokes", text,
            )
        ),
    )
    role = F.when(produces(text), "produces").otherwise("consumes")
    # The long pattern is asked only where a file ending can be.
    arts = F.when(F.contains(text, F.lit(".")), F.transform(artifacts(text), lambda a, i: of_source(2, i, "artifact", a, role)))
    made = F.flatten(F.array_compact(F.array(envs, runs, arts)))
    if with_own:
        first = F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("own"))
        made = F.flatten(F.array_compact(F.array(first, F.when(F.col("_n").isNotNull(), made))))
    run = invocation(F.col("_c.head"), F.col("_c.args"))
    return emit(rows.withColumn("_run", run).withColumn("_target", target), made)


def shell_script(files: DataFrame, turn: int) -> DataFrame:
    """A script node per shell file, and the facts of its commands."""
    script = node_id("script", "path")
    node = one(files, fact([turn, 0], script, "script", basename(F.col("path")), F.col("path")))
    cmds = files.select("path", script.alias("source"), F.array(F.lit(turn), F.lit(1)).alias("at"), F.col("text").alias("cmd"))
    return union(node, command_facts(cmds))
