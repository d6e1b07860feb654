"""Facts of build files: make, CMake and Bazel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions.strings import strip
from wayweft.model import node_id
from wayweft.plans.extract.commands import command_facts
from wayweft.plans.extract.facts import emit, fact, union

CMAKE_TARGET = r"(?m)^[^\S\n]*+add_(?:library|executable)\(([^\s\)]+)"
CMAKE_LINK = r"(?m)^[^\S\n]*+target_link_libraries\(([^\s\)]+)\s+([^\)]+)\)"
CMAKE_SCOPES = ("PUBLIC", "PRIVATE", "INTERFACE")
BAZEL_NAME = r"(?U)\bname\s*=\s*\"([^\"]+)\""
BAZEL_DEPS = r"(?sU)\bdeps\s*=\s*\[(.*?)\]"

# Marks put before rule heads and other statements, so that a split yields rules with their recipes.
RULE, OTHER = "\ufdd4", "\ufdd5"
RULE_LINE = r"(?m)^(?![\t#]| *(?:ifn?eq|ifn?def|else|endif)\b)([^\n:=#]+::?(?![:=])(?:[^\n=]*$|[^\n;]*;[^\n]*$|[^\n]*\$\([^\n]*$))"
OTHER_LINE = r"(?m)^(?![\t#\n" + RULE + r"]| *(?:ifn?eq|ifn?def|else|endif)\b|[ \r]*$)"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def makefile(files: DataFrame, turn: int) -> DataFrame:
    """Targets, prerequisites and recipe commands of makefiles.

    Continued lines are joined first. Conditionals and blank lines do not end a rule, other
    statements do. Words with variables are no targets; a lone variable is a prerequisite.
    """
    joined = F.regexp_replace("text", r"(?<![ \t])[ \t]*+\\\n[ \t]*+", " ")
    marked = F.regexp_replace(F.regexp_replace(joined, RULE_LINE, RULE + "$1"), OTHER_LINE, OTHER)
    rules = files.select("path", F.posexplode_outer(F.split(marked, RULE, -1)).alias("_r", "_block")).filter("_r IS NOT NULL").filter("_r > 0")
    lines = rules.select("path", "_r", F.split(F.split("_block", OTHER)[0], "\n", -1).alias("_lines"))
    head = F.regexp_replace(F.col("_lines")[0], r"(?<!\\)#.*$", "")
    before = F.substring_index(head, ";", 1)
    deps = F.regexp_replace(before, r"^[^:]*::?", "")
    ordered = F.regexp_extract(deps, r"\|\s*(\S.*)$", 1)
    normal = F.when(F.contains(deps, F.lit(":")), "").when(ordered != "", ordered).otherwise(F.substring_index(deps, "|", 1))
    parsed = lines.select(
        "path", "_r",
        F.filter(_words(F.substring_index(before, ":", 1)), lambda w: ~F.contains(w, F.lit("$"))).alias("targets"),
        F.filter(_words(normal), lambda w: ~F.contains(w, F.lit("$")) | w.rlike(r"^\$[({][\w.-]+[)}]$")).alias("deps"),
        F.concat(
            F.when(F.contains(head, F.lit(";")), F.array(F.regexp_extract(F.col("_lines")[0], r";(.*)$", 1))).otherwise(F.array(F.lit(""))),
            F.transform(F.filter(F.expr("slice(_lines, 2, size(_lines))"), lambda l: l.startswith("\t")), lambda l: F.substring(l, 2, 2**30)),
        ).alias("recipe"),
    )

    def target(name: Column) -> Column:
        return node_id("target", F.col("path"), name)

    def of_target(name, i):
        own = fact([turn, F.col("_r"), 0, i, 0], target(name), "target", name, F.col("path"))
        needs = F.transform(
            "deps",
            lambda d, j: fact([turn, F.col("_r"), 0, i, j + 1], target(d), "target", d, F.col("path"), None, target(name), "depends_on"),
        )
        return F.concat(F.array(own), needs)

    declared = emit(parsed, F.flatten(F.transform("targets", of_target)))
    steps = parsed.select("path", "_r", "targets", F.posexplode_outer("recipe").alias("_l", "_cmd")).filter("_l IS NOT NULL")
    cmd = strip(F.regexp_replace("_cmd", r"^[@+-]+", ""))
    runs = steps.select("path", "_r", "_l", cmd.alias("cmd"), F.posexplode_outer("targets").alias("_t", "_name")).filter("_t IS NOT NULL").select(
        "path", target(F.col("_name")).alias("source"), F.array(F.lit(turn), "_r", F.lit(1), "_l", "_t").alias("at"), "cmd"
    )
    return union(declared, command_facts(runs))


def cmake(files: DataFrame, turn: int) -> DataFrame:
    def target(name):
        return node_id("target", F.col("path"), name)

    declared = F.transform(
        F.regexp_extract_all("text", F.lit(CMAKE_TARGET), F.lit(1)),
        lambda t, i: fact([turn, 0, i], target(t), "target", t, F.col("path")),
    )

    def link(whole, i):
        left, right = F.regexp_extract(whole, CMAKE_LINK, 1), F.regexp_extract(whole, CMAKE_LINK, 2)
        needs = F.filter(_words(right), lambda d: ~F.upper(d).isin(*CMAKE_SCOPES))
        return F.concat(
            F.array(fact([turn, 1, i, 0], target(left), "target", left, F.col("path"))),
            F.transform(needs, lambda d, j: fact([turn, 1, i, j + 1], target(d), "target", d, F.col("path"), None, target(left), "depends_on")),
        )

    links = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(CMAKE_LINK), F.lit(0)), link))
    return emit(files, F.concat(declared, links))


def bazel(files: DataFrame, turn: int) -> DataFrame:
    """Every named rule; all dependency lists are charged to the first rule of the file."""
    names = files.withColumn("_names", F.regexp_extract_all("text", F.lit(BAZEL_NAME), F.lit(1)))
    first = node_id("target", F.col("path"), F.get("_names", 0))
    declared = F.transform(
        "_names", lambda n, i: fact([turn, 0, i], node_id("target", F.col("path"), n), "target", n, F.col("path"))
    )

    def block(text, i):
        labels = F.regexp_extract_all(text, F.lit(r"\"([^\"]+)\""), F.lit(1))
        return F.transform(
            labels, lambda d, j: fact([turn, 1, i, j], node_id("target", d), "target", d, F.col("path"), None, first, "depends_on")
        )

    deps = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(BAZEL_DEPS), F.lit(1)), block))
    return emit(names, F.when(F.size("_names") > 0, F.concat(declared, deps)))
