"""Scan rules of a source tree: pruning, limits, reading, and which parser takes which file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayweft.functions.strings import basename, suffix

# Folders a scan leaves out, and the one hidden folder it enters. Limits are arguments; without them a scan takes all.
IGNORED = (
    ".git", ".hg", ".svn", "node_modules", "dist", "build", ".venv", "venv", "coverage", "__pycache__",
    ".mypy_cache", ".pytest_cache",
)
OPEN_HIDDEN = ".github"

# File endings and names each parser takes. A file can go to several parsers.
CODE_SUFFIXES = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".cc", ".cpp", ".cxx", ".h", ".hpp",
)
SHELL_SUFFIXES = (".sh", ".bash", ".zsh")
MARKDOWN_SUFFIXES = (".md", ".markdown")
COMPOSE_NAMES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
PARSERS = (
    "code", "shell", "markdown", "makefile", "github_actions", "gitlab_ci", "jenkins", "cmake", "bazel",
    "dockerfile", "compose",
)
# Names for trying out the dispatch rules.
SAMPLE_NAMES = (
    "a.py", "b.TS", "c.sh", "README.md", "GNUmakefile", "ci.yml", ".gitlab-ci.yml", "Jenkinsfile", "CMakeLists.txt",
    "BUILD", "Dockerfile", "compose.yaml", "x.txt", "noext",
)


def is_pruned(path: Column, include_hidden: bool = False) -> Column:
    """Whether any part of a relative path is an ignored name or hidden."""
    def out(part):
        bad = part.isin(*IGNORED)
        return bad if include_hidden else bad | (part.startswith(".") & (part != OPEN_HIDDEN))

    return F.exists(F.split(path, "/"), out)


def parsers_for(path: Column) -> Column:
    """Array of the parsers that take a file, in the order in which they run."""
    name, ext = F.lower(basename(path)), suffix(path)
    rules = [
        (ext.isin(*CODE_SUFFIXES), "code"),
        (ext.isin(*SHELL_SUFFIXES), "shell"),
        (ext.isin(*MARKDOWN_SUFFIXES), "markdown"),
        (name.isin("makefile", "gnumakefile"), "makefile"),
        (path.startswith(".github/workflows/") & ext.isin(".yml", ".yaml"), "github_actions"),
        (name == ".gitlab-ci.yml", "gitlab_ci"),
        (name == "jenkinsfile", "jenkins"),
        (name == "cmakelists.txt", "cmake"),
        (name.isin("build", "build.bazel"), "bazel"),
        (name == "dockerfile", "dockerfile"),
        (name.isin(*COMPOSE_NAMES), "compose"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(tag)) for test, tag in rules]))


def is_local_link(target: Column) -> Column:
    low = F.lower(target)
    away = low.startswith("http://")
    for start in ("https://", "mailto:", "ftp://", "//", "#"):
        away = away | low.startswith(start)
    return ~away


def within_limit(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """The first files of a scan in path order, component by component; None takes all.

    Only paths go through the top list; the contents stay where they are.
    """
    if max_files is None:
        return files
    head = files.select("path").orderBy(F.split("path", "/")).limit(max_files)
    return files.join(head, "path", "left_semi")


def limit_warnings(files: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Warnings ``path, message, ord`` of a scan: files over the size cap, and the file limit when it is hit."""
    def shaped(rows: DataFrame, path: Column, message: Column) -> DataFrame:
        return rows.select(
            path.alias("path"), message.alias("message"), F.struct(path.alias("path"), F.array(F.lit(0)).alias("at")).alias("ord")
        )

    too_big = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    large = files.filter(too_big)
    too_large = F.concat(F.lit("read error "), "path", F.lit(": file too large"))
    if max_files is None:
        return shaped(large, F.col("path"), too_large)
    head = files.select("path", "size").orderBy(F.split("path", "/")).limit(max_files + 1)
    ranked = head.withColumn("_n", F.row_number().over(Window.orderBy(F.split("path", "/"))))
    return shaped(
        ranked.filter((F.col("_n") <= max_files) & too_big), F.col("path"), too_large
    ).unionByName(
        shaped(ranked.filter(F.col("_n") > max_files), F.lit(""), F.lit(f"scan limit reached at {max_files} files"))
    )
