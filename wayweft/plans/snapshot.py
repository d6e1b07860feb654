"""From files to a graph snapshot: dispatch, extraction, deduplication, indexes.

All extractors read one table of files and emit one table of facts, which is kept once; nodes, edges
and warnings are three views of it. Files reach an extractor only when its rule takes them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.operators import search, sections
from wayweft.operators.dedup import dedup_edges, dedup_nodes
from wayweft.functions.strings import suffix
from wayweft.model import INDEXED_KINDS
from wayweft.plans.extract import build, ci, code, commands, containers, markdown
from wayweft.plans.extract.facts import WARNING, nothing, union
from wayweft.session import materialise
from wayweft.sources.scan import PARSERS, limit_warnings, parsers_for, within_limit

EXTRACTORS = {
    "shell": commands.shell_script, "markdown": markdown.markdown, "makefile": build.makefile,
    "github_actions": ci.github_actions, "gitlab_ci": ci.gitlab, "jenkins": ci.jenkins, "cmake": build.cmake,
    "bazel": build.bazel, "dockerfile": containers.dockerfile, "compose": containers.compose,
}


def extract(files: DataFrame) -> DataFrame:
    """Facts of ``path, text`` rows, which should be stored, since every extractor scans them.

    The file endings that occur (a handful of values) decide which extractors enter the plan.
    """
    tagged = files.select("path", "text", parsers_for(F.col("path")).alias("_parsers"))
    kinds = tagged.select(F.explode_outer("_parsers").alias("parser"), suffix(F.col("path")).alias("ending")).filter("parser IS NOT NULL")
    needed = kinds.groupBy("parser").agg(F.collect_set(F.when(F.col("parser") == "code", F.col("ending"))).alias("endings"))
    found = {row.parser: row.endings for row in needed.collect()}
    parts = []
    for turn, name in enumerate(PARSERS):
        if name in found:
            mine = tagged.filter(F.array_contains("_parsers", name)).select("path", "text")
            parts.append(code.code(mine, turn, found[name]) if name == "code" else EXTRACTORS[name](mine, turn))
    return union(*parts) if parts else nothing(files)


def ordered(facts: DataFrame) -> DataFrame:
    return facts.withColumn("ord", F.struct("path", "at"))


def fact_nodes(facts: DataFrame) -> DataFrame:
    line = F.when(F.col("line").isNotNull(), F.create_map(F.lit("line"), F.col("line")))
    rows = ordered(facts).filter(F.col("kind") != WARNING).select(
        "id", "kind", "label", F.col("npath").alias("path"),
        F.coalesce(line, F.expr("cast(map() as map<string,string>)")).alias("metadata"), "ord",
    )
    return dedup_nodes(rows)


def fact_edges(facts: DataFrame) -> DataFrame:
    command = F.when(F.col("command").isNotNull(), F.create_map(F.lit("command"), F.col("command")))
    rows = ordered(facts).filter(F.col("source").isNotNull()).select(
        "source", F.col("id").alias("target"), F.col("ekind").alias("kind"),
        F.coalesce(command, F.expr("cast(map() as map<string,string>)")).alias("metadata"), "ord",
    )
    return dedup_edges(rows)


def fact_warnings(facts: DataFrame) -> DataFrame:
    return ordered(facts).filter(F.col("kind") == WARNING).select("path", F.col("label").alias("message"), "ord")


@dataclass
class Snapshot:
    """Tables of one state of a source tree. Every query of a call reads the same snapshot."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame
    #: Stored indexes by name (symbols, docs); without them postings are made when first asked for.
    indexes: dict = field(default_factory=dict)

    @staticmethod
    def of_files(files: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> "Snapshot":
        """Build from ``path, size, text`` rows (text null where unread). Limits, where given, apply to the whole table."""
        files = materialise(files)
        taken = files if max_files is None else materialise(within_limit(files, max_files))
        readable = taken.filter(F.col("text").isNotNull())
        if max_bytes is not None:
            readable = readable.filter(F.col("size") <= max_bytes)
        facts = materialise(extract(readable.select("path", "text")))
        warnings = fact_warnings(facts).unionByName(limit_warnings(files.select("path", "size"), max_files, max_bytes))
        return Snapshot(taken, materialise(fact_nodes(facts)), materialise(fact_edges(facts)), materialise(warnings))

    # -- symbol index

    @cached_property
    def symbol_tokens(self) -> DataFrame:
        return search.tokenised(self.nodes.filter(F.col("kind").isin(*INDEXED_KINDS)).select("id", "label"), "label")

    @cached_property
    def symbol_postings(self) -> DataFrame:
        if "symbols" in self.indexes:
            return self.indexes["symbols"].postings
        return materialise(search.postings(self.symbol_tokens, "id"))

    @cached_property
    def symbol_stats(self) -> search.CorpusStats:
        if "symbols" in self.indexes:
            return self.indexes["symbols"].stats
        return search.CorpusStats.of(self.symbol_tokens)

    # -- document index

    @cached_property
    def sections(self) -> DataFrame:
        docs = self.files.filter(suffix(F.col("path")).isin(*sections.DOC_SUFFIXES) & F.col("text").isNotNull())
        cut = sections.split_sections(docs.select("path", "text"))
        return materialise(cut.withColumn("doc", F.struct("path", "start_line", "pos")))

    @cached_property
    def doc_tokens(self) -> DataFrame:
        return search.tokenised(self.sections.select("doc", "section", "body"), "section", "body")

    @cached_property
    def doc_postings(self) -> DataFrame:
        if "docs" in self.indexes:
            return self.indexes["docs"].postings
        return materialise(search.postings(self.doc_tokens, "doc", stem=True))

    @cached_property
    def doc_stats(self) -> search.CorpusStats:
        if "docs" in self.indexes:
            return self.indexes["docs"].stats
        return search.CorpusStats.of(self.doc_tokens)

    @cached_property
    def paths(self) -> DataFrame:
        return self.files.select("path")
