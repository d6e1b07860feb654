"""Snapshots as parquet by content key, and graph exports."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayweft.operators import reports
from wayweft.plans.snapshot import Snapshot
from wayweft.sinks import text_index
from wayweft.sinks.versions import Versions, versioned_folders

#: Raised when the tables change, so that older folders are built anew.
FORMAT = 2
TABLES = ("files", "nodes", "edges", "warnings")
INDEXES = {"symbols": ("symbol_tokens", "id", False), "docs": ("doc_tokens", "doc", True)}


def write_snapshot(snapshot: Snapshot, folder: str) -> None:
    """Store the tables and indexes of a snapshot as the folder's next version; a reader of an older one is not disturbed.

    Nodes and edges are partitioned by kind, so kind filters read only their folders.
    """
    spark = snapshot.files.sparkSession
    versions = Versions(spark, folder)
    before = versions.current().number
    place = versions.new_place("tables")
    for name in TABLES:
        writer = getattr(snapshot, name).write
        if name in ("nodes", "edges"):
            writer = writer.partitionBy("kind")
        writer.parquet(f"{place}/{name}")
    for name, (tokens, key, stem) in INDEXES.items():
        text_index.append(spark, f"{place}/{name}", getattr(snapshot, tokens), key, stem)
    versions.commit({"format": FORMAT, "tables": place.rpartition("/")[2]}, before)


def read_snapshot(spark: SparkSession, folder: str) -> Snapshot | None:
    """The newest stored snapshot, or None when there is none of this format."""
    state = Versions(spark, folder).current().state
    if state.get("format") != FORMAT:
        return None
    place = f"{folder.rstrip('/')}/{state['tables']}"
    tables = {name: spark.read.parquet(f"{place}/{name}") for name in TABLES}
    nodes = tables["nodes"].select("id", "kind", "label", "path", "metadata", "ord")
    edges = tables["edges"].select("source", "target", "kind", "metadata", "ord")
    indexes = {name: text_index.TextIndex.open(spark, f"{place}/{name}") for name in INDEXES}
    return Snapshot(tables["files"], nodes, edges, tables["warnings"], indexes)


def clear_store(spark: SparkSession, folder: str) -> int:
    """Delete all stored snapshots under a cache folder; returns how many there were."""
    return sum(Versions(spark, place).delete() for place in versioned_folders(spark, folder))


def sorted_nodes(snapshot: Snapshot) -> DataFrame:
    return snapshot.nodes.orderBy("id").select("id", "kind", "label", "path", "metadata")


def sorted_edges(snapshot: Snapshot) -> DataFrame:
    return snapshot.edges.orderBy("kind", "source", "target").select("source", "target", "kind", "metadata")


def export_rows(snapshot: Snapshot, folder: str) -> None:
    """Nodes, edges and warnings as folders of JSON lines, written by the tasks in canonical order."""
    sorted_nodes(snapshot).write.mode("overwrite").json(f"{folder}/nodes")
    sorted_edges(snapshot).write.mode("overwrite").json(f"{folder}/edges")
    snapshot.warnings.orderBy("ord").select("message").write.mode("overwrite").json(f"{folder}/warnings")


def export_json(snapshot: Snapshot, out: TextIO) -> None:
    """One JSON document, streamed partition by partition; the driver never holds the graph."""
    def block(name: str, rows: DataFrame) -> None:
        out.write(f'  "{name}": [')
        separator = "\n"
        for row in rows.toLocalIterator():
            item = row.message if name == "warnings" else row.asDict(recursive=True)
            text = json.dumps(item, indent=2).replace("\n", "\n    ")
            out.write(f"{separator}    {text}")
            separator = ",\n"
        out.write("],\n" if separator == "\n" else "\n  ],\n")

    out.write("{\n")
    block("nodes", sorted_nodes(snapshot))
    block("edges", sorted_edges(snapshot))
    block("warnings", snapshot.warnings.orderBy("ord").select("message"))
    totals = reports.totals(snapshot.nodes, snapshot.edges).first()
    out.write(f'  "stats": {{\n    "node_count": {totals.node_count},\n    "edge_count": {totals.edge_count}\n  }}\n}}\n')


def review_json(inline: DataFrame) -> DataFrame:
    """Kept review comments as JSON, one per row."""
    kept = inline.filter("kept").select("path", "line", "side", "body", "start_line", "start_side")
    return kept.select(F.to_json(F.struct(*kept.columns)).alias("json"))
