"""Repository-wide reports: kind counts, ranked files, entrypoints, lineage, contract gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("count"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``node_count`` and ``edge_count``."""
    counted = nodes.select(F.lit(1).alias("is_node"), F.lit(0).alias("is_edge")).unionAll(
        edges.select(F.lit(0), F.lit(1))
    )
    return counted.agg(
        F.coalesce(F.sum("is_node"), F.lit(0)).cast("long").alias("node_count"),
        F.coalesce(F.sum("is_edge"), F.lit(0)).cast("long").alias("edge_count"),
    )


def top_files(edges: DataFrame, top_k: int) -> DataFrame:
    """Files by number of outgoing edges; ties keep the order in which the files were first seen."""
    return (
        edges.filter(F.col("source").startswith("file:"))
        .groupBy("source")
        .agg(F.count("*").alias("edge_count"), F.min("ord").alias("_seen"))
        .orderBy(F.desc("edge_count"), "_seen")
        .limit(top_k)
        .select(F.expr("substring(source, 6)").alias("path"), "edge_count")
    )


def entrypoints(nodes: DataFrame, limit: int) -> DataFrame:
    """Scripts, targets and workflows (with jobs), each list ordered by path and label and cut at ``limit``."""
    category = (
        F.when(F.col("kind") == "script", "scripts")
        .when(F.col("kind") == "target", "targets")
        .when(F.col("kind").isin("workflow", "workflow_job"), "workflows")
    )
    ranked = Window.partitionBy("category").orderBy("path", "label", "ord")
    return (
        nodes.filter(F.col("kind").isin("script", "target", "workflow", "workflow_job"))
        .select(category.alias("category"), "id", "label", F.coalesce("path", F.lit("")).alias("path"), "ord")
        .withColumn("pos", F.row_number().over(ranked))
        .filter(F.col("pos") <= limit)
        .drop("ord")
    )


def artifact_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind").isin("produces", "consumes"))


def lineage(nodes: DataFrame, edges: DataFrame, label: str | None = None) -> DataFrame:
    """Producers and consumers, one row per (artifact, role, source), of a graph's edges (unique by source, target and kind).

    With a label, only its first artifact node counts; its id is looked up first and cuts the edges at
    their scan. Rows instead of lists keep an artifact with very many consumers spread over the tasks.
    """
    artifacts = nodes.filter(F.col("kind") == "artifact")
    if label is not None:
        named = artifacts.filter(F.col("label") == label).orderBy("ord").select("id").first()
        only = F.lit(named.id if named else None)
        artifacts, edges = artifacts.filter((F.col("label") == label) & (F.col("id") == only)), edges.filter(F.col("target") == only)
    artifacts = artifacts.select(F.col("id").alias("artifact_id"), F.col("label").alias("artifact"))
    role = F.when(F.col("kind") == "produces", "producer").otherwise("consumer")
    links = artifact_edges(edges).select(F.col("target").alias("artifact_id"), role.alias("role"), "source")
    return artifacts.join(links, "artifact_id").select("artifact", "artifact_id", "role", "source")


def contract_gaps(edges: DataFrame) -> DataFrame:
    """Artifacts consumed but never produced, and produced but never consumed.

    One aggregation over the artifact edges finds both sides, so each edge is shuffled at most once
    and hot artifacts are folded before the shuffle.
    """
    made = F.bool_or(F.col("kind") == "produces")
    used = F.bool_or(F.col("kind") == "consumes")
    return (
        artifact_edges(edges)
        .groupBy(F.col("target").alias("artifact_id"))
        .agg(made.alias("made"), used.alias("used"))
        .filter(F.col("made") != F.col("used"))
        .select(
            F.when(F.col("used"), "missing_producer").otherwise("missing_consumer").alias("gap"), "artifact_id"
        )
    )


def missing_producer(edges: DataFrame) -> DataFrame:
    return contract_gaps(edges).filter(F.col("gap") == "missing_producer").select("artifact_id")


def missing_consumer(edges: DataFrame) -> DataFrame:
    return contract_gaps(edges).filter(F.col("gap") == "missing_consumer").select("artifact_id")
