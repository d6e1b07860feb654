"""First-writer-wins deduplication of nodes and edges.

``min_by`` aggregates before the shuffle, so a key that holds a large share of all rows reaches its
reducer as one row per map task instead of as all its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Keep, per key, the row with the smallest ``order`` value."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    return first_per_key(nodes, ["id"])


def dedup_edges(edges: DataFrame) -> DataFrame:
    return first_per_key(edges, ["source", "target", "kind"])
