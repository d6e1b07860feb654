"""Bounded breadth-first expansion and shortest path as level-by-level joins.

A small frontier is broadcast after its size was checked, so that a level only scans the edges; a
large one is shuffled, where skewed start nodes are split at run time. Levels are checkpointed, so a
lost executor does not replay the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayweft.session import SMALL_ROWS, broadcast_if_small, materialise


def _walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """All edges that leave a node at distance under ``depth`` from its seed.

    ``edges``: start, stop, kind, ord. ``seeds``: seed. Every node is expanded once per seed. A level
    is stored once, by seed and node, and never written again; the next one leaves out what each of
    the stored levels has.
    """
    levels = [materialise(seeds.select("seed", F.col("seed").alias("node")).distinct())]
    hops = edges.select(F.col("start").alias("node"), "stop")
    while len(levels) < depth:
        fresh = hops.join(broadcast_if_small(levels[-1]), "node").select("seed", F.col("stop").alias("node")).distinct()
        for known in levels:
            fresh = fresh.join(known, ["seed", "node"], "left_anti")
        fresh = materialise(fresh)
        if fresh.isEmpty():
            break
        levels.append(fresh)
    reached = levels[0].withColumn("dist", F.lit(0))
    for dist, level in enumerate(levels[1:], 1):
        reached = reached.unionByName(level.withColumn("dist", F.lit(dist)))
    return edges.withColumnRenamed("start", "node").join(broadcast_if_small(reached), "node").select(
        "seed", "dist", "node", "stop", "kind", "ord"
    )


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, directions=("upstream", "downstream")) -> DataFrame:
    """Rows ``seed, direction, dist, from, to, kind, ord`` for every seed in column ``seed``.

    Upstream rows run against the edge: ``from`` is the edge's target, ``to`` its source. Back edges
    to nodes already seen are part of the result.
    """
    parts = []
    for direction in directions:
        ends = ("target", "source") if direction == "upstream" else ("source", "target")
        turned = edges.select(F.col(ends[0]).alias("start"), F.col(ends[1]).alias("stop"), "kind", "ord")
        rows = _walk(turned, seeds, depth)
        parts.append(
            rows.select(
                "seed", F.lit(direction).alias("direction"), "dist",
                F.col("node").alias("from"), F.col("stop").alias("to"), "kind", "ord",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shortest_path(edges: DataFrame, start: str, end: str) -> list[str] | None:
    """Node ids of the path a first-in first-out search finds, or None.

    Among parents on the same level the one reached first wins, then the earlier edge. The reach
    order comes from a range-partitioned sort with increasing ids, so no level runs in one task.
    """
    if start == end:
        return [start]
    spark = edges.sparkSession
    hops = edges.groupBy("source", "target").agg(F.min("ord").alias("ord"))
    hops = materialise(hops)
    frontier = spark.createDataFrame([(start, 0)], "node string, rank long")
    reached = frontier.select("node")
    levels: list[DataFrame] = []
    width = 1
    while True:
        side = F.broadcast(frontier) if width <= SMALL_ROWS else frontier
        steps = hops.join(side, hops["source"] == frontier["node"]).select(
            F.col("target").alias("node"), "rank", "ord", F.col("source").alias("parent")
        )
        best = steps.groupBy("node").agg(F.min(F.struct("rank", "ord", "parent")).alias("via"))
        fresh = best.join(reached, "node", "left_anti").select("node", "via.rank", "via.ord", "via.parent")
        ranked = fresh.orderBy("rank", "ord").select(
            "node", "parent", F.monotonically_increasing_id().alias("rank")
        )
        level = materialise(ranked)
        seen = level.agg(F.count("*").alias("n"), F.bool_or(F.col("node") == end).alias("hit")).first()
        if not seen.n:
            return None
        levels.append(level)
        width = seen.n
        if seen.hit:
            break
        frontier = level.select("node", "rank")
        reached = materialise(reached.unionByName(level.select("node")))
    path = [end]
    for level in reversed(levels):
        path.append(level.filter(F.col("node") == path[-1]).select("parent").first()[0])
    return path[::-1]


def shortest_path_frame(edges: DataFrame, start: str, end: str) -> DataFrame:
    """The path as rows ``pos, node``; no rows when there is none."""
    path = shortest_path(edges, start, end) or []
    return edges.sparkSession.createDataFrame(list(enumerate(path)), "pos int, node string")


def capped_neighbours(edges: DataFrame, nodes: DataFrame, centres: DataFrame, cap: int = 20) -> DataFrame:
    """First ``cap`` edges per direction around each centre, with the attributes of the other end.

    ``centres``: id. Unknown ends keep their id as label and get blank kind and path. The cut comes
    before the attribute join; Spark prunes each map task to ``cap`` rows per centre first.
    """
    both = []
    for direction, here, there in (("incoming", "target", "source"), ("outgoing", "source", "target")):
        both.append(
            edges.select(
                F.col(here).alias("id"), F.lit(direction).alias("direction"), F.col(there).alias("other_id"),
                F.col("kind").alias("edge_kind"), F.coalesce(F.col("metadata")["command"], F.lit("")).alias("command"),
                "ord",
            )
        )
    around = both[0].unionByName(both[1]).join(centres.select("id"), "id", "left_semi")
    order = Window.partitionBy("id", "direction").orderBy("ord")
    kept = around.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= cap)
    other = nodes.select(
        F.col("id").alias("other_id"), F.col("label").alias("_label"), F.col("kind").alias("_kind"),
        F.col("path").alias("_path"),
    )
    return kept.join(other, "other_id", "left").select(
        "id", "direction", "pos", "edge_kind", "other_id",
        F.coalesce("_label", "other_id").alias("other_label"),
        F.coalesce("_kind", F.lit("")).alias("other_kind"),
        F.coalesce("_path", F.lit("")).alias("other_path"), "command",
    )
