"""Registered graph queries over the supply tables, each with the same query in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayweft.model import node_id
from wayweft.operators import dedup, reports, trace, traverse
from wayweft.session import materialise
from wayweft.sources import tables as t

MADE_SQL = "CASE l_partkey % 10 WHEN 0 THEN false WHEN 1 THEN true ELSE coalesce(l_returnflag = 'N', false) END"

NODES_SQL = """
nodes AS (
  SELECT concat('workflow:', r_regionkey) AS id, 'workflow' AS kind, r_name AS label, CAST(NULL AS VARCHAR) AS path, 1 AS rank, CAST(r_regionkey AS BIGINT) AS key FROM region
  UNION ALL SELECT concat('workflow_job:', n_nationkey), 'workflow_job', n_name, concat('regions/', n_regionkey), 2, n_nationkey FROM nation
  UNION ALL SELECT concat('script:', c_custkey), 'script', c_name, concat('nations/', c_nationkey, '/', c_mktsegment), 3, c_custkey FROM customer
  UNION ALL SELECT concat('target:', s_suppkey), 'target', s_name, concat('nations/', s_nationkey), 4, s_suppkey FROM supplier
  UNION ALL SELECT concat('file:', o_orderkey), 'file', o_orderpriority, CAST(o_orderkey AS VARCHAR), 5, o_orderkey FROM orders
  UNION ALL SELECT concat('artifact:', p_partkey), 'artifact', p_name, NULL, 6, p_partkey FROM part
)"""

EDGES_SQL = f"""
edges AS (
  SELECT concat('workflow:', n_regionkey) AS source, concat('workflow_job:', n_nationkey) AS target, 'defines' AS kind, '' AS command, 1 AS phase, CAST(n_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM nation
  UNION ALL SELECT concat('script:', c_custkey), concat('workflow_job:', c_nationkey), 'depends_on', '', 2, c_custkey, c_nationkey FROM customer
  UNION ALL SELECT concat('target:', s_suppkey), concat('workflow_job:', s_nationkey), 'depends_on', '', 3, s_suppkey, s_nationkey FROM supplier
  UNION ALL SELECT concat('file:', o_orderkey), concat('script:', o_custkey), 'invokes', concat('run ', o_orderpriority), 4, o_orderkey, o_custkey FROM orders
  UNION ALL SELECT concat('file:', o_orderkey), concat('file:', o_orderkey + 7), 'depends_on', '', 5, o_orderkey, o_orderkey + 7 FROM orders
  UNION ALL SELECT concat('file:', o_orderkey), concat('file:', o_orderkey + 11), 'imports', '', 8, o_orderkey, o_orderkey + 11 FROM orders
  UNION ALL SELECT DISTINCT concat('target:', l_suppkey), concat('artifact:', l_partkey), 'produces', '', 6, l_suppkey, l_partkey FROM lineitem WHERE {MADE_SQL}
  UNION ALL SELECT DISTINCT concat('file:', l_orderkey), concat('artifact:', l_partkey), 'consumes', '', 7, l_orderkey, l_partkey FROM lineitem WHERE NOT {MADE_SQL}
)"""


def both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return t.supply_nodes(spark, folder), t.supply_edges(spark, folder)


def node_id_build(spark, folder):
    return t.table(spark, folder, "part").select(
        "p_partkey", node_id("module", "p_name", F.when(F.col("p_size") > 25, F.lit("  ")).otherwise(F.col("p_type")), "p_brand").alias("id")
    )


NODE_ID_SQL = """
SELECT p_partkey, concat_ws(':', 'module', replace(trim(p_name), ' ', '_'),
  CASE WHEN p_size > 25 THEN NULL ELSE replace(trim(p_type), ' ', '_') END, replace(trim(p_brand), ' ', '_')) AS id FROM part"""


def nodes_dedup(spark, folder):
    """Events as repeated declarations of one node per user and event type; the earliest decides."""
    events = t.table(spark, folder, "events")
    nodes = events.select(
        node_id("module", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("props").alias("label"),
        "value", F.struct("ts", "event_id").alias("ord"),
    )
    return dedup.dedup_nodes(nodes).select("id", "label", "value")


NODES_DEDUP_SQL = """
SELECT concat('module:', user_id, ':', event_type) AS id, props AS label, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"""

LINE_ORDER = [
    "l_shipdate", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus",
]


def edges_dedup(spark, folder):
    lines = t.table(spark, folder, "lineitem")
    edges = lines.select(
        node_id("file", F.col("l_orderkey").cast("string")).alias("source"),
        node_id("artifact", F.col("l_partkey").cast("string")).alias("target"),
        F.when(F.col("l_returnflag") == "N", "produces").otherwise("consumes").alias("kind"),
        F.concat_ws("|", F.col("l_linenumber").cast("string"), "l_linestatus", F.col("l_suppkey").cast("string")).alias("command"),
        F.struct(*LINE_ORDER).alias("ord"),
    )
    return dedup.dedup_edges(edges).select("source", "target", "kind", "command")


EDGES_DEDUP_SQL = f"""
SELECT concat('file:', l_orderkey) AS source, concat('artifact:', l_partkey) AS target,
  CASE WHEN l_returnflag = 'N' THEN 'produces' ELSE 'consumes' END AS kind,
  concat(l_linenumber, '|', l_linestatus, '|', l_suppkey) AS command FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END
  ORDER BY {', '.join(LINE_ORDER)}) = 1"""


def overview_kind_counts(spark, folder):
    return reports.kind_counts(t.supply_nodes(spark, folder))


def overview_edge_kinds(spark, folder):
    return reports.kind_counts(t.supply_edges(spark, folder))


def overview_totals(spark, folder):
    return reports.totals(*both(spark, folder))


def overview_top_files(spark, folder):
    return reports.top_files(t.supply_edges(spark, folder), 25)


TOP_FILES_SQL = f"""WITH {EDGES_SQL}, c AS (
  SELECT substring(source, 6) AS path, count(*) AS edge_count, min((phase, a, b)) AS seen FROM edges WHERE source LIKE 'file:%' GROUP BY source)
SELECT path, edge_count FROM c ORDER BY edge_count DESC, seen LIMIT 25"""


def entrypoints_top(spark, folder):
    return reports.entrypoints(t.supply_nodes(spark, folder), 50).select("category", "pos", "id", "label", "path")


ENTRYPOINTS_SQL = f"""WITH {NODES_SQL}, c AS (
  SELECT CASE kind WHEN 'script' THEN 'scripts' WHEN 'target' THEN 'targets' ELSE 'workflows' END AS category, id, label,
    coalesce(path, '') AS path, rank, key FROM nodes WHERE kind IN ('script', 'target', 'workflow', 'workflow_job'))
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY path, label, rank, key) AS INTEGER) AS pos, id, label, path
FROM c QUALIFY pos <= 50"""


def artifact_lineage_rows(spark, folder):
    return reports.lineage(*both(spark, folder))


LINEAGE_SQL = f"""WITH {NODES_SQL}, {EDGES_SQL}
SELECT n.label AS artifact, n.id AS artifact_id, CASE WHEN e.kind = 'produces' THEN 'producer' ELSE 'consumer' END AS role, e.source
FROM nodes n JOIN edges e ON e.target = n.id WHERE n.kind = 'artifact' AND e.kind IN ('produces', 'consumes')"""


def artifact_lineage_label(spark, folder):
    nodes, edges = both(spark, folder)
    return reports.lineage(nodes, edges, "small ring")


LINEAGE_LABEL_SQL = f"""WITH {NODES_SQL}, {EDGES_SQL}, one AS (
  SELECT id, label FROM nodes WHERE kind = 'artifact' AND label = 'small ring' ORDER BY rank, key LIMIT 1)
SELECT DISTINCT label AS artifact, id AS artifact_id, CASE WHEN kind = 'produces' THEN 'producer' ELSE 'consumer' END AS role, source
FROM one JOIN edges ON target = id WHERE kind IN ('produces', 'consumes')"""


def contracts_missing_producer(spark, folder):
    return reports.missing_producer(t.artifact_edges_raw(spark, folder))


def contracts_missing_consumer(spark, folder):
    return reports.missing_consumer(t.artifact_edges_raw(spark, folder))


def _gap_sql(has: str, lacks: str) -> str:
    return f"""WITH {EDGES_SQL}
SELECT DISTINCT target AS artifact_id FROM edges WHERE kind = '{has}'
  AND target NOT IN (SELECT target FROM edges WHERE kind = '{lacks}')"""


def _seeds(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind).select(F.col("id").alias("seed"))


def _spread(spark, folder, kind, depth, directions):
    nodes, edges = both(spark, folder)
    edges = materialise(edges.select("source", "target", "kind", "ord"))
    out = traverse.neighborhood(edges, _seeds(nodes, kind), depth, directions)
    return out.select("seed", "direction", "dist", "from", "to", "kind")


def neighborhood_downstream_d2(spark, folder):
    return _spread(spark, folder, "file", 2, ("downstream",))


def neighborhood_upstream_d2(spark, folder):
    return _spread(spark, folder, "artifact", 2, ("upstream",))


def neighborhood_batch(spark, folder):
    return _spread(spark, folder, "workflow_job", 3, ("upstream", "downstream"))


def _walk_sql(kind: str, depth: int, directions: tuple[str, ...]) -> str:
    parts, heads = [], []
    for d in directions:
        start, stop = ("target", "source") if d == "upstream" else ("source", "target")
        level = f"{d}_0 AS (SELECT id AS seed, id AS node, 0 AS dist FROM nodes WHERE kind = '{kind}')"
        heads.append(level)
        for n in range(1, depth):
            heads.append(
                f"{d}_{n} AS (SELECT * FROM {d}_{n-1} UNION ALL SELECT DISTINCT r.seed, e.{stop}, {n} FROM {d}_{n-1} r JOIN edges e ON e.{start} = r.node "
                f"WHERE r.dist = {n-1} AND NOT EXISTS (SELECT 1 FROM {d}_{n-1} x WHERE x.seed = r.seed AND x.node = e.{stop}))"
            )
        parts.append(
            f"SELECT r.seed, '{d}' AS direction, r.dist, r.node AS \"from\", e.{stop} AS \"to\", e.kind FROM {d}_{depth-1} r JOIN edges e ON e.{start} = r.node"
        )
    return f"WITH {NODES_SQL}, {EDGES_SQL}, " + ", ".join(heads) + " " + " UNION ALL ".join(parts)


def shortest_path_nodes(spark, folder):
    """From the first order to the one 54 keys on; several shortest ways differ in the order of their steps."""
    first = t.table(spark, folder, "orders").agg(F.min("o_orderkey")).first()[0]
    return traverse.shortest_path_frame(t.supply_edges(spark, folder), f"file:{first}", f"file:{first + 54}")


SHORTEST_SQL = f"""WITH RECURSIVE {EDGES_SQL}, ends AS (
  SELECT concat('file:', min(o_orderkey)) AS s, concat('file:', min(o_orderkey) + 54) AS e FROM orders), walk AS (
  SELECT s AS node, [s] AS path, [(0, CAST(0 AS BIGINT), CAST(0 AS BIGINT))] AS ords, 0 AS hops FROM ends
  UNION ALL SELECT x.target, list_append(w.path, x.target), list_append(w.ords, (x.phase, x.a, x.b)), w.hops + 1 FROM walk w JOIN edges x ON x.source = w.node
  WHERE w.hops < 8 AND w.node <> (SELECT e FROM ends) AND NOT list_contains(w.path, x.target)), hit AS (
  SELECT path FROM walk WHERE node = (SELECT e FROM ends) ORDER BY hops, ords LIMIT 1)
SELECT CAST(unnest(range(len(path))) AS INTEGER) AS pos, unnest(path) AS node FROM hit"""


def symbol_files_last_wins(spark, folder):
    """Line items as repeated definitions of a part by an order; the last one keeps the part."""
    edges = t.table(spark, folder, "lineitem").select(
        node_id("file", F.col("l_orderkey").cast("string")).alias("source"),
        node_id("code_symbol", F.col("l_partkey").cast("string")).alias("target"), F.lit("defines").alias("kind"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("ord"),
    )
    return trace.symbol_files(edges).select("id", "file")


SYMBOL_FILES_SQL = """
SELECT concat('code_symbol:', l_partkey) AS id, CAST(l_orderkey AS VARCHAR) AS file FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1"""


def trace_files_to_scripts(spark, folder):
    """Page paths as files and customers' order keys as scripts, matched on suffixes."""
    files = t.page_paths(spark, folder).select(F.concat("path", F.lit(".py")).alias("file")).filter("file <> '.py'").distinct()
    scripts = t.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("script_id"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".py")).alias("label"),
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("jobs/1"), F.col("s_suppkey").cast("string"), F.lit(".py"))).alias("path"),
    )
    return trace.match_files_to_scripts(files, scripts).select("file", "script_id", "label", "path")


TRACE_MATCH_SQL = r"""
WITH files AS (SELECT DISTINCT concat(regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1), '.py') AS file FROM pages),
scripts AS (SELECT s_suppkey AS script_id, concat(s_suppkey, '.py') AS label,
  CASE WHEN s_nationkey % 2 = 0 THEN concat('jobs/1', s_suppkey, '.py') END AS path FROM supplier)
SELECT file, script_id, label, path FROM files, scripts WHERE file <> '.py' AND (label = split_part(file, '/', -1)
  OR suffix(coalesce(path, ''), file) OR suffix(coalesce(path, ''), split_part(file, '/', -1)) OR suffix(file, label))"""


def trace_runner_neighbours(spark, folder):
    nodes, edges = both(spark, folder)
    centres = nodes.filter(F.col("kind").isin("workflow_job", "target", "script")).select("id")
    return traverse.capped_neighbours(edges, nodes, centres, 20)


NEIGHBOURS_SQL = f"""WITH {NODES_SQL}, {EDGES_SQL}, around AS (
  SELECT target AS id, 'incoming' AS direction, source AS other_id, kind AS edge_kind, command, phase, a, b FROM edges
  UNION ALL SELECT source, 'outgoing', target, kind, command, phase, a, b FROM edges), kept AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id, direction ORDER BY phase, a, b) AS INTEGER) AS pos FROM around
  WHERE id IN (SELECT id FROM nodes WHERE kind IN ('workflow_job', 'target', 'script')) QUALIFY pos <= 20)
SELECT k.id, k.direction, k.pos, k.edge_kind, k.other_id, coalesce(n.label, k.other_id) AS other_label,
  coalesce(n.kind, '') AS other_kind, coalesce(n.path, '') AS other_path, k.command FROM kept k LEFT JOIN nodes n ON n.id = k.other_id"""


def trace_batch_capped(spark, folder):
    """Parts as queries answered by the orders that consume them: five per query, sixty over all.

    Only queries inside the total cap matter, so the best sixty rows in query order decide.
    """
    edges = t.supply_edges(spark, folder).filter("kind = 'consumes'")
    w = Window.partitionBy("target").orderBy("ord")
    per_query = edges.withColumn("pos", F.row_number().over(w)).filter("pos <= 5")
    top = per_query.select(F.col("ord.b").alias("query"), "pos", F.col("source").alias("match")).orderBy("query", "pos").limit(60)
    return top


TRACE_BATCH_SQL = f"""
WITH used AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE NOT {MADE_SQL}), ranked AS (
  SELECT l_partkey AS query, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS INTEGER) AS pos,
    concat('file:', l_orderkey) AS match FROM used QUALIFY pos <= 5)
SELECT * FROM ranked ORDER BY query, pos LIMIT 60"""


def invocations_resolved(spark, folder):
    nodes, edges = both(spark, folder)
    return trace.invocations(nodes, edges).select(
        "source_id", "source_label", "script_id", "script_label", "script_path", "command"
    )


INVOCATIONS_SQL = f"""WITH {NODES_SQL}, {EDGES_SQL}
SELECT e.source AS source_id, coalesce(s.label, e.source) AS source_label, e.target AS script_id, n.label AS script_label,
  coalesce(n.path, '') AS script_path, e.command FROM edges e JOIN nodes n ON n.id = e.target LEFT JOIN nodes s ON s.id = e.source
WHERE e.kind = 'invokes' AND e.target LIKE 'script:%'"""


def export_rows(spark, folder):
    """Canonical export order as an explicit position is left to the sink; this is the row content as JSON."""
    edges = t.supply_edges(spark, folder)
    body = F.struct("source", "target", "kind", F.coalesce(F.col("metadata")["command"], F.lit("")).alias("command"))
    return edges.select("kind", "source", "target", F.to_json(body).alias("json"))


EXPORT_SQL = f"""WITH {EDGES_SQL}
SELECT kind, source, target, concat('{{"source":"', source, '","target":"', target, '","kind":"', kind, '","command":"', command, '"}}') AS json FROM edges"""


QUERIES = {
    "node_id_build": (node_id_build, NODE_ID_SQL),
    "nodes_dedup_first_wins": (nodes_dedup, NODES_DEDUP_SQL),
    "edges_dedup_first_wins": (edges_dedup, EDGES_DEDUP_SQL),
    "overview_kind_counts": (overview_kind_counts, f"WITH {NODES_SQL} SELECT kind, count(*) AS count FROM nodes GROUP BY 1"),
    "overview_edge_kinds": (overview_edge_kinds, f"WITH {EDGES_SQL} SELECT kind, count(*) AS count FROM edges GROUP BY 1"),
    "overview_totals": (
        overview_totals,
        f"WITH {NODES_SQL}, {EDGES_SQL} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count",
    ),
    "overview_top_files": (overview_top_files, TOP_FILES_SQL),
    "entrypoints_top_per_category": (entrypoints_top, ENTRYPOINTS_SQL),
    "artifact_lineage": (artifact_lineage_rows, LINEAGE_SQL),
    "artifact_lineage_label": (artifact_lineage_label, LINEAGE_LABEL_SQL),
    "contracts_missing_producer": (contracts_missing_producer, _gap_sql("consumes", "produces")),
    "contracts_missing_consumer": (contracts_missing_consumer, _gap_sql("produces", "consumes")),
    "neighborhood_downstream_d2": (neighborhood_downstream_d2, _walk_sql("file", 2, ("downstream",))),
    "neighborhood_upstream_d2": (neighborhood_upstream_d2, _walk_sql("artifact", 2, ("upstream",))),
    "neighborhood_batch": (neighborhood_batch, _walk_sql("workflow_job", 3, ("upstream", "downstream"))),
    "shortest_path_nodes": (shortest_path_nodes, SHORTEST_SQL),
    "symbol_files_last_wins": (symbol_files_last_wins, SYMBOL_FILES_SQL),
    "trace_theta_join": (trace_files_to_scripts, TRACE_MATCH_SQL),
    "trace_runner_neighbours": (trace_runner_neighbours, NEIGHBOURS_SQL),
    "trace_batch_capped": (trace_batch_capped, TRACE_BATCH_SQL),
    "trace_invocations": (invocations_resolved, INVOCATIONS_SQL),
    "export_edge_rows": (export_rows, EXPORT_SQL),
}
