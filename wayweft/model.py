"""Graph data model: node and edge kinds, schemas, id construction.

Nodes, edges and warnings are plain DataFrames. ``ord`` is the emission order. It can be any
orderable type; the extractors use ``struct<path string, at array<int>>`` (file, then position
inside the file), so that order needs no global numbering and no global sort.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayweft.functions.strings import strip

# The closed sets of node and edge kinds.
NODE_KINDS = (
    "file", "code_symbol", "module", "script", "target", "workflow", "workflow_job",
    "workflow_step", "artifact", "env_var", "container_image", "service",
)
EDGE_KINDS = (
    "imports", "calls", "defines", "invokes", "depends_on", "produces", "consumes",
    "sets_env", "uses_env", "runs_in", "builds_from",
)
# Kinds that the symbol index holds.
INDEXED_KINDS = (
    "code_symbol", "module", "script", "target", "workflow", "workflow_job", "workflow_step",
)

ORD_TYPE = "struct<path:string,at:array<int>>"
NODE_SCHEMA = (
    "id string, kind string, label string, path string, metadata map<string,string>, ord " + ORD_TYPE
)
EDGE_SCHEMA = (
    "source string, target string, kind string, metadata map<string,string>, ord " + ORD_TYPE
)
WARNING_SCHEMA = "path string, message string, ord " + ORD_TYPE


def node_id(kind: str | Column, *parts: Column | str) -> Column:
    """``kind:part:part`` with blank parts dropped, parts trimmed and spaces turned into ``_``."""
    head = F.lit(kind) if isinstance(kind, str) else kind
    cells = []
    for part in parts:
        text = strip(F.col(part) if isinstance(part, str) else part)
        cells.append(F.when(text != "", F.replace(text, F.lit(" "), F.lit("_"))))
    return F.concat_ws(":", head, *cells)


def order_key(path: Column, *at: Column | int) -> Column:
    """Emission order of a fact: its file, then integers compared from left to right."""
    cells = [F.lit(a) if isinstance(a, int) else a.cast("int") for a in at]
    return F.struct(path.alias("path"), F.array(*cells).alias("at"))
