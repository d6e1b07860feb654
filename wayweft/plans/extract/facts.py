"""The row that all extractors emit.

A fact declares a node and, when ``source`` is set, an edge from ``source`` to it. ``at`` orders the
facts of a file; the first number is the extractor's turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("at", "id", "kind", "label", "npath", "line", "source", "ekind", "command")
WARNING = "warning"


def fact(
    at: list | Column, id: Column, kind: str | Column, label: Column, npath: Column | None = None, line: Column | None = None,
    source: Column | None = None, ekind: str | Column | None = None, command: Column | None = None,
) -> Column:
    def text(value):
        if value is None:
            return F.lit(None).cast("string")
        return F.lit(value) if isinstance(value, str) else value.cast("string")

    if isinstance(at, list):
        at = F.array(*[F.lit(a) if isinstance(a, int) else a.cast("int") for a in at])
    return F.struct(
        at.alias("at"), text(id).alias("id"), text(kind).alias("kind"), text(label).alias("label"),
        text(npath).alias("npath"), text(line).alias("line"), text(source).alias("source"), text(ekind).alias("ekind"),
        text(command).alias("command"),
    )


def warning(at: list, message: Column) -> Column:
    return fact(at, F.lit(""), WARNING, message)


def emit(df: DataFrame, facts: Column) -> DataFrame:
    """``path`` and the fields of every fact in an array column."""
    return df.select("path", F.explode_outer(facts).alias("_f")).filter("_f IS NOT NULL").select("path", *[F.col(f"_f.{c}").alias(c) for c in FIELDS])


def one(df: DataFrame, row: Column) -> DataFrame:
    return df.select("path", row.alias("_f")).select("path", *[F.col(f"_f.{c}").alias(c) for c in FIELDS])


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nothing(files: DataFrame) -> DataFrame:
    """No facts at all."""
    return one(files.limit(0), fact([0], F.lit(""), "", F.lit("")))
