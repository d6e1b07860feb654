"""Content keys, overlays of changed files, cache eviction under a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.operators.prefix import running_total

RANGE_ROWS = 1000


def content_keys(files: DataFrame, include_hidden: bool = False) -> DataFrame:
    """``root, content_key``: 16 hex digits over the ordered listing of ``root, path, digest``.

    Paths are ordered component by component. The key is made in two levels: a digest for every
    thousand entries, and one over those digests in order. Places come from range totals, so neither
    sorting nor hashing brings a large root to one task.
    """
    keyed = files.select("root", "path", "digest", F.split("path", "/").alias("_parts"), F.lit(1).alias("_one"))
    listed = running_total(keyed, "_one", ["_parts"], ["root"], out="_n")
    entry = F.concat("path", F.decode(F.lit(b"\x00"), "UTF-8"), "digest", F.lit("\n"))
    parts = listed.groupBy("root", F.expr(f"(_n - 1) div {RANGE_ROWS}").alias("_range")).agg(_digest_of(F.struct("_n", entry.alias("e"))).alias("e"))
    head = "v2\nhidden=1\n" if include_hidden else "v2\nhidden=0\n"
    return parts.groupBy("root").agg(F.left(_digest_of(F.struct("_range", F.concat("e", F.lit("\n")).alias("e")), head), F.lit(16)).alias("content_key"))


def _digest_of(placed: Column, head: str = "") -> Column:
    """A digest over the ``e`` of structs, in order."""
    rows = F.sort_array(F.collect_list(placed))
    return F.sha2(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["e"]), "")), 256)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def overlay(base: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Base rows with changed rows put over them; ``removed`` names keys that vanish."""
    gone = changed.select(key) if removed is None else changed.select(key).unionByName(removed.select(key))
    return base.join(gone.distinct(), key, "left_anti").select(*base.columns).unionByName(changed.select(*base.columns))


def evict_over_budget(entries: DataFrame, budget: int, size: str = "size", order: list[str] = ["used_at"]) -> DataFrame:
    """Add ``evicted``: oldest entries go until the rest fits the budget."""
    total = entries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    summed = running_total(entries, size, order, out="_upto")
    return summed.withColumn("evicted", F.lit(total) - (F.col("_upto") - F.col(size)) > budget).drop("_upto")
