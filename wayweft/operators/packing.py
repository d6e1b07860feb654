"""Greedy in-order packing of items into batches under a size budget.

An item opens a new batch when it no longer fits the current one, so where a batch starts depends on
all items before it. The items are spread over ranges of (group, order). What a range does to a batch
that comes in depends on where its first new batch starts; the summary of a range gives, for each item
that can be that start, how many batches follow and how full the last one is. Only groups that cross
a range bound need a chain over their summaries, and a range has at most two of those. Then each range
numbers its batches on its own. No group has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from wayweft.session import materialise, shuffle_width


def pack_batches(df: DataFrame, size: str, order: str, group: str, budget: int, ranges: int | None = None) -> DataFrame:
    """``group, order, size, batch`` with batches counted from 1; sizes are capped at the budget.

    ``group`` and ``order`` must identify a row. A null group is a group, a null size a full batch.
    """
    items = df.select(group, order, F.least(F.col(size), F.lit(budget)).cast("long").alias("size"))
    spread = items.repartitionByRange(ranges or shuffle_width(df.sparkSession), group, order)
    placed = materialise(spread.withColumn("_range", F.spark_partition_id()).sortWithinPartitions(group, order))
    bounds = placed.groupBy(group).agg(F.min("_range").alias("_from"), F.max("_range").alias("_to")).where("_from < _to")
    crossing = F.broadcast(bounds.select(F.col(group).alias("_g")))  # two rows a range at most
    cut = placed.join(crossing, F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    entered = materialise(_entries(_summaries(cut, order, group, budget), group, budget))
    carried = entered.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_used", "_batch")
    own = placed.join(F.broadcast(carried), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    own = own.select(group, order, "size", F.coalesce("_used", F.lit(0)).alias("_used"), F.coalesce("_batch", F.lit(0)).alias("_batch"))
    return _numbered(own.sortWithinPartitions(group, order), order, group, budget)


def batch_texts(chunks: DataFrame, packed: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """``group, batch, body, bytes, mode``: the text of every batch, which the budget bounds.

    ``chunks``: group, order, chunk, truncated. A chunk over the budget is cut. The mode of a group is
    ``batched`` for several batches, ``trunc`` when a chunk was cut short, else ``full``.
    """
    cut = F.when(
        F.length("chunk") > budget, F.concat(F.left("chunk", F.lit(budget)), F.lit("\n... [truncated]\n```\n"))
    ).otherwise(F.col("chunk"))
    placed = chunks.join(packed.select(group, order, "batch"), [group, order])
    parts = F.sort_array(F.collect_list(F.struct(order, cut.alias("text"))))
    texts = placed.groupBy(group, "batch").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("body"))
    modes = placed.groupBy(group).agg(
        F.when(F.max("batch") > 1, "batched").when(F.bool_or("truncated"), "trunc").otherwise("full").alias("mode")
    )
    return texts.join(modes, group).select(group, "batch", "body", F.octet_length("body").alias("bytes"), "mode")


def _groups(frames: Iterator[pd.DataFrame], group: str) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by group, in one frame for each group of the task."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        key = frame[group]
        before = key.shift()
        changed = (key.ne(before) & ~(key.isna() & before.isna())).to_numpy()
        if len(frame) and held:
            old, new = held[-1][group].iloc[-1], key.iloc[0]
            changed[0] = not (old == new or (pd.isna(old) and pd.isna(new)))
        edges = [0, *(i for i in np.flatnonzero(changed) if i), len(frame)]
        for first, end in zip(edges, edges[1:]):
            if end > first:
                if changed[first] and held:
                    yield pd.concat(held, ignore_index=True)
                    held = []
                held.append(frame.iloc[first:end])
    if held:
        yield pd.concat(held, ignore_index=True)


def _follow(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals up to each item, the start that follows if a batch starts at it; the length: none does)."""
    totals = np.cumsum(sizes)
    return totals, np.searchsorted(totals, totals - sizes + budget, side="right")


def _summaries(placed: DataFrame, order: str, group: str, budget: int) -> DataFrame:
    """A row for each range of a group: its total, and for each item that can be its first start its
    total, the further starts and the fill of the last batch."""

    def run(frames):
        for frame in _groups(frames, group):
            sizes = frame["size"].to_numpy(np.int64)
            totals, follow = _follow(sizes, budget)
            places = np.arange(len(sizes))
            last, starts = np.where(follow < len(sizes), follow, places), (follow < len(sizes)).astype(np.int64)
            while (last[last] != last).any():
                starts, last = starts + starts[last], last[last]
            first = totals - sizes <= budget
            fill = totals[-1] - (totals - sizes)[last]
            yield pd.DataFrame(
                {
                    "_range": [frame["_range"].iloc[0]], group: [frame[group].iloc[0]], "_all": [totals[-1]],
                    "_totals": [totals[first]], "_starts": [starts[first]], "_fills": [fill[first]],
                }
            )

    lists = [StructField(name, ArrayType(LongType())) for name in ("_totals", "_starts", "_fills")]
    schema = StructType([placed.schema["_range"], placed.schema[group], StructField("_all", LongType()), *lists])
    return placed.sortWithinPartitions(group, order).mapInPandas(run, schema)


def _entries(summaries: DataFrame, group: str, budget: int) -> DataFrame:
    """``_range, group, _used, _batch``: the fill and the number of the batch that is open when a group enters a range."""

    def chain(frame):
        frame = frame.sort_values("_range")
        used, batch, rows = 0, 0, []
        for r in frame.itertuples(index=False, name=None):
            at, key, total, totals, starts, fills = r
            rows.append((at, key, used, batch))
            first = int(np.searchsorted(totals, budget - used, side="right")) if batch else 0
            if first < len(totals):
                used, batch = int(fills[first]), batch + 1 + int(starts[first])
            else:
                used += total
        return pd.DataFrame(rows, columns=["_range", group, "_used", "_batch"])

    fields = [summaries.schema["_range"], summaries.schema[group], StructField("_used", LongType()), StructField("_batch", LongType())]
    return summaries.groupBy(group).applyInPandas(chain, StructType(fields))


def _numbered(placed: DataFrame, order: str, group: str, budget: int) -> DataFrame:
    def run(frames):
        for frame in _groups(frames, group):
            sizes = frame["size"].to_numpy(np.int64)
            totals, follow = _follow(sizes, budget)
            used, batch = int(frame["_used"].iloc[0]), int(frame["_batch"].iloc[0])
            opens = np.zeros(len(sizes), np.int64)
            at = int(np.searchsorted(totals, budget - used, side="right")) if batch else 0
            while at < len(sizes):
                opens[at] = 1
                at = int(follow[at])
            yield frame[[group, order, "size"]].assign(batch=batch + np.cumsum(opens))

    schema = StructType([placed.schema[group], placed.schema[order], StructField("size", LongType()), StructField("batch", LongType())])
    return placed.mapInPandas(run, schema)
