"""Change feed of watched roots: which snapshots are out of date.

A feed has rows ``root, ts, event, path``: a file that changed, a snapshot that was built, a watcher
that failed or works again. A batch reading answers from a table of them. The streaming reading keeps
one state a root, the last change, the last build and whether watching failed, and puts every touched
root into a flag table, which any session reads. Nothing of it is held by a driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayweft.sinks.versions import Versions
from wayweft.sources.scan import is_pruned

CHANGED, BUILT, FAILED, RECOVERED = "changed", "built", "failed", "recovered"
FLAGS = "root string, changed_at timestamp, built_at timestamp, failed boolean"
#: Parts of a flag table that are put together into one.
FAN = 8


def relevant(feed: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Changes of files a scan would see; a path outside the root counts as ignored."""
    outside = F.col("path").startswith("/") | F.col("path").startswith("../")
    return feed.filter(~outside & ~is_pruned(F.col("path"), include_hidden))


def latest_change(feed: DataFrame, include_hidden: bool = False) -> DataFrame:
    return relevant(feed, include_hidden).groupBy("root").agg(F.max("ts").alias("changed_at"))


def dirty_roots(feed: DataFrame, built: DataFrame, include_hidden: bool = False) -> DataFrame:
    """``root, dirty`` for every built root: whether a relevant change came after its build."""
    late = built.join(latest_change(feed, include_hidden), "root", "left")
    return late.select("root", F.coalesce(F.col("changed_at") > F.col("built_at"), F.lit(False)).alias("dirty"))


def is_dirty() -> "F.Column":
    """Whether a root of a flag table needs a build: it changed after the last one, or its watcher failed."""
    after = F.col("changed_at") > F.coalesce("built_at", F.lit("1970-01-01").cast("timestamp"))
    return F.col("failed") | F.coalesce(after, F.lit(False))


def _latest(old: pd.Timestamp | None, events: np.ndarray, times: np.ndarray, event: str) -> pd.Timestamp | None:
    mine = times[(events == event) & ~np.isnat(times)]
    if not len(mine):
        return old
    found = pd.Timestamp(mine.max())
    return found if old is None else max(old, found)


def _fold(idle_ms: int):
    """One root's new events into its state; the root's flags come out once a batch."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        changed, built, failed, since = state.get if state.exists else (None, None, None, None)
        for rows in parts:
            events, times = rows["event"].to_numpy(), rows["ts"].to_numpy()
            changed, built = _latest(changed, events, times, CHANGED), _latest(built, events, times, BUILT)
            failed, since = _latest(failed, events, times, FAILED), _latest(since, events, times, RECOVERED)
        state.update((changed, built, failed, since))
        broken = failed is not None and (since is None or since < failed)
        times = [t for t in (changed, built, failed, since) if t is not None]
        if not broken and not (changed is not None and (built is None or changed > built)):
            # A clean root says nothing that a root without state doesn't.
            state.setTimeoutTimestamp(max(int(max(times).timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        # Typed from the start, as a cast costs more than all else for a root.
        stamp = lambda t: np.array([t], "datetime64[us]")
        yield pd.DataFrame({"root": [key[0]], "changed_at": stamp(changed), "built_at": stamp(built), "failed": [broken]})

    return fold


def flags(feed: DataFrame, include_hidden: bool = False, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``root, changed_at, built_at, failed`` of a stream of events, a row for every root that a batch touches.

    An event that comes ``late`` behind the newest one of the batches before is left out, so a feed whose
    events come in any order needs a ``late`` as long as itself. The state of a clean root goes after ``idle_ms`` of event time without an event; that of a dirty
    or failed one stays until it is built or recovers.
    """
    seen = relevant(feed.filter(F.col("event") == CHANGED), include_hidden).unionByName(feed.filter(F.col("event") != CHANGED))
    times = "changed timestamp, built timestamp, failed timestamp, since timestamp"
    keyed = seen.select("root", "ts", "event").withWatermark("ts", late).groupBy("root")
    return keyed.applyInPandasWithState(_fold(idle_ms), FLAGS, times, "update", GroupStateTimeout.EventTimeTimeout)


class FlagTable:
    """The flags of all roots, as parts that batches add under versions; a batch that comes twice counts once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        now = self.versions.current()
        if batch_id <= now.state.get("batch", -1):
            return
        parts = now.state.get("parts", [])
        place = self.versions.new_place("flags")
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.parquet(place)
        parts = [*parts, place.rpartition("/")[2]]
        if len(parts) > FAN:
            place = self.versions.new_place("flags")
            self._newest(parts).write.parquet(place)
            parts = [place.rpartition("/")[2]]
        self.versions.commit({"batch": batch_id, "parts": parts}, now.number)

    def _newest(self, parts: list[str]) -> DataFrame:
        schema = f"{FLAGS}, batch long"
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.versions.folder}/{p}" for p in parts])
        rest = F.struct("batch", "changed_at", "built_at", "failed")
        return rows.groupBy("root").agg(F.max(rest).alias("r")).select("root", "r.changed_at", "r.built_at", "r.failed", "r.batch")

    def read(self) -> DataFrame:
        """``root, changed_at, built_at, failed, batch``: the newest flags of each root."""
        return self._newest(self.versions.current().state.get("parts", []))


def watch(
    feed: DataFrame, folder: str, checkpoint: str, include_hidden: bool = False, late: str = "10 minutes", idle_ms: int = 3_600_000, once: bool = False
) -> StreamingQuery:
    """Keep the flag table in ``folder`` up to date with a stream of events."""
    table = FlagTable(feed.sparkSession, folder)
    writer = flags(feed, include_hidden, late, idle_ms).writeStream.outputMode("update").foreachBatch(table.add)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Watched:
    """What a reader of a flag table knows of one root; with the running stream, its failure counts as a change."""

    def __init__(self, spark: SparkSession, folder: str, query: StreamingQuery | None = None):
        self.table, self.query = FlagTable(spark, folder), query

    def changed_since(self, root: str, at: float) -> bool:
        """Whether ``root`` changed after ``at`` (seconds since 1970), or nobody can say so."""
        if self.query is not None and (not self.query.isActive or self.query.exception() is not None):
            return True
        row = self.table.read().where(F.col("root") == root).select("failed", F.col("changed_at").cast("double").alias("t")).first()
        return row is not None and (row.failed or (row.t is not None and row.t >= at))
