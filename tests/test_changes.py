"""The change feed: states, time-outs, the flag table, and the engine that asks it."""

import time

import pytest
from pyspark.sql import functions as F

from wayweft.engine import Engine
from wayweft.sinks.versions import Versions
from wayweft.streaming import changes

FEED = "root string, ts timestamp, event string, path string"


class Feed:
    """A folder of JSON events with a watcher that works off what is there."""

    def __init__(self, spark, place):
        self.spark, self.place = spark, place
        self.table = changes.FlagTable(spark, f"{place}/flags")

    def add(self, *rows):
        shaped = self.spark.createDataFrame([(r, at, e, p) for r, at, e, p in rows], "root string, at string, event string, path string")
        shaped.select("root", F.to_timestamp("at").alias("ts"), "event", "path").coalesce(1).write.mode("append").json(f"{self.place}/feed")
        self.run()

    def run(self, **options):
        stream = self.spark.readStream.schema(FEED).json(f"{self.place}/feed")
        query = changes.watch(stream, f"{self.place}/flags", f"{self.place}/state", once=True, **options)
        query.awaitTermination(120)

    def dirty(self):
        return {r.root: r.dirty for r in self.table.read().select("root", changes.is_dirty().alias("dirty")).collect()}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_flags_over_batches(feed, spark):
    day = "2026-01-01 00:0"
    feed.add(("a", f"{day}0:00", "changed", "src/x.py"), ("b", f"{day}0:00", "changed", "node_modules/x.js"), ("c", f"{day}0:00", "built", None))
    assert feed.dirty() == {"a": True, "c": False}
    feed.add(("b", f"{day}1:00", "changed", ".github/w.yml"), ("a", f"{day}1:00", "built", None), ("c", f"{day}1:00", "changed", "../out.py"))
    assert feed.dirty() == {"a": False, "b": True, "c": False}
    feed.add(("a", f"{day}0:30", "changed", "src/late.py"))  # before the build
    assert feed.dirty()["a"] is False
    feed.add(("a", f"{day}2:00", "failed", None))
    assert feed.dirty()["a"] is True
    feed.add(("a", f"{day}3:00", "built", None))
    assert feed.dirty()["a"] is True  # what is not watched can't be called clean
    feed.add(("a", f"{day}4:00", "recovered", None))
    assert feed.dirty() == {"a": False, "b": True, "c": False}
    before = feed.table.versions.current()
    feed.table.add(feed.table.read().limit(0), before.state["batch"])  # a batch that comes again
    assert feed.table.versions.current() == before
    for i in range(changes.FAN):
        feed.add((f"n{i}", f"{day}5:00", "changed", "x.py"))
    assert len(feed.table.versions.current().state["parts"]) < changes.FAN
    assert feed.dirty() == {"a": False, "b": True, "c": False} | {f"n{i}": True for i in range(changes.FAN)}


def test_clean_roots_leave_the_state(feed, spark):
    feed.add(("clean", "2026-01-01 00:00:00", "built", None), ("dirty", "2026-01-01 00:00:00", "changed", "x.py"))
    feed.add(("other", "2026-01-02 00:00:00", "changed", "x.py"))
    feed.add(("other", "2026-01-02 00:00:01", "changed", "y.py"))
    state = spark.read.format("statestore").load(f"{feed.place}/state")
    left = {r.key[0] for r in state.select("key").collect()}
    assert left == {"dirty", "other"} and feed.dirty() == {"clean": False, "dirty": True, "other": True}


def test_engine_asks_the_flags(feed, spark, tmp_path, monkeypatch):
    import wayweft.engine as module

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.sh").write_text("make first\n")
    seen = []
    listed = module.list_files
    monkeypatch.setattr(module, "list_files", lambda *a: seen.append(a) or listed(*a))
    engine = Engine(spark, watched=changes.Watched(spark, f"{feed.place}/flags"))
    first = engine.snapshot(str(root))
    assert engine.snapshot(str(root)) is first and len(seen) == 1
    (root / "a.sh").write_text("make second\n")
    assert engine.snapshot(str(root)) is first and len(seen) == 1  # nobody said so yet
    feed.add((str(root), time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(time.time() + 1)), "changed", "a.sh"))
    assert {r.target for r in engine.snapshot(str(root)).edges.collect()} == {"target:second"} and len(seen) == 2
    # A watcher that ended says nothing, so the tree is listed.
    stream = spark.readStream.schema(FEED).json(f"{feed.place}/feed")
    ended = changes.watch(stream, f"{tmp_path}/f2", f"{tmp_path}/s2", once=True)
    ended.awaitTermination(120)
    engine.watched = changes.Watched(spark, f"{tmp_path}/f2", ended)
    engine.snapshot(str(root))
    assert len(seen) == 3


def test_a_batch_of_an_older_version_conflicts(spark, tmp_path):
    one = Versions(spark, str(tmp_path / "f"))
    one.commit({"batch": 3, "parts": []}, 0)
    table = changes.FlagTable(spark, str(tmp_path / "f"))
    assert table.read().count() == 0
    row = spark.createDataFrame([("a", None, None, True)], changes.FLAGS)
    table.add(row, 3)
    assert table.read().count() == 0
    table.add(row, 4)
    assert [r.root for r in table.read().where(changes.is_dirty()).collect()] == ["a"]


def test_a_feed_in_any_order_loses_no_event(spark, tmp_path, monkeypatch):
    """Old events that come in the last batch count; with a short ``late`` they would be left out."""
    import datetime
    import random

    from wayweft.plans import catalog_diff

    rnd, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [
        (i, start + datetime.timedelta(minutes=rnd.randrange(40_000)), i % 40, rnd.choice(["view", "purchase", "error", "click"]))
        for i in range(160)
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for _, ts, user, kind in rows:
        if kind != "error":
            changed, built = want.get(str(user), (None, None))
            newer = lambda old: ts if old is None else max(old, ts)
            want[str(user)] = (changed, newer(built)) if kind == "purchase" else (newer(changed), built)

    def got():
        return {r.root: (r.changed_at, r.built_at) for r in catalog_diff.dirty_consume_stream(spark, str(tmp_path)).collect()}

    assert got() == want
    monkeypatch.setattr(catalog_diff, "ANY_ORDER", "10 minutes")
    assert got() != want
