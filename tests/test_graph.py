"""Graph operators against brute force on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wayweft.operators import dedup, packing, prefix, trace, traverse


def random_edges(seed, nodes=12, count=30):
    rnd = random.Random(seed)
    seen, out = set(), []
    for n in range(count):
        e = (f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}", rnd.choice(["calls", "imports"]))
        if e not in seen:
            seen.add(e)
            out.append((*e, n))
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "source string, target string, kind string, ord int")


def plain_path(edges, start, end):
    queue, parent = deque([start]), {start: None}
    while queue:
        cur = queue.popleft()
        for s, t, _, _ in edges:
            if s == cur and t not in parent:
                parent[t] = cur
                queue.append(t)
    if end not in parent:
        return None
    path = [end]
    while parent[path[-1]] is not None:
        path.append(parent[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_shortest_path(spark, seed):
    edges = random_edges(seed)
    df = frame(spark, edges)
    for end in ("n3", "n7", "missing"):
        assert traverse.shortest_path(df, "n0", end) == plain_path(edges, "n0", end)


def plain_walk(edges, seed, depth, up):
    seen, queue, rows = {seed}, deque([(seed, 0)]), []
    while queue:
        cur, d = queue.popleft()
        if d >= depth:
            continue
        for s, t, k, _ in edges:
            a, b = (t, s) if up else (s, t)
            if a == cur:
                rows.append((seed, "upstream" if up else "downstream", cur, b, k))
                if b not in seen:
                    seen.add(b)
                    queue.append((b, d + 1))
    return rows


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_neighborhood(spark, depth):
    edges = random_edges(depth)
    seeds = ["n0", "n5", "nobody"]
    got = traverse.neighborhood(frame(spark, edges), spark.createDataFrame([(s,) for s in seeds], "seed string"), depth)
    want = [r for s in seeds for up in (True, False) for r in plain_walk(edges, s, depth, up)]
    assert sorted((r.seed, r.direction, r["from"], r["to"], r.kind) for r in got.collect()) == sorted(want)


def test_first_writer_wins(spark):
    rows = [("a", "late", 5), ("a", "first", 1), ("b", None, 2), ("b", "x", 3)]
    out = dedup.first_per_key(spark.createDataFrame(rows, "id string, label string, ord int"), ["id"])
    assert sorted((r.id, r.label) for r in out.collect()) == [("a", "first"), ("b", None)]


def test_file_script_match_equals_all_pairs(spark):
    files = ["src/a/build.py", "build.py", "x/main.py", "deep/x/main.py", "b.sh"]
    scripts = [
        (0, "build.py", None), (1, "./main.py", "t/main.py"), (2, "x/main.py", "q/x/main.py"), (3, "", "rebuild.py"),
        (4, "zz", "a/xb.sh"), (5, "ain.py", ""), (6, "nothing", "k/"),
    ]
    want = set()
    for f in files:
        base = f.split("/")[-1]
        for n, label, path in scripts:
            path = path or ""
            if label == base or path.endswith(f) or path.endswith(base) or f.endswith(label):
                want.add((f, n))
    got = trace.match_files_to_scripts(
        spark.createDataFrame([(f,) for f in files], "file string"),
        spark.createDataFrame(scripts, "script_id int, label string, path string"),
    )
    assert {(r.file, r.script_id) for r in got.collect()} == want


def test_running_total(spark):
    rows = [(g, i, (i * 7) % 5) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r.g, r.i): r.total for r in prefix.running_total(df, "v", ["i"], ["g"], ranges=5).collect()}
    assert got == {(g, i): sum((j * 7) % 5 for j in range(i + 1)) for g in "ab" for i in range(200)}


@pytest.mark.parametrize("ranges", [1, 4, 150])
def test_packing(spark, ranges):
    """One, few and many ranges, a group that holds most rows, empty items, a null group and a null size."""
    rnd = random.Random(1)
    rows = [(g, i, rnd.choice([0, 1, 3, 7, 10, 25, None])) for g, n in (("a", 60), ("b", 900), ("c", 1), (None, 70), ("e", 3)) for i in range(n)]
    rows += [("z", i, 0) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, i int, s int").repartition(7)
    got = {(r.g, r.i): r.batch for r in packing.pack_batches(df, "s", "i", "g", 10, ranges).collect()}
    want, state = {}, {}
    for g, i, s in rows:
        s = 10 if s is None else min(s, 10)
        batch, used = state.get(g, (1, 0))
        batch, used = (batch + 1, s) if used + s > 10 else (batch, used + s)
        state[g] = batch, used
        want[(g, i)] = batch
    assert got == want
    assert packing.pack_batches(df.limit(0), "s", "i", "g", 10, ranges).count() == 0


def test_crowded_keys_are_dealt_and_pairs_come_once(spark, monkeypatch):
    """Names that all scripts end in meet cell by cell; a pair that both tests find comes once."""
    files = [(f"d{i}/.py",) for i in range(30)] + [("a/x.py",), ("x.py",), ("a/",), ("a/x.py",)]
    scripts = [(i, f"x{i}.py" if i % 3 else "x.py", f"jobs/x{i}.py" if i % 2 else None) for i in range(40)] + [(99, "x.py", "b/x.py")] * 2
    want = {
        (f, *s) for (f,) in files for s in scripts
        if (n := f.split("/")[-1]) and (s[2] or "").split("/")[-1].endswith(n) or f.endswith(s[1])
    }
    monkeypatch.setattr(trace, "CELL", 4)
    left = spark.createDataFrame(files, "file string")
    right = spark.createDataFrame(scripts, "script_id int, label string, path string")
    pairs = trace.match_files_to_scripts(left, right)
    got = [(r.file, r.script_id, r.label, r.path) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    crowded = {(r.side, r.key): (r._l, r._r) for r in trace._crowded(trace.file_keys(left.distinct()), trace.script_keys(right.distinct())).collect()}
    assert crowded["path", ".py"] == (8, 6)  # a key's pairs are dealt over 48 cells
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join", 1)[0].count("Aggregate") == 0  # pairs are not compared again


def test_keys_of_many_pairs_are_paired_in_runs(spark, monkeypatch):
    """Files come in runs with one script after another, so columns repeat; no row is copied for the cells (F1)."""
    files = [(f"d{i}/.py",) for i in range(203)] + [("a/x7.py",), ("x7.py",), ("b/.py",), ("d1/.py",), (None,), ("a/",)]
    scripts = [(i, f"x{i}.py", f"jobs/1x{i}.py" if i % 4 else None) for i in range(150)] + [(7, "x7.py", "jobs/1x7.py"), (200, ".py", None), (201, None, None)]
    scripts += [(i, ".py", "z/y.py") for i in range(300, 390)]
    want = {
        (f, *s) for (f,) in files for s in scripts
        if f and ((n := f.split("/")[-1]) and (s[2] or "").split("/")[-1].endswith(n) or s[1] and f.endswith(s[1]))
    }
    monkeypatch.setattr(trace, "CELL", 64)
    monkeypatch.setattr(trace, "RUN", 16, raising=False)
    left = spark.createDataFrame(files, "file string")
    right = spark.createDataFrame(scripts, "script_id int, label string, path string")
    pairs = trace.match_files_to_scripts(left, right)
    got = [tuple(r) for r in pairs.select("file", "script_id", "label", "path").collect()]
    assert len(got) == len(want) > 30_000 and set(got) == want
    assert sum(a[1:] != b[1:] for a, b in zip(got, got[1:], strict=False)) < len(got) / 8  # a script stays for a run of files
    crowded = trace._crowded(trace.file_keys(left.distinct()), trace.script_keys(right.distinct()))
    copied = trace._dealt(trace.file_keys(left.distinct()), crowded, "_l", "_r").groupBy("file", "side", "key").count()
    assert copied.agg({"count": "max"}).first()[0] == 1


def test_part_edges_are_made_distinct_by_their_keys(spark):
    """No text goes through the shuffle that leaves each edge once, and its width grows with the scan (F16)."""
    from wayweft.sources import tables as t

    edges = t.supply_edges(spark, "/root/testdata/sf0.001").filter("kind IN ('produces', 'consumes')")
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "concat" not in plan.split("RepartitionByExpression", 1)[1]
    raw = t.artifact_edges_raw(spark, "/root/testdata/sf0.001")
    columns = ["source", "target", "kind", "ord"]
    assert sorted(edges.select(columns).collect()) == sorted(dedup.dedup_edges(raw).select(columns).collect())


def test_lineage_of_one_artifact_cuts_the_edges_at_their_scan(spark):
    """The label's node is known before the edges are read (F17)."""
    from wayweft.plans.catalog import all_queries
    from wayweft.operators import reports

    folder = "/root/testdata/sf0.01"
    made = all_queries()["artifact_lineage_label"][0](spark, folder)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rsplit("Aggregate", 1)[1].count("= artifact:") == 1 and made.count() > 0
    nodes = spark.createDataFrame([("artifact:b", "artifact", "x", 2), ("artifact:a", "artifact", "x", 1)], "id string, kind string, label string, ord int")
    edges = spark.createDataFrame([("file:f", "artifact:a", "consumes"), ("file:g", "artifact:b", "produces")], "source string, target string, kind string")
    assert [r.source for r in reports.lineage(nodes, edges, "x").collect()] == ["file:f"]
    assert reports.lineage(nodes, edges, "y").count() == 0
