"""Run registered queries against DuckDB on the same tables and compare whole results.

    python -m tests.oracle [scale] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(df, con, sql) -> str:
    """Empty when equal, else what differs."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_names, want = rel.columns, rel.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = dict(zip(want_names, [str(x) for x in rel.types]))
    for name, kind in df.dtypes:
        if kinds.get(kind, types[name]) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    a, b = normal(got, got_names), normal(want, want_names)
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"rows {len(a)} != {len(b)} or values differ; extra {extra}; missing {missing}"
    return "" if a else "EMPTY"


def main(argv):
    from wayweft.plans.catalog import all_queries
    from wayweft.session import local_session

    scale, wanted = (argv + ["0.01"])[0], argv[1:]
    folder = f"/root/testdata/sf{scale}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, (run, sql) in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            verdict = compare(df, con, sql) if sql else f"rows {df.count()} (no SQL)"
        except Exception as exc:
            verdict = f"ERROR {type(exc).__name__} {str(exc)[:600]}"
        bad += bool(verdict) and "no SQL" not in verdict
        print(f"{name:34s} {time.time() - began:6.2f}s {verdict or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
