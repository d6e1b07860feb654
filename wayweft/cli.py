"""Command line: ``python -m wayweft export PATH [--output FILE] [--include-hidden]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from wayweft.plans.snapshot import Snapshot
from wayweft.session import local_session
from wayweft.sinks.store import export_json, export_rows
from wayweft.sources.tree import files_from_tree


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wayweft", description="Dependency graphs of source trees on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    export = commands.add_parser("export", help="write the graph of a tree as JSON")
    export.add_argument("path")
    export.add_argument("--output", help="file to write; standard output without it")
    export.add_argument("--rows", help="folder for JSON lines written by the tasks, for large graphs")
    export.add_argument("--include-hidden", action="store_true")
    export.add_argument("--max-files", type=int, help="take only so many files, in path order")
    export.add_argument("--max-bytes", type=int, help="leave larger files unread, with a warning")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session("*")
    files = files_from_tree(spark, args.path, args.include_hidden, args.max_files, args.max_bytes)
    snapshot = Snapshot.of_files(files, args.max_files, args.max_bytes)
    if args.rows:
        export_rows(snapshot, args.rows)
    elif args.output:
        with open(args.output, "w", encoding="utf-8") as handle:
            export_json(snapshot, handle)
    else:
        export_json(snapshot, sys.stdout)
    return 0
