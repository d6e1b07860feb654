"""Applying unified diffs to file contents, per row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", re.M)


def _apply(text: str, patch: str) -> str | None:
    """Patched text, None when a hunk does not fit. A hunk is tried at its place, then nearby."""
    lines, shift, out, done = text.split("\n"), 0, [], 0
    marks = list(_HUNK.finditer(patch))
    for mark, stop in zip(marks, [m.start() for m in marks[1:]] + [len(patch)]):
        body = patch[mark.start() : stop].rstrip("\n").split("\n")[1:]
        body = [b for b in body if not b.startswith("\\")]
        old = [b[1:] for b in body if not b.startswith("+")]
        new = [b[1:] for b in body if not b.startswith("-")]
        guess = int(mark[1]) - (1 if old else 0) + shift
        spots = sorted(range(done, len(lines) - len(old) + 1), key=lambda s: abs(s - guess))
        spot = next((s for s in spots if lines[s : s + len(old)] == old), None)
        if spot is None:
            return None
        out += lines[done:spot] + new
        done, shift = spot + len(old), spot - guess + shift
    return "\n".join(out + lines[done:])


@F.pandas_udf(T.StringType())
def apply_patch(texts: pd.Series, patches: pd.Series) -> pd.Series:
    return pd.Series([_apply(t or "", p) for t, p in zip(texts, patches)], dtype=object)


def split_diff(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """``path, old_path, patch, gone`` per file of unified diff texts."""
    parts = F.filter(F.split(text, r"(?m)^(?=diff --git )", -1), lambda p: p.rlike(r"(?m)^(diff --git |--- )"))
    rows = diffs.select(F.explode_outer(parts).alias("_p")).filter("_p IS NOT NULL")

    def name(pattern: str) -> Column:
        found = F.regexp_extract("_p", pattern, 1)
        return F.when(found != "", found)

    new, old = name(r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)"), name(r"(?m)^--- (?:a/)?([^\t\n]+)")
    old = F.coalesce(name(r"(?m)^rename from (.+)$"), old, name(r"^diff --git a/(\S+) "))
    new = F.coalesce(name(r"(?m)^rename to (.+)$"), new, name(r"^diff --git a/\S+ b/(\S+)"))
    gone = new == "/dev/null"
    patch = F.regexp_extract("_p", r"(?s)(?:^|\n)(@@ -.*)$", 1)
    return rows.select(
        F.when(gone, old).otherwise(new).alias("path"), F.when(old != "/dev/null", old).alias("old_path"),
        patch.alias("patch"), F.coalesce(gone, F.lit(False)).alias("gone"),
    )


def patched_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``files`` with the changes of ``split_diff`` put over them; a patch that fails raises."""
    base = files.select(F.col("path").alias("old_path"), F.col("text").alias("_old"))
    edits = changes.filter(~F.col("gone")).join(base, "old_path", "left")
    text = F.when(F.col("patch") == "", F.coalesce("_old", F.lit(""))).otherwise(apply_patch(F.coalesce("_old", F.lit("")), "patch"))
    new = edits.select("path", text.alias("_new"))
    checked = F.when(
        F.col("_new").isNull(), F.raise_error(F.concat(F.lit("failed to apply diff to overlay: "), "path")).cast("string")
    ).otherwise(F.col("_new"))
    rows = new.select("path", checked.alias("text")).select(
        "path", F.octet_length("text").cast("long").alias("size"), "text", F.sha2("text", 256).alias("sha256")
    )
    touched = changes.select("path").unionByName(changes.filter("old_path IS NOT NULL").select(F.col("old_path").alias("path"))).distinct()
    return files.join(touched, "path", "left_anti").select("path", "size", "text", "sha256").unionByName(rows)
