"""Pull-request inputs as tables: coordinates, remotes, headers, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayweft.functions.strings import strip

FILE_SCHEMA = "filename string, status string, additions int, deletions int, patch string, file_pos bigint"

URL = r"(?i)^https?://github\.com/([^/]+)/([^/]+)/(?:pull|issues)/(\d+)"
SHORT = r"^([^/]+)/([^#]+)#(\d+)$"
SSH_REMOTE = r"^git@github\.com:([^/]+)/(.+?)(?:\.git)?$"
HTTPS_REMOTE = r"^https?://github\.com/([^/]+)/(.+?)(?:\.git)?$"


def _pick(text: Column, group: int, *patterns: str) -> Column:
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(out)
    return out


def remote_slug(remote: Column) -> Column:
    """``struct<owner, repo>`` of a hosted remote address, fields null for other hosts."""
    return F.struct(
        _pick(remote, 1, SSH_REMOTE, HTTPS_REMOTE).alias("owner"), _pick(remote, 2, SSH_REMOTE, HTTPS_REMOTE).alias("repo")
    )


def is_hosted(remote: Column) -> Column:
    return remote.startswith("https://github.com/") | remote.startswith("http://github.com/") | remote.startswith("git@github.com:")


def hosted_slug(remote: Column) -> Column:
    """``owner/repo`` of a hosted address without the ``.git`` ending; other addresses lose only that."""
    return F.regexp_replace(F.regexp_replace(remote, r"^(?:https?://github\.com/|git@github\.com:)", ""), r"\.git$", "")


def coordinates(rows: DataFrame) -> DataFrame:
    """Add ``owner, repo, number`` to rows ``input, remote``: an address, ``owner/repo#n``, or a bare number.

    A bare number takes owner and repo from the remote; what fits nothing stays null.
    """
    text = strip(F.col("input"))
    bare = text.rlike(r"^\d+$")
    slug = remote_slug(F.col("remote"))
    number = F.when(bare & slug["owner"].isNotNull(), text).otherwise(_pick(text, 3, URL, SHORT))
    return rows.select(
        "*",
        F.when(bare, slug["owner"]).otherwise(_pick(text, 1, URL, SHORT)).alias("owner"),
        F.when(bare, slug["repo"]).otherwise(_pick(text, 2, URL, SHORT)).alias("repo"),
        number.cast("long").alias("number"),
    )


def pull_headers(raw: DataFrame) -> DataFrame:
    """Header rows with blank texts for missing ones and ``is_fork`` from differing repositories."""
    def text(name):
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    fork = F.coalesce(F.col("head_repo"), F.lit("")) != F.coalesce(F.col("base_repo"), F.lit(""))
    return raw.withColumns({"title": text("title"), "body": text("body"), "author": text("author")}).withColumn("is_fork", fork)


def human_comments(comments: DataFrame, limit: int = 30) -> DataFrame:
    """The first ``limit`` comments per request; automated authors go after the cut, not before it."""
    w = Window.partitionBy("pr").orderBy("pos")
    head = comments.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return head.filter(~F.col("author").endswith("[bot]")).drop("_n")
