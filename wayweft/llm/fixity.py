"""Fixity audit of WARC replicas by Merkle trees over records and offset ranges.

Every record is hashed. A file's records are grouped by ranges of offsets, a range's node hashes its
records in order, and sixteen nodes make one of the next level up to the root. Two replicas are
compared root first, and only below nodes that differ are the children looked at, so the work of a
comparison follows the damage. A file of any size is spread over its nodes; none is held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayweft.session import materialise

RANGE = 1 << 16
FANOUT = 16
#: Levels above the ranges; more are added if a file needs them.
LEVELS = 3
RECORDS_PER_FILE = 1000


def record_bytes(url: Column, body: Column) -> Column:
    """A response record as a WARC file holds it."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def packed(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, offset, length, record, page_id) of pages (page_id, url, html): about ``per_file`` records a file.

    A page goes to a file by a hash of its page_id; in a file, records follow each other by page_id
    (null first) and hash. Null urls and bodies are empty ones; repeated rows are records of their own.
    """
    files = F.greatest(F.lit(1), F.ceil(F.lit(pages.count()) / per_file)).cast("long")
    key = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    record = record_bytes(F.col("url"), F.col("html"))
    rows = pages.select(
        F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), files).alias("file"), F.col("page_id").cast("long").alias("page_id"), record.alias("record")
    )
    # Both digests are made before the offsets, so that no record has to be shuffled for them.
    flawed = F.sha2(F.concat(F.lit("~"), F.col("record")), 256)
    rows = rows.withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256), "flawed": flawed})
    order = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    return rows.withColumn("offset", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length"))


def _leaves(records: DataFrame) -> DataFrame:
    """(file, level 0, node, digest) from (file, offset, length, digest)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "digest")))
    joined = F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"])), ",")
    nodes = records.groupBy("file", F.expr(f"offset div {RANGE}").alias("node")).agg(inside.alias("records"))
    return nodes.select("file", F.lit(0).alias("level"), "node", F.sha2(joined, 256).alias("digest"))


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    inside = F.sort_array(F.collect_list(F.struct("node", "digest")))
    joined = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["node"], k["digest"])), ",")
    up = nodes.groupBy("file", F.expr(f"node div {FANOUT}").alias("up")).agg(inside.alias("kids"))
    return up.select("file", F.lit(level).alias("level"), F.col("up").alias("node"), F.sha2(joined, 256).alias("digest"))


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """The node tables, ranges first; the last holds one root a file."""
    out = [materialise(_leaves(records))]
    for level in range(1, levels + 1):
        out.append(materialise(_parents(out[-1], level)))
    return out


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on ``keys`` (never null) of rows whose digests differ, one side perhaps missing."""
    a, b = left.withColumnRenamed("digest", "left_digest"), right.withColumnRenamed("digest", "right_digest")
    return a.join(b, keys, "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def audit(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, faults) of two replicas' records (file, offset, length, digest).

    ``roots`` is (file, left_digest, right_digest) over all files. ``faults`` is (file, offset,
    left_length, right_length, left_digest, right_digest, status) with status changed, missing (not
    in the right replica) or extra, found by descending from differing roots.

    file and offset must not be null. A file that one replica lacks is all missing or extra; empty
    replicas give empty results. Equal records at one offset count as one.
    """
    left, right = left.distinct(), right.distinct()
    last = left.select("offset").union(right.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = LEVELS
    while last // RANGE >= FANOUT**levels:
        levels += 1
    a, b = tree(left, levels), tree(right, levels)
    roots = a[levels].select("file", F.col("digest").alias("left_digest")).join(b[levels].select("file", F.col("digest").alias("right_digest")), "file", "full")
    bad = _differing(a[levels].drop("level"), b[levels].drop("level"), ["file", "node"]).select("file", "node")
    for level in range(levels - 1, -1, -1):
        up = bad.select("file", F.col("node").alias("up"))
        kids = [t[level].drop("level").withColumn("up", F.expr(f"node div {FANOUT}")).join(up, ["file", "up"], "left_semi").drop("up") for t in (a, b)]
        bad = materialise(_differing(*kids, ["file", "node"]).select("file", "node"))
    own = [
        r.withColumn("node", F.expr(f"offset div {RANGE}")).join(bad, ["file", "node"], "left_semi").select("file", "offset", F.col("length").alias(f"{side}_length"), "digest")
        for side, r in (("left", left), ("right", right))
    ]
    faults = _differing(*own, ["file", "offset"])
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return roots, faults.withColumn("status", status)


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults by rule, for trials: of a hundred records about one is changed and one lost."""
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("fault:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long"), F.lit(100))
    return records.withColumn("_draw", draw).where("_draw <> 1").withColumn(
        "digest", F.when(F.col("_draw") == 0, F.col("flawed")).otherwise(F.col("digest"))
    ).drop("_draw")


def fixity_report(pages: DataFrame) -> DataFrame:
    """A row for each file: its size, both replicas' roots and the faults found below them."""
    records = packed(pages)
    stored = materialise(records.select("file", "offset", "length", "digest"))
    copy = materialise(damaged(records).select("file", "offset", "length", "digest"))
    roots, faults = audit(stored, copy)
    found = faults.groupBy("file").agg(
        F.count_if(F.col("status") == "changed").alias("n_changed"), F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.count_if(F.col("status") == "extra").alias("n_extra"), F.sum(F.coalesce("left_length", "right_length")).alias("bad_bytes"), F.min("offset").alias("first_bad"),
    )
    sizes = stored.groupBy("file").agg(F.count("*").alias("n_records"), F.sum("length").alias("n_bytes"))
    zero = {c: 0 for c in ("n_changed", "n_missing", "n_extra", "bad_bytes")}
    return sizes.join(roots, "file").join(found, "file", "left").fillna(zero)


SQL = r"""
WITH numbered AS (
  SELECT ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM pages) / 1000))::BIGINT AS file, page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
hashed AS (
  SELECT file, page_id, record, strlen(record) AS length, sha256(record) AS digest,
         ('0x' || substr(md5('fault:' || coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % 100 AS draw FROM numbered),
placed AS (
  SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset" FROM hashed),
sides AS (
  SELECT 'l' AS side, file, "offset", length, digest FROM placed UNION ALL
  SELECT 'r', file, "offset", length, CASE WHEN draw = 0 THEN sha256('~' || record) ELSE digest END FROM placed WHERE draw <> 1),
t0 AS (SELECT side, file, "offset" // 65536 AS node, sha256(string_agg("offset" || ':' || length || ':' || digest, ',' ORDER BY "offset")) AS digest FROM sides GROUP BY ALL),
t1 AS (SELECT side, file, node // 16 AS node, sha256(string_agg(t0.node || ':' || digest, ',' ORDER BY t0.node)) AS digest FROM t0 GROUP BY side, file, t0.node // 16),
t2 AS (SELECT side, file, node // 16 AS node, sha256(string_agg(t1.node || ':' || digest, ',' ORDER BY t1.node)) AS digest FROM t1 GROUP BY side, file, t1.node // 16),
t3 AS (SELECT side, file, node // 16 AS node, sha256(string_agg(t2.node || ':' || digest, ',' ORDER BY t2.node)) AS digest FROM t2 GROUP BY side, file, t2.node // 16),
sizes AS (
  SELECT file, count(*) AS n_records, sum(length)::BIGINT AS n_bytes, count(*) FILTER (WHERE draw = 0) AS n_changed, count(*) FILTER (WHERE draw = 1) AS n_missing,
         0::BIGINT AS n_extra, coalesce(sum(length) FILTER (WHERE draw < 2), 0)::BIGINT AS bad_bytes, min("offset") FILTER (WHERE draw < 2) AS first_bad
  FROM placed GROUP BY file)
SELECT s.*, l.digest AS left_digest, r.digest AS right_digest
FROM sizes s LEFT JOIN t3 l ON l.file = s.file AND l.side = 'l' LEFT JOIN t3 r ON r.file = s.file AND r.side = 'r'
"""
