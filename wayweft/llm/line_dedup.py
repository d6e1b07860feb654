"""Repeated lines over the whole corpus, found with levelled sorted runs of line hashes.

A run is a table of (key, n, top) hashed into buckets and sorted by key inside them. Batches come with
falling doc_ids; each is merge-joined with the runs so far: a key that no run has is new, and its
largest document of this batch is the one that keeps the line; a known key only adds to its count.
Runs of a level are merged into one of the next level as soon as there are ``FANOUT`` of them, so a
key is rewritten once per level, and a later batch never reads more than a few runs.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayweft.llm.shared import BLANKS, LOWER, UPPER, carry, uncarried
from wayweft.session import materialise, shuffle_width

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 3
FANOUT = 3
KEY_BYTES = 16
#: Stands for a null doc_id, which is below all others.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class SortedRuns:
    """Levelled runs of (key, n, top), each a bucketed table in the session's warehouse."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]
        self._tables: list[str] = []

    def _write(self, df: DataFrame) -> str:
        buckets = shuffle_width(self.spark)
        name = f"line_run_{uuid.uuid4().hex}"
        self._tables.append(name)
        df.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.remove(name)

    def _union(self, names: list[str]) -> DataFrame:
        """The rows of several runs, with keys cut out anew.

        The planner takes a union of bucketed tables for bucketed too and leaves out the shuffle of a
        sum over it, but then reads the tables unbucketed; a computed key keeps the shuffle.
        """
        parts = [self.spark.table(name).withColumn("key", F.substring("key", 1, KEY_BYTES)) for name in names]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Take in the counts of one batch, (key, n, top), whose documents lie below all earlier ones."""
        if not self.names():
            self.levels[0].append(self._write(batch))
            return
        own = self._write(batch)
        new, again = self.spark.table(own), None
        for name in self.names():
            # A key has a top in one run only, the one that was new to it.
            known = self.spark.table(name).where("top is not null").select("key")
            new = new.join(known, "key", "left_anti")
            part = self.spark.table(own).join(known, "key", "left_semi").select("key", "n", F.lit(None).cast("long").alias("top"))
            again = part if again is None else again.unionByName(part)
        self.levels[0].append(self._write(new.unionByName(again)))
        self._drop(own)
        self._compact()

    def _compact(self) -> None:
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                old = self.levels[i]
                merged = self._write(self._merged(old))
                self.levels[i] = []
                self.levels += [[]] if i + 1 == len(self.levels) else []
                self.levels[i + 1].append(merged)
                for name in old:
                    self._drop(name)

    def _merged(self, names: list[str]) -> DataFrame:
        return self._union(names).groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def totals(self) -> DataFrame:
        return self._merged(self.names())

    def close(self) -> None:
        for name in list(self._tables):
            self._drop(name)


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, rid, pos, first, key) of the lines with at least ``min_chars`` code points."""

    def run(batches):
        for batch in batches:
            rows, places, first, keys = [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                text, seen = text.as_py(), set()
                if text is None or len(text) < min_chars:
                    continue
                for place, line in enumerate(text.split(b"\n")):
                    key = line.strip().lower()
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                        continue
                    key = hashlib.blake2b(key, digest_size=KEY_BYTES).digest()
                    rows.append(row)
                    places.append(place)
                    first.append(key not in seen)
                    keys.append(key)
                    seen.add(key)
            at = pa.array(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("rid").take(at),
                    pa.array(places, pa.int32()), pa.array(first, pa.bool_()), pa.array(keys, pa.binary()),
                ],
                ["doc_id", "rid", "pos", "first", "key"],
            )

    return docs.mapInArrow(run, "doc_id long, rid long, pos int, first boolean, key binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (never null), rid (tells different texts of a doc_id apart) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("rid"), "text")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, rid, drop): the places of the lines that each text loses; texts that lose none are left out."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    cuts = keyed.where(F.col("doc_id") > NO_ID).agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    part = sum((F.when(F.col("doc_id") <= cut, 1).otherwise(0) for cut in sorted(set(cuts))), F.lit(0))
    store = f"line_keys_{uuid.uuid4().hex}"
    runs = SortedRuns(spark)
    try:
        _keys(keyed, min_chars).withColumn("part", part).write.partitionBy("part").format("parquet").saveAsTable(store)
        lines = spark.table(store)
        for i in range(len(set(cuts)) + 1):
            batch = lines.where(F.col("part") == i)
            # All rows of a doc_id are in one batch and count once.
            held = batch.where("first").select("key", "doc_id").distinct()
            runs.add(held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
        frequent = materialise(runs.totals().where(F.col("n") >= min_docs).select("key", "top"))
        gone = lines.join(frequent, "key").where("doc_id <> top").select("doc_id", "rid", "pos")
        return materialise(gone.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("drop")))
    finally:
        runs.close()
        spark.sql(f"DROP TABLE IF EXISTS {store}")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with frequent lines left only in the largest doc_id, plus n_lines and n_dropped.

    A line's key is the line stripped of white space and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that occur in ``min_docs`` documents or more lose all their lines except
    in the largest doc_id that holds them; all other lines stay, joined by line feeds.

    A null or empty text is one empty line, and a null text becomes an empty one. Rows that
    share a doc_id count as one document, and all rows of the largest doc_id keep the line. A null doc_id is
    below all others. An empty table gives an empty result. Columns named like the two new ones, in
    any case, are replaced.
    """
    new = ("n_lines", "n_dropped")
    drops = dropped_lines(docs, min_chars, min_docs, batches).select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "drop")
    own = carry(docs, "doc_id", "text", new=new)
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_d")) & (F.xxhash64("text") == F.col("_r"))
    out = own.join(drops.hint("shuffle_hash"), same, "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), text).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: lines[i])))
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")
    out = out.select("others", kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))
    return uncarried(out, docs, new)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` after ``dedup_lines``, with the same columns; n_chars follows the text."""
    own = carry(docs, "doc_id", "text")
    out = uncarried(dedup_lines(own), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
frequent AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, f.key IS NOT NULL AND l.doc_id <> f.top AS gone FROM lines l LEFT JOIN frequent f ON f.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
