"""From documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of documents; the mix adds the shard and the copy of each drawn document.
"""

from __future__ import annotations

import uuid

from wayweft.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from wayweft.llm.shared import table
from wayweft.session import ensure_checkpoint_dir


def quality_rules(spark, docs, sf_dir):
    """Documents that the base or a rule rejects go."""
    return quality.good_documents(docs)


def repeated_lines(spark, docs, sf_dir):
    """Frequent long lines stay in the largest doc_id only."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return near_dedup.without_near_duplicates(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """A row for each draw from the sources' target weights."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: Near-duplicates need components, which SQL on whole tables can't give in time; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other; each one's rows are written as Parquet to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
