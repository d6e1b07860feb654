"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One random permutation scatters the shingles over a ring of slots, a second one ranks the slots, and
coordinate k of a signature is the smallest rank after turning the ring by k places. All coordinates
of a shingle are thus one contiguous stretch of one table. Bands of coordinates give candidates,
64-bit shingle sets confirm them, and the links' connected components are the groups.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.llm.graph import components
from wayweft.llm.shared import carry, in_mask, mask_of, uncarried
from wayweft.llm.words import mix, shingle_sets, signed, slices, words
from wayweft.session import materialise

SHINGLE = 5
PERCENT = 80
RING_BITS = 18
ROWS, BANDS = 5, 40
COORDINATES = ROWS * BANDS


@lru_cache(1)
def _ring() -> np.ndarray:
    """Row s holds the ranks that a shingle in slot s meets as the ring turns."""
    rank = np.random.Generator(np.random.PCG64(7)).permutation(1 << RING_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: COORDINATES - 1]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    slots = np.unique((mix(shingles ^ np.uint64(0x5DEECE66D)) >> np.uint64(64 - RING_BITS)).astype(np.int64))
    out = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for i in range(0, len(slots), 2048):
        np.minimum(out, _ring()[slots[i : i + 2048]].min(axis=0), out=out)
    return out


def _banded(signatures: np.ndarray) -> np.ndarray:
    """A key per band; a band's coordinates lie far apart on the ring."""
    part = signatures.astype(np.uint64).reshape(-1, ROWS, BANDS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(part), BANDS))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part[:, r])
    return keys


def _signed_lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(signed(values).reshape(-1))
    )


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), set_a and set_b (fingerprint of the set), bands (a BIGINT each)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                prints, bounds, *_ = words(batch.column("text"))
                sets = shingle_sets(prints, bounds, size)
                marks = np.array([signature(s) for s in sets]).reshape(-1, COORDINATES)
                sums = np.array([(s.sum(), mix(s).sum()) for s in sets], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(np.array([len(s) for s in sets], np.int64)),
                        pa.array(signed(sums[:, 0])), pa.array(signed(sums[:, 1])),
                        _signed_lists(_banded(marks)),
                    ],
                    ["doc_id", "n", "set_a", "set_b", "bands"],
                )

    kind = "doc_id long, n long, set_a long, set_b long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, grams) of the documents that ``wanted`` (id) names, and of a few others."""
    mask = mask_of(wanted, "id")

    def run(batches):
        for whole in batches:
            ids = whole.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = in_mask(mask, ids)
            if not hit.any():
                continue
            for batch in slices(whole.filter(pa.array(hit)), "text"):
                prints, bounds, *_ = words(batch.column("text"))
                sets = shingle_sets(prints, bounds, size)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(sets))))],
                    ["id", "grams"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, grams array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough.

    A pivot of very many pairs makes one skewed join key, which Spark splits at run time.
    """
    pairs = materialise(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(docs, wanted, size)
    left, right = sets.toDF("a", "grams_a"), sets.toDF("b", "grams_b")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return (
        pairs.join(right, "b").join(left, "a")
        .where(both * 100 >= (F.size("grams_a") + F.size("grams_b") - both) * percent)
        .select("a", "b").distinct()
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...).

    A document's set holds its distinct runs of ``size`` lower-cased words (A-Z only); fewer words
    count as one run. Two documents are linked when their sets share ``percent`` hundredths of their
    union; ``component_id`` is the smallest doc_id a document reaches, ``kept`` marks that one.

    Null or blank texts have empty sets and are linked with nothing. Rows that share a doc_id are one
    document, with the links of all of them, and are kept or dropped together. A null doc_id is
    linked with nothing, has a null component and is kept. Other columns are ignored; an empty table
    gives an empty result.

    Equal sets form a class, and only a class's smallest doc_id is banded. In a bucket, every member
    is held against the smallest one, so a bucket of copies costs as many pairs as members. Where its
    members then still lie in several groups, those outside the largest are held against all
    members of other groups that exact bounds leave (``_open_pairs``): no pair of a bucket is left out. A pair
    of similarity 0.8 shares no bucket with a chance of 1.3e-7, a more similar one with far less.
    """
    marks = materialise(signatures(docs, size))
    full = marks.where("n > 0 and doc_id is not null")
    classes = materialise(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    chosen = full.withColumnRenamed("doc_id", "rep").join(classes, ["set_a", "set_b", "rep"], "left_semi").select("rep", "bands")
    banded = materialise(chosen).select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last")
    members = materialise(banded.join(buckets.drop("last"), "bucket"))
    links = confirmed(members.where("rep > pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")), docs, size, percent)
    groups = materialise(components(links))
    more = confirmed(_open_pairs(docs, members, groups, size, percent), docs, size, percent)
    groups = components(groups.toDF("a", "b").unionByName(more))

    rep_groups = (
        classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    )
    out = marks.select("doc_id", "n", "set_a", "set_b").join(rep_groups, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _open_pairs(docs: DataFrame, members: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket that lie in different groups and could be linked.

    Loose copies of one text share buckets by the thousand without a link, so their pairs are not
    listed by bucket. Of a document's shingles, rarest first, a linked one must share one of the first
    fifth (prefix filter), and the first shared one must come early enough in both to leave room for
    the overlap that a link needs (position filter). Both bounds are exact.
    """
    lab = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("label"))
    sizes = lab.groupBy("bucket", "label").count()
    main = F.max_by("label", F.struct("count", "label")).alias("main")
    mixed = sizes.groupBy("bucket").agg(main, F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket", "main")
    # Of a pair in different groups, one document at least is outside the bucket's largest group.
    few = lab.join(mixed, "bucket").groupBy("rep").agg(F.min("label").alias("label"), F.bool_or(F.col("label") != F.col("main")).alias("few"))
    few = materialise(few)

    grams = _sets(docs, few.select(F.col("rep").alias("id")), size).select(F.col("id").alias("rep"), F.hash("grams").alias("part"), F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df"))
    own = grams.join(counts, "gram").groupBy("rep", "part").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    n = F.size("g")
    first = F.slice("g", 1, F.floor(n * (100 - percent) / 100).cast("int") + 1)
    prefix = own.join(few, "rep").select("rep", "label", "few", n.alias("n"), F.posexplode(first).alias("i", "x"))
    prefix = materialise(prefix.select("rep", "label", "few", "n", "i", F.col("x.gram").alias("gram")))
    left = prefix.where("few").select("gram", *[F.col(c).alias(f"{c}_a") for c in ("rep", "label", "n", "i")])
    room = F.least(F.col("n") - F.col("i"), F.col("n_a") - F.col("i_a"))
    near = (F.col("label") != F.col("label_a")) & (room * (100 + percent) >= (F.col("n") + F.col("n_a")) * percent)
    near &= F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent
    out = left.join(prefix, "gram").where(near)
    return out.select(F.least("rep_a", "rep").alias("a"), F.greatest("rep_a", "rep").alias("b"))


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns as they were."""
    dropped = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    own = carry(docs, "doc_id", "text")
    return uncarried(own.join(dropped, F.col("doc_id").cast("long") == F.col("_id"), "left_anti"), docs)
