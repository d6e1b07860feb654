"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits. Every bit place gets a vector of five bits, and every non-zero vector v of
five bits gives a mask: the places whose vector has an odd number of ones in common with v. Places
where two fingerprints differ, four at most, span at most four of the five dimensions, so some v is
orthogonal to all of them: its mask leaves all of them out, and the two fingerprints agree under it.
Hence every pair within the radius meets in one of the 31 tables, without a chance of a miss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.llm.graph import components
from wayweft.llm.words import signed, slices
from wayweft.session import materialise

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Rows outside a bucket's largest group that are held against all its members; beyond it balls meet.
FEW = 256


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 hashes of a text's runs of ``size`` lower-cased words."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and the blanks that end a word.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(last), 1 << 16):
        cut = zip(starts[i : i + (1 << 16)].tolist(), last[i : i + (1 << 16)].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cut], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and bits (the fingerprint as a BIGINT) for each row of ``docs``."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                bits = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(signed(bits))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bits long")


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of a covering family for ``radius``, each about half of the places."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _long(x: int) -> Column:
    return F.lit(x - (1 << BITS) if x >> (BITS - 1) else x).cast("long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (bits) within ``radius`` of each other.

    Every edge is a pair within the radius, or leads through a fingerprint that no document has but that
    two documents' fingerprints are near enough to. In each bucket the members are first held against
    the smallest one. Where they then lie in several groups, those outside the largest (``FEW`` of them at most) are
    held against the members of other groups. Where there are more, each member names all values
    within half the radius under the bucket's mask: two fingerprints within the radius name one in
    common, and two that name one in common are within the radius. A bucket thus costs a bounded
    number of rows a member, whatever its size.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(_long(m)).alias("h")) for t, m in enumerate(masks(radius))])
    keyed = prints.select("bits", F.explode_outer(tables).alias("k")).select("bits", "k.t", "k.h")
    pivots = keyed.groupBy("t", "h").agg(F.min("bits").alias("pivot"), F.max("bits").alias("last")).where("pivot < last")
    members = materialise(keyed.join(pivots.drop("last"), ["t", "h"]))
    near = members.where((F.col("bits") != F.col("pivot")) & (_distance("bits", "pivot") <= radius))
    first = materialise(near.select(F.col("pivot").alias("a"), F.col("bits").alias("b")).distinct())
    groups = materialise(components(first)).withColumnRenamed("node", "bits")
    label = F.coalesce("component", "bits").alias("label")
    own = materialise(members.join(groups, "bits", "left").select("t", "h", "bits", label))
    sizes = own.groupBy("t", "h", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("t", "h").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    mixed = materialise(mixed.where("n > most").select("t", "h", "main", (F.col("n") - F.col("most")).alias("rest")))
    left = own.join(mixed.where(F.col("rest") <= FEW), ["t", "h"]).where("label <> main").select("t", "h", F.col("bits").alias("a"), F.col("label").alias("label_a"))
    open_pairs = own.join(left, ["t", "h"]).where((F.col("label") != F.col("label_a")) & (_distance("a", "bits") <= radius))
    crowded = own.join(mixed.where(F.col("rest") > FEW).select("t", "h"), ["t", "h"], "left_semi")
    return first.unionByName(open_pairs.select("a", F.col("bits").alias("b"))).unionByName(_balls(crowded, radius))


def _balls(crowded: DataFrame, radius: int) -> DataFrame:
    """Edges between the members of crowded buckets by the values within half the radius of each.

    Members agree under the mask, so only flips outside it are made; an odd radius lets one of the
    two sides go a step further, which two members' values tell apart by their distance.
    """
    family = masks(radius)

    def run(batches):
        for batch in batches:
            bits, table, bucket = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bits", "t", "h"))
            for t in np.unique(table):
                free = np.array([1 << i for i in range(BITS) if not family[t] >> i & 1], np.uint64)
                flips = _flips(free, (radius + 1) // 2)
                at = np.flatnonzero(table == t)
                for i in range(0, len(at), 256):
                    part = bits[at[i : i + 256]].view(np.uint64)
                    values = part[:, None] ^ flips[None, :]
                    n = len(flips)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(values.size, t, np.int32)), pa.array(signed(values.reshape(-1))), pa.array(np.repeat(signed(part), n))], ["t", "z", "bits"]
                    )

    named = crowded.mapInArrow(run, "t int, z long, bits long")
    if radius % 2:
        # Members whose distances to the value add up to the radius: one goes a step less far.
        near = named.where(_distance("z", "bits") <= radius // 2).groupBy("t", "z").agg(F.min("bits").alias("a"))
        return named.join(near, ["t", "z"]).where("a <> bits").select("a", F.col("bits").alias("b"))
    lowest = named.groupBy("t", "z").agg(F.min("bits").alias("a"), F.max("bits").alias("last")).where("a < last").drop("last")
    return named.join(lowest, ["t", "z"]).where("a <> bits").select("a", F.col("bits").alias("b"))


def _flips(free: np.ndarray, most: int) -> np.ndarray:
    """Every xor of up to ``most`` of the bits ``free``."""
    out = level = [0]
    for _ in range(most):
        level = sorted({v | int(b) for v in level for b in free if not v & int(b)})
        out = out + level
    return np.array(out, np.uint64)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text, ...).

    A fingerprint bit is set when it is set in over half of the hashes of a text's runs of ``size``
    lower-cased (A-Z) words, repeats included; fewer words count as one run. Null or blank texts have
    the fingerprint zero and are linked like any other. Documents whose fingerprints differ in
    ``radius`` bits or fewer are linked; ``component_id`` is the smallest doc_id that a document reaches.

    Rows that share a doc_id are one document, with the links of all of them. A null doc_id is linked
    with nothing and has a null component. Other columns are ignored; an empty table gives an empty
    result. Equal fingerprints are one node from the start, so a crowd of copies costs no pair.
    """
    marks = materialise(fingerprints(docs, size))
    known = marks.where("doc_id is not null")
    prints = materialise(known.groupBy("bits").agg(F.min("doc_id").alias("first")))
    several = known.groupBy("doc_id").agg(F.min("bits").alias("a"), F.max("bits").alias("last")).where("a < last").drop("last")
    shared = known.join(several, "doc_id").where("bits <> a").select("a", F.col("bits").alias("b"))
    groups = components(links(prints.select("bits"), radius).unionByName(shared)).withColumnRenamed("node", "bits")
    groups = prints.join(groups, "bits", "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    groups = materialise(groups)
    lowest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(lowest, "component").select("bits", "component_id")
    out = marks.join(named, "bits", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), component)
