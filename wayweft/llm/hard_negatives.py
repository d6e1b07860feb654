"""Hard negatives by inner product, with bounds from a spanning tree over the anchors.

A score at an anchor differs from the score at its parent in the tree by at most the length of the
edge times the candidate's norm. Going down the tree, a candidate is scored again only where the
bounds reach a window that still matters; elsewhere the bounds themselves are handed down. Anchors
are worked off in rounds of bounded size, so every task holds one round's tree, whatever the table.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayweft.session import materialise

EVERY = 100
SCALE = 256
SHIFTED, CLASSES = 7, 10
LOW, HIGH = 30, 90
#: Anchors of a tree block, vectors that blocks gather around, values of a round's anchors, and of a task's score matrix.
BLOCK = 512
CENTRES = 64
ROUND_VALUES = 1 << 20
MATRIX = 1 << 21
#: Scores below it are exact in doubles.
EXACT = 2.0**53
TOP = 2**63 - 1


def _vectors(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of a list column as doubles, short vectors filled up with zeros, and the usable rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes[~good] = 0
    row = np.repeat(np.arange(n), sizes)
    good[row[~np.isfinite(flat)]] = False
    out = np.zeros((n, width))
    ends = np.cumsum(sizes)
    keep = good[row]
    with np.errstate(over="ignore", invalid="ignore"):
        out[row[keep], (np.arange(len(flat)) - np.repeat(ends - sizes, sizes))[keep]] = np.floor(SCALE * flat[keep])
    return out, good


def usable(table: DataFrame) -> DataFrame:
    """vec_id, label (shifted where it is due) and vector of the rows that may take part, not yet asking for finite components."""
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (label + 1) % CLASSES).otherwise(label)
    named = table.select(F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return named.where("vec_id is not null and label is not null and embedding is not null")


def _finite(rows: DataFrame, width: int) -> DataFrame:
    """Rows with scaled vectors (q), those with a null or non-finite component left out."""

    def run(batches):
        for batch in batches:
            q, good = _vectors(batch.column("embedding"), width)
            at = np.flatnonzero(good)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(q[at].reshape(-1)))
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), lists], ["vec_id", "label", "q"])

    return rows.mapInArrow(run, "vec_id long, label long, q array<double>")


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    column = table.column("q").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if table.num_rows else np.zeros((0, width))


def anchors_in_blocks(rows: DataFrame, width: int, every: int, block: int) -> tuple[DataFrame, int]:
    """Anchors (vec_id, label, q, block) and the number of blocks, each of about ``block`` anchors near one centre.

    Of rows that share an anchor's vec_id, the least by label and vector is the anchor. The anchors of a
    centre are dealt to as many blocks as they need, so a crowd of equal anchors fills many blocks.
    """
    own = _finite(rows.where(F.col("vec_id") % every == 0), width)
    own = materialise(own.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q"))
    centres = _matrix(own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRES).select("q").toArrow(), width)
    half = (centres**2).sum(axis=1) / 2

    def nearest(batches):
        for batch in batches:
            q = _matrix(pa.Table.from_batches([batch]), width)
            near = np.argmin(half[None, :] - q @ centres.T, axis=1) if len(q) else np.zeros(0, np.int64)
            yield batch.append_column("centre", pa.array(near.astype(np.int32)))

    placed = materialise(own.mapInArrow(nearest, "vec_id long, label long, q array<double>, centre int"))
    sizes = sorted(placed.groupBy("centre").count().collect())  # at most CENTRES rows
    plan, first = [], 0
    for centre, n in sizes:
        plan.append((centre, first, ceil(n / block)))
        first += ceil(n / block)
    plan = rows.sparkSession.createDataFrame(plan, "centre int, first long, parts long")
    number = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return placed.join(F.broadcast(plan), "centre").select("vec_id", "label", "q", number.alias("block")), first


def _prim(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1 for the first row) and edge lengths of a minimum spanning tree of the rows."""
    n = len(q)
    parent, edge = np.full(n, -1), np.zeros(n)
    if n < 2:
        return parent, edge
    near, away = np.zeros(n, np.int64), np.sqrt(((q - q[0]) ** 2).sum(axis=1))
    todo = np.ones(n, bool)
    todo[0] = False
    for _ in range(n - 1):
        i = int(np.argmin(np.where(todo, away, np.inf)))
        parent[i], edge[i], todo[i] = near[i], away[i], False
        d = np.sqrt(((q - q[i]) ** 2).sum(axis=1))
        closer = d < away
        near[closer & todo], away[closer] = i, d[closer]
    return parent, edge


class Tree:
    """A round's anchors in the order of their levels, with one spanning tree over all blocks."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, blocks: np.ndarray):
        order = np.lexsort((ids, blocks))
        ids, labels, q, blocks = ids[order], labels[order], q[order], blocks[order]
        heads = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
        parent, edge = np.full(len(ids), -1), np.zeros(len(ids))
        over, length = _prim(q[heads])
        for k, (i, j) in enumerate(zip(heads, np.append(heads[1:], len(ids)))):
            p, e = _prim(q[i:j])
            parent[i:j], edge[i:j] = np.where(p < 0, -1, p + i), e
            parent[i], edge[i] = heads[over[k]] if over[k] >= 0 else -1, length[k]
        depth = np.full(len(ids), -1)
        level, at = 0, np.flatnonzero(parent < 0)
        while len(at):
            depth[at] = level
            level += 1
            at = np.flatnonzero((depth < 0) & (depth[parent] == level - 1))
        order = np.argsort(depth, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.labels, self.q = ids[order], labels[order], np.ascontiguousarray(q[order])
        self.parent = np.where(parent[order] < 0, -1, place[parent[order]])
        #: Lengthened by far more than rounding takes away.
        self.edge = edge[order] * (1 + 1e-9)
        self.levels = np.searchsorted(depth[order], np.arange(level + 1))
        self.norm = float(np.sqrt((q**2).sum(axis=1)).max(initial=0))

    def scores(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray]:
        """(anchors x rows) scores, and where they were made: wherever the bounds reach [low, high] of an anchor and ``allowed``."""
        norms = np.sqrt((q**2).sum(axis=1))
        if self.norm * norms.max(initial=0) >= EXACT:
            return self._wide(q), allowed
        n = len(q)
        lower, upper = np.empty((len(self.ids), n)), np.empty((len(self.ids), n))
        made = np.zeros((len(self.ids), n), bool)
        norms = norms * (1 + 1e-9)
        for i, j in zip(self.levels[:-1], self.levels[1:]):
            up = self.parent[i:j]
            if i == 0:
                lower[i:j] = upper[i:j] = self.q[i:j] @ q.T
                made[i:j] = True
                continue
            reach = self.edge[i:j, None] * norms[None, :] + 1
            lower[i:j], upper[i:j] = lower[up] - reach, upper[up] + reach
            hit = (upper[i:j] >= low[i:j, None]) & (lower[i:j] <= high[i:j, None]) & allowed[i:j]
            if hit.mean() > 0.1:
                exact = self.q[i:j] @ q.T
                lower[i:j] = upper[i:j] = exact
                made[i:j] = True
            else:
                a, c = np.nonzero(hit)
                lower[i + a, c] = upper[i + a, c] = np.einsum("ij,ij->i", self.q[i + a], q[c])
                made[i:j] = hit
        return lower, made & allowed

    def _wide(self, q: np.ndarray) -> np.ndarray:
        """Scores beyond what doubles hold, in Python's integers; those beyond 64 bits become the nearest long."""
        whole = lambda x: np.array([[int(v) if np.isfinite(v) else (TOP if v > 0 else -TOP) for v in r] for r in x], object)
        out = np.dot(whole(self.q), whole(q).T)
        return np.clip(out, -TOP, TOP).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:keep]
    return scores[order], ids[order]


def _search(tree: Tree, windows: tuple, keep: int, same: bool, width: int):
    """The first ``keep`` rows by score and vec_id in each window (anchor, low, high) of the tree's anchors.

    ``same`` says whether the rows must have the anchor's label or another one. An anchor's own vec_id
    never counts.
    """
    owner, low, high = windows
    first = np.searchsorted(owner, np.arange(len(tree.ids) + 1))

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in owner]
        need = low.copy()
        rows = max(64, MATRIX // max(1, len(tree.ids)))
        lowest, highest = np.full(len(tree.ids), TOP), np.full(len(tree.ids), -TOP)
        np.minimum.at(lowest, owner, need)
        np.maximum.at(highest, owner, high)
        for batch in _pieces(batches, rows):
            q, good = _vectors(batch.column("embedding"), width)
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[good] for c in ("vec_id", "label"))
            q = q[good]
            if not len(q) or not len(tree.ids):
                continue
            allowed = (tree.labels[:, None] == labels[None, :]) == same
            allowed &= tree.ids[:, None] != ids[None, :]
            scores, made = tree.scores(q, lowest, highest, allowed)
            made &= (scores >= lowest[:, None]) & (scores <= highest[:, None])
            for a in np.flatnonzero(made.any(axis=1)):
                at = np.flatnonzero(made[a])
                s, v = _best(scores[a, at].astype(np.int64), ids[at], len(at))
                for w in range(first[a], first[a + 1]):
                    i = np.searchsorted(-s, -high[w])
                    x, y = s[i : i + keep], v[i : i + keep]
                    x, y = x[x >= need[w]], y[: (x >= need[w]).sum()]
                    if len(x):
                        old = found[w]
                        found[w] = _best(np.append(old[0], x), np.append(old[1], y), keep)
                        if len(found[w][0]) == keep:
                            need[w] = found[w][0][-1]
                lowest[a] = need[first[a] : first[a + 1]].min()
        sizes = [len(s) for s, _ in found]
        for i in range(0, len(owner), 4096):
            part, n = found[i : i + 4096], sizes[i : i + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(i, i + len(n), dtype=np.int32), n)), *[pa.array(np.concatenate([x[k] for x in part])) for k in (0, 1)]], ["w", "score", "vec_id"]
            )

    return run


def _pieces(batches, rows: int):
    """Batches of ``rows`` rows, the last one smaller, however many come in at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            full = n // rows * rows
            yield from whole.slice(0, full).to_batches(max_chunksize=rows)
            held, n = whole.slice(full).to_batches(), n - full
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("w").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 10, every: int = EVERY, low: int = LOW, high: int = HIGH, round_values: int = ROUND_VALUES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``table`` (vec_id, embedding, label, ...).

    Anchors are the rows whose vec_id ``every`` divides. Components become floor(256 * x); a score is the
    integer inner product with the anchor, and higher scores, then smaller vec_ids come first. For each
    anchor and each of its first ``positives`` other rows of its label come the first ``negatives`` rows of
    other labels whose score is between ``low`` and ``high`` hundredths of the positive one. Where 7
    divides vec_id, the label first becomes (label + 1) % 10.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Short
    vectors count as filled up with zeros. Rows that repeat a vec_id are rows of their own, but of
    several with an anchor's vec_id the least is the anchor, and none is its positive or negative.
    Scores beyond 64 bits count as the nearest long. Other columns are ignored; an empty table gives an
    empty result.

    Each round reads the table twice, for positives and for negatives. What the driver sends to the tasks
    is a round's anchors (``round_values`` components) and their windows.
    """
    spark = table.sparkSession
    rows = usable(table)
    width = rows.agg(F.max(F.size("embedding")).alias("n")).first().n or 1
    anchors, blocks = anchors_in_blocks(rows, width, every, block)
    per_round = max(1, round_values // width // block)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kind = "w int, score long, vec_id long"
    for start in range(0, blocks, per_round):
        own = anchors.where((F.col("block") >= start) & (F.col("block") < start + per_round)).toArrow()
        if not own.num_rows:
            continue
        names = [own.column(c).to_numpy() for c in ("vec_id", "label", "block")]
        tree = Tree(names[0], names[1], _matrix(own, width), names[2])
        every_anchor = np.arange(len(tree.ids))
        open_ = (every_anchor, np.full(len(tree.ids), -TOP), np.full(len(tree.ids), TOP))
        found = _ranked(rows.mapInArrow(_search(tree, open_, positives, True, width), kind), positives).toArrow().sort_by([("w", "ascending"), ("rank", "ascending")])
        owner, score, chosen = (found.column(c).to_numpy() for c in ("w", "score", "vec_id"))
        exact = [int(s) for s in score]
        limits = [np.array([f(s) for s in exact], np.int64) for f in (lambda s: -(-s * low // 100), lambda s: s * high // 100)]
        pairs = spark.createDataFrame(
            pa.table({"w": pa.array(np.arange(len(owner), dtype=np.int32)), "anchor_id": tree.ids[owner], "positive_id": chosen, "positive_score": score})
        )
        near = _ranked(rows.mapInArrow(_search(tree, (owner.astype(np.int64), *limits), negatives, False, width), kind), negatives)
        near = near.join(F.broadcast(pairs), "w")
        out = out.unionByName(materialise(near.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return out


SQL = """
WITH raw AS (
    SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), parts AS (
    SELECT row_id, vec_id, label, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS x FROM raw
), bad AS (
    SELECT DISTINCT row_id FROM parts WHERE x IS NULL OR NOT isfinite(x)
), scaled AS MATERIALIZED (
    SELECT row_id, vec_id, label, list(floor(256 * x)::BIGINT ORDER BY place) AS q
    FROM parts WHERE row_id NOT IN (SELECT row_id FROM bad) GROUP BY ALL
), scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q::DOUBLE[], c.q::DOUBLE[])::BIGINT AS score
    FROM scaled a JOIN scaled c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
