"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a hash, and a pseudo-random order of its blocks says
which ones the mix takes, some of them twice, the last one in part. That gives exact block quotas per source. A binary tree
over the output shards splits the quotas: at each node the left half's share of every source is drawn
from the multivariate hypergeometric distribution, so each shard gets a random, exact selection.
A shard then draws its blocks from the source's order, disjoint from all others, and orders its
documents by a hash. All of it is DataFrame code; only tables of sources and blocks are shuffled
before the documents meet their blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayweft.llm.shared import carry, text_words, uncarried
from wayweft.session import materialise

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST_COPIES = 2
SHARDS = 16
BLOCKS = 256
PART_BYTES = 128 << 20
SEED = 11


def source_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size): one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``percent`` hundredths of
    all sizes; a target stops at ``most`` times its source's size and the excess is shared again by
    weight. A source is at its limit exactly if the level at which it reaches it, limit per weight,
    asks for no more than there is to share; so one pass in that order replaces the rounds.
    """
    total = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    so_far = W.orderBy((F.col("cap") / F.col("weight")).asc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranked.withColumns(
        {
            "all": F.sum("source_size").over(total), "weights": F.sum("weight").over(total),
            "caps_below": F.sum("cap").over(so_far), "weights_below": F.sum("weight").over(so_far),
        }
    )
    asked = F.col("caps_below") * F.col("weight") + F.col("cap") * (F.col("weights") - F.col("weights_below"))
    ranked = ranked.withColumn("full", asked * 100 <= F.col("all") * F.col("weight") * percent)
    capped = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(total)
    free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(total)
    share = (F.col("weight") * (F.col("all") * percent - capped * 100)).cast("double") / (free * 100).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def hypergeometric(population: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked items in a random draw, by inversion at ``u``.

    The masses follow from each other by their ratio, over twelve deviations on both sides of the
    mean; what lies outside is below the precision of a double.
    """
    mean = f"({drawn}) * cast({marked} AS DOUBLE) / greatest({population}, 1)"
    reach = f"(12 * sqrt(({mean}) * (1 - cast({marked} AS DOUBLE) / greatest({population}, 1))) + 12)"
    low = f"greatest(0L, ({drawn}) + ({marked}) - ({population}), cast(floor({mean} - {reach}) AS BIGINT))"
    high = f"least({drawn}, {marked}, cast(ceil({mean} + {reach}) AS BIGINT))"
    ratio = f"(({marked}) - k) * (({drawn}) - k) / ((k + 1.0D) * (({population}) - ({marked}) - ({drawn}) + k + 1))"
    masses = (
        f"aggregate(sequence({low}, {high}), struct(1.0D AS p, 0.0D AS total),"
        f" (m, k) -> struct(m.p * {ratio} AS p, m.total + m.p AS total), m -> m.total)"
    )
    return (
        f"aggregate(sequence({low}, {high}), struct(1.0D AS p, 0.0D AS below, {low} AS at, ({u}) * {masses} AS goal),"
        f" (h, k) -> struct(h.p * {ratio} AS p, h.below + h.p AS below,"
        f" if(h.below + h.p <= h.goal AND k < {high}, k + 1, h.at) AS at, h.goal AS goal), h -> h.at)"
    )


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(rank, shard, first, blocks): which stretch of each source's block order a shard draws.

    ``quotas`` is (rank, quota), a row per source: a small table, held as one array per tree node.
    Each level halves the nodes: the left child's number of blocks is set, and its parts are drawn
    source by source from what is left, which is the multivariate hypergeometric law.
    """
    depth = max(shards - 1, 0).bit_length()
    level = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("quota").cast("long").alias("n")))).alias("q"))
    level = level.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    for _ in range(depth):
        total = "aggregate(q, 0L, (a, x) -> a + x.n)"
        node = level.withColumn("mid", F.expr("cast((lo + hi + 1) div 2 AS INT)")).withColumn("total", F.expr(total))
        node = node.withColumn("want", F.expr("cast(floor(total * (mid - lo) / greatest(hi - lo, 1)) AS BIGINT)"))
        u = f"pmod(xxhash64(lo, hi, x.rank, {seed}), {1 << 52}L) / {float(1 << 52)}D"
        draw = hypergeometric("s.left", "x.n", "s.want", u)
        step = (
            "aggregate(q, struct(total AS left, want AS want, cast(array() AS ARRAY<BIGINT>) AS got), (s, x) -> transform(array("
            f"{draw}), d -> struct(s.left - x.n AS left, s.want - d AS want, concat(s.got, array(d)) AS got))[0], s -> s.got)"
        )
        node = node.withColumn("got", F.expr(step))
        left = F.expr("transform(q, (x, i) -> struct(x.rank AS rank, got[i] AS n))")
        right = F.expr("transform(q, (x, i) -> struct(x.rank AS rank, x.n - got[i] AS n))")
        kids = F.when(F.col("hi") - F.col("lo") > 1, F.array(F.struct(F.col("lo"), F.col("mid").alias("hi"), left.alias("q")), F.struct(F.col("mid").alias("lo"), F.col("hi"), right.alias("q"))))
        level = node.select(F.explode(kids.otherwise(F.array(F.struct("lo", "hi", "q")))).alias("c")).select("c.*")
    leaves = level.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("shard", "x.rank", F.col("x.n").alias("blocks"))
    before = F.sum("blocks").over(W.partitionBy("rank").orderBy("shard")) - F.col("blocks")
    return leaves.select("rank", "shard", before.alias("first"), "blocks").where("blocks > 0")


def _digest(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def _block(seed: int, blocks: int) -> Column:
    return F.pmod(F.conv(F.substring(_digest(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")


def _order(seed: int) -> Column:
    """A document's place in its block."""
    return _digest(seed + 1, F.col("doc_id"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _picks(keyed: DataFrame, placed: DataFrame) -> DataFrame:
    """(rank, block, picks): documents of the last pass beyond the crossing one, by their places ``o``.

    What the last pass leaves of a target is less than the words of the document that would cross it.
    It is filled from the documents left over, the longest that still fits first, until none fits; of
    one size those first by block and place. Only the number of documents of each size that fits is
    needed for that, a list no longer than the crossing document has words.
    """
    used = F.sum(F.when(F.col("all"), F.col("words")).otherwise(F.coalesce("run", F.lit(0))))
    gaps = placed.groupBy("rank").agg(F.floor(F.max("rest") - used).alias("gap")).where("gap > 0")
    over = placed.where(~F.col("all")).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "rank", "until").join(gaps, "rank")
    units = keyed.join(over, _same("source", "_s") & (F.col("block") == F.col("_b"))).where("until is null or o > until")
    units = units.groupBy("rank", "gap", "block", "o").agg(F.sum("size").alias("size")).where("size > 0 and size <= gap").drop("gap")
    units = materialise(units)
    counts = materialise(units.groupBy("rank", "block", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("rank", "size").agg(F.sum("n").alias("n")).groupBy("rank")
    sizes = sizes.agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("sizes")).join(gaps, "rank")
    fill = (
        "aggregate(sizes, struct(gap AS gap, cast(array() AS ARRAY<STRUCT<size: BIGINT, wanted: BIGINT>>) AS got),"
        " (f, x) -> if(x.size > f.gap, f, struct(f.gap - x.size * least(x.n, f.gap div x.size) AS gap,"
        " concat(f.got, array(struct(x.size AS size, least(x.n, f.gap div x.size) AS wanted))) AS got)), f -> f.got)"
    )
    wanted = sizes.select("rank", F.explode(F.expr(fill)).alias("w")).select("rank", "w.size", "w.wanted")
    before = F.sum("n").over(W.partitionBy("rank", "size").orderBy("block")) - F.col("n")
    cut = counts.join(wanted, ["rank", "size"]).withColumn("most", F.col("wanted") - before).where("most > 0")
    placing = F.row_number().over(W.partitionBy("rank", "block", "size").orderBy("o"))
    picked = units.join(cut.select("rank", "block", "size", "most"), ["rank", "block", "size"]).withColumn("nth", placing).where("nth <= most")
    return picked.groupBy("rank", "block").agg(F.array_sort(F.collect_list("o")).alias("picks"))


def draws(sized: DataFrame, targets: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(source, block, source_size, target, taken): the draws of each block, a list of (copy, shard, all, until, picks).

    ``sized`` is (doc_id, source, size). Passes over a source's block order are taken whole while the
    target allows it (``all``). In the last pass the block that crosses the target is drawn up to the
    document that would cross it (``until``, in hash order), and single documents that still fit are
    drawn from the rest (``picks``).
    """
    targets_by = targets.select(F.col("source").alias("_s"), "rank", "target", "source_size")
    keyed = sized.select("source", "size", _block(seed, blocks).alias("block"), _order(seed).alias("o"))
    per_block = keyed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    per_block = per_block.join(targets_by, _same("source", "_s")).drop("_s")
    in_order = W.partitionBy("rank").orderBy(_digest(seed + 2, F.col("rank"), F.col("block")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = per_block.withColumns(
        {
            "place": F.row_number().over(in_order) - 1, "of": F.count("*").over(W.partitionBy("rank")),
            "before": F.sum("words").over(in_order) - F.col("words"), "whole": whole.cast("long"),
        }
    )
    placed = materialise(placed.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    crossed = (F.col("rest") > F.col("before")) & (F.col("rest") < F.col("before") + F.col("words"))
    cut = placed.where(crossed).select(F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("rest") - F.col("before")).alias("room"))
    inside = keyed.join(cut, _same("source", "_s") & (F.col("block") == F.col("_b")))
    so_far = W.partitionBy("_s", "_b").orderBy("o").rangeBetween(W.unboundedPreceding, W.currentRow)
    near = inside.withColumn("run", F.sum("size").over(so_far)).where("run <= room").groupBy("_s", "_b").agg(F.max("o").alias("until"), F.max("run").alias("run"))
    placed = placed.join(near, _same("source", "_s") & (F.col("block") == F.col("_b")), "left").drop("_s", "_b")
    placed = materialise(placed.withColumn("all", (F.col("rest") >= F.col("before") + F.col("words")) & (F.col("rest") > 0)))
    placed = materialise(placed.join(_picks(keyed, placed), ["rank", "block"], "left"))
    last = F.col("all") | F.col("until").isNotNull() | F.col("picks").isNotNull()
    passes = placed.withColumn("last", last).withColumn("pass", F.explode(F.expr("sequence(0L, whole)"))).where("pass < whole or last")
    in_last = F.col("pass") == F.col("whole")
    items = passes.select(
        "rank", "block", F.col("pass").cast("int").alias("copy"), (F.col("pass") * F.col("of") + F.col("place")).alias("item"),
        (~in_last | F.col("all")).alias("all"), F.when(in_last, F.col("until")).alias("until"), F.when(in_last, F.col("picks")).alias("picks"),
    )
    # Shards draw in an order of their own, a permutation of all the items of a source.
    shuffled = W.partitionBy("rank").orderBy(_digest(seed + 3, F.col("rank"), F.col("item")))
    items = materialise(items.withColumn("drawn", (F.row_number().over(shuffled) - 1).cast("long")))
    quotas = items.groupBy("rank").agg(F.count("*").alias("quota"))
    spans = shard_quotas(quotas, shards, seed).select("rank", "shard", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("drawn"))
    taken = items.join(spans, ["rank", "drawn"]).groupBy("rank", "block").agg(F.collect_list(F.struct("copy", "shard", "all", "until", "picks")).alias("taken"))
    return materialise(placed.select("rank", "source", "block", "source_size", "target").join(taken, ["rank", "block"], "left").drop("rank"))


def drawn(docs: DataFrame, plan: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, ...) with source_size, target and draws, a list of (copy, shard).

    Columns with the names of the new ones are replaced, all others are carried along.
    """
    new = ("source_size", "target", "draws")
    text = ["text"] if "text" in docs.columns else []
    marked = carry(docs, "doc_id", "source", *text, new=new).withColumns({"b": _block(seed, blocks), "o": _order(seed)})
    plan = plan.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "source_size", "target", "taken")
    out = marked.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("b") == F.col("_b")), "left")
    mine = F.filter(
        F.coalesce("taken", F.array()),
        lambda t: t["all"] | F.coalesce(F.col("o") <= t["until"], F.lit(False)) | F.coalesce(F.array_contains(t["picks"], F.col("o")), F.lit(False)),
    )
    draws_of = F.transform(mine, lambda t: F.struct(t["copy"].alias("copy"), t["shard"].alias("shard")))
    return uncarried(out.withColumn("draws", draws_of), docs, new)


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, bytes), stored; the size is the number of words, 0 for a null text."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return materialise(docs.select("doc_id", "source", F.size(text_words(F.col("text"))).cast("long").alias("size"), n_bytes.alias("bytes")))


def mix_plan(sized: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED):
    """The draws of every block of ``sized``; see ``mixture`` for what is drawn."""
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most))
    return draws(sized, targets, shards, blocks, seed)


def mixture(
    docs: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES, shards: int = SHARDS,
    blocks: int = BLOCKS, seed: int = SEED, part_bytes: int = PART_BYTES,
):
    """The mix: a row of ``docs`` for each time it is drawn, with shard and copy, each shard shuffled.

    No document is drawn more than ``most`` times. The words drawn from a source fall short of its
    target by less than the smallest document with words that the last pass left over. Draws depend on
    the doc_ids and ``seed`` alone, so reruns agree. A shard is a run of partitions of about
    ``part_bytes`` of text, in the order of a hash within and across them.

    Null sources form one source, the last. Rows that share a doc_id are drawn together, null doc_ids
    as one id. Of a source without words nothing is drawn. An empty table gives an empty mix. Other
    columns are carried along; columns named shard or copy are replaced.
    """
    sized = with_sizes(docs)
    plan = mix_plan(sized, weights, percent, most, shards, blocks, seed)
    new = ("shard", "copy")
    own = carry(docs, "doc_id", "source", "text", new=new)
    rows = drawn(own, plan, blocks, seed).withColumn("d", F.explode("draws")).select("doc_id", "text", "others", "d.shard", "d.copy")
    mixed_bytes = (sized.agg(F.sum("bytes")).first()[0] or 0) * percent // 100
    parts = max(1, -(-mixed_bytes // (shards * part_bytes)))
    rows = rows.withColumn("at", _digest(seed + 4, F.col("doc_id"), F.col("copy")))
    # The leading 32 bits of the order, cut into equal stretches.
    part = F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    rows = rows.repartitionById(shards * parts, F.col("shard") * parts + part).sortWithinPartitions("shard", "at")
    return uncarried(rows, docs, new)


SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 256 AS block,
         md5('12:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM sources),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         sum(cap) OVER (ORDER BY cap / weight RANGE UNBOUNDED PRECEDING) AS caps_below,
         sum(weight) OVER (ORDER BY cap / weight RANGE UNBOUNDED PRECEDING) AS weights_below
  FROM weighed),
filled AS (SELECT *, (caps_below * weight + cap * (weights - weights_below)) * 100 <= total * weight * 150 AS reached FROM levels),
targets AS (
  SELECT source, rank, source_size,
         CASE WHEN reached THEN cap::DOUBLE ELSE
           (weight * (total * 150 - 100 * coalesce(sum(cap) FILTER (WHERE reached) OVER (), 0)))::DOUBLE
           / (100 * sum(weight) FILTER (WHERE NOT reached) OVER ())::DOUBLE END AS target
  FROM filled),
blocks AS (
  SELECT t.rank, s.block, sum(s.size)::BIGINT AS words FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
placed AS (
  SELECT b.rank, b.block, b.words,
         sum(b.words) OVER (PARTITION BY b.rank ORDER BY md5('13:' || b.rank || ':' || b.block)) - b.words AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS rest
  FROM blocks b JOIN targets t USING (rank)),
docs AS (
  SELECT s.doc_id, s.size, s.o, t.source_size, t.target, p.*,
         sum(s.size) OVER (PARTITION BY p.rank, p.block ORDER BY s.o RANGE UNBOUNDED PRECEDING) AS run
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source JOIN placed p ON p.rank = t.rank AND p.block = s.block),
marked AS (SELECT *, rest > 0 AND run <= rest - before AS last FROM docs),
gaps AS (SELECT rank, floor(max(rest) - coalesce(sum(size) FILTER (WHERE last), 0))::BIGINT AS gap FROM marked GROUP BY rank),
units AS (
  SELECT rank, block, o, sum(size)::BIGINT AS size FROM marked WHERE NOT last GROUP BY ALL HAVING sum(size) > 0),
counts AS (SELECT rank, size, count(*) AS n FROM units GROUP BY ALL),
filled_up AS (
  SELECT rank, 9223372036854775807 AS size, 0::BIGINT AS wanted, gap FROM gaps
  UNION ALL
  SELECT rank, size, wanted, gap - size * wanted FROM (
    SELECT f.rank, f.gap, max(c.size) AS size, least(arg_max(c.n, c.size), f.gap // max(c.size)) AS wanted
    FROM filled_up f JOIN counts c ON c.rank = f.rank AND c.size <= f.gap AND c.size < f.size GROUP BY f.rank, f.gap)),
picked AS (
  SELECT rank, o FROM (
    SELECT u.rank, u.o, f.wanted, row_number() OVER (PARTITION BY u.rank, u.size ORDER BY u.block, u.o) AS nth
    FROM units u JOIN filled_up f ON f.rank = u.rank AND f.size = u.size)
  WHERE nth <= wanted)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN last OR (rank, o) IN (SELECT (rank, o) FROM picked) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM marked
"""
