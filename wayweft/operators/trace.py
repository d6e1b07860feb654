"""From a symbol or runner label to what runs it.

A symbol's file and an invoked script belong together when the script's path ends in the file's
basename or the file's path ends in the script's label. (The two further tests one could state,
equal label and basename, and path ending in the whole file path, follow from these.) Both are
suffix tests, so they run as equi-joins on suffixes instead of as a comparison of all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayweft.functions.strings import basename
from wayweft.functions.tokens import query_words
from wayweft.model import INDEXED_KINDS
from wayweft.operators.search import CorpusStats, search_index
from wayweft.operators.traverse import capped_neighbours
from wayweft.session import broadcast_if_small, materialise, shuffle_width


def suffixes(text: Column) -> Column:
    """Every suffix of a text, the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda n: F.right(text, n))


def file_keys(files: DataFrame, file: str = "file") -> DataFrame:
    """Join keys of files: their basename (against path endings) and their suffixes (against labels)."""
    keys = F.concat(
        F.array(F.struct(F.lit("path").alias("side"), basename(F.col(file)).alias("key"))),
        F.transform(suffixes(F.col(file)), lambda s: F.struct(F.lit("label").alias("side"), s.alias("key"))),
    )
    return files.select("*", F.explode_outer(keys).alias("_k")).filter("_k IS NOT NULL").select(*files.columns, "_k.side", "_k.key")


def script_keys(scripts: DataFrame) -> DataFrame:
    """Join keys of scripts (``label, path``): suffixes of the last path segment, and the label itself."""
    tail = basename(F.coalesce(F.col("path"), F.lit("")))
    ends = F.filter(suffixes(tail), lambda s: s != "")
    keys = F.concat(
        F.transform(ends, lambda s: F.struct(F.lit("path").alias("side"), s.alias("key"))),
        F.array(F.struct(F.lit("label").alias("side"), F.col("label").alias("key"))),
    )
    return scripts.select("*", F.explode_outer(keys).alias("_k")).filter("_k IS NOT NULL").select(*scripts.columns, "_k.side", "_k.key")


#: Rows of one side of a join key that meet in one place.
CELL = 2000
#: Files that come with each script of a cell in turn; a multiple of eight, the values that Parquet packs together.
RUN = 512
#: Most parts of either side that a task pairs.
SHARE = 16


def _crowded(left: DataFrame, right: DataFrame) -> DataFrame:
    """``side, key, _l, _r, _many``: into how many parts the rows of a key are dealt on either side, where it is more
    than one, and whether its pairs are more than a cell of full parts holds."""
    rows = lambda name: F.count("*").alias(name)
    parts = lambda name: F.ceil(F.col(name) / CELL).cast("int").alias(name)
    both = left.groupBy("side", "key").agg(rows("_l")).join(right.groupBy("side", "key").agg(rows("_r")), ["side", "key"])
    many = F.col("_l").cast("double") * F.col("_r") > CELL**2
    return both.filter((F.col("_l") > CELL) | (F.col("_r") > CELL)).select("side", "key", parts("_l"), parts("_r"), many.alias("_many"))


def _part(rows: DataFrame, parts) -> Column:
    """The part of a row by a hash, out of ``parts``."""
    return F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("side", "key")]), parts).cast("int")


def _dealt(rows: DataFrame, crowded: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with ``_own`` part by a hash, once for each part of the other side; keys of many pairs are left out."""
    number = lambda name: F.coalesce(name, F.lit(1))
    met = rows.join(crowded, ["side", "key"], "left").filter(~F.coalesce("_many", F.lit(False)))
    cells = F.sequence(F.lit(0), number(other) - 1)
    return met.select(*rows.columns, _part(rows, number(own)).alias(own + "n"), F.explode_outer(cells).alias(other + "n"))


def _runs(rows: DataFrame, many: DataFrame) -> DataFrame:
    """``side, key, _run``: rows of the given keys in arrays of ``RUN``, of fewer in whole eights, and of what is left of a part."""
    inside = F.struct(*[c for c in rows.columns if c not in ("side", "key")])
    part = _part(rows, F.col("_l")).alias("_n")
    packs = rows.join(many, ["side", "key"]).groupBy("side", "key", part).agg(F.collect_list(inside).alias("_rows"))
    whole = F.size("_rows") - F.size("_rows") % 8
    starts = F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0)), F.lit(RUN))
    runs = F.transform(starts, lambda i: F.slice("_rows", i + 1, F.least(F.lit(RUN), whole - i)))
    cut = F.filter(F.concat(runs, F.array(F.slice("_rows", whole + 1, F.lit(7)))), lambda run: F.size(run) > 0)
    return packs.select("side", "key", F.explode_outer(cut).alias("_run"))


def _all_pairs(left: DataFrame, right: DataFrame, crowded: DataFrame) -> DataFrame | None:
    """The pairs of the keys of many pairs, if there are any.

    Both sides are stored once, and every task reads a share of either and pairs what has one key, so no row is
    copied for the tasks. For each script in turn come the files of a run: the columns of scripts repeat one
    value and the files repeat in step, which columnar files hold in a small part of the room that shuffled
    pairs take. Keys are compared once for a run and a script: with n keys of one size that is n / ``RUN`` for a pair.
    """
    many = crowded.filter("_many")
    l_parts, r_parts = many.agg(F.sum("_l"), F.sum("_r")).first()
    if l_parts is None:
        return None
    share = min(SHARE, max(1, int((l_parts * r_parts / (4 * shuffle_width(left.sparkSession))) ** 0.5)))
    many = broadcast_if_small(many.select("side", "key", "_l"))
    files = materialise(_runs(left, many).repartition(math.ceil(l_parts / share)))
    scripts = materialise(right.join(many.drop("_l"), ["side", "key"]).repartition(math.ceil(r_parts / share)))
    met = files.hint("shuffle_replicate_nl").join(scripts.hint("shuffle_replicate_nl"), ["side", "key"])
    return met.withColumn("_run", F.explode_outer("_run")).select("_run.*", *right.columns)


def match_files_to_scripts(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """All matching pairs of ``files`` (column ``file``) and ``scripts`` (``script_id, label, path``), each once.

    Either side of the test finds a pair at most once, and what the path side finds the label side leaves
    out, so pairs are not compared again. A key of many rows is dealt into cells of ``CELL`` by ``CELL``
    rows; no task has to make all its pairs. There are at most as many such keys as rows by ``CELL``. A row is
    copied for at most one part of the other side as full as its own; beyond that, runs of rows are paired.
    """
    left = file_keys(files.distinct())
    right = script_keys(scripts.distinct())
    crowded = materialise(_crowded(left, right))
    known = broadcast_if_small(crowded)
    place = ["side", "key", "_ln", "_rn"]
    pairs = _dealt(left, known, "_l", "_r").join(_dealt(right, known, "_r", "_l"), place).drop("_ln", "_rn")
    rest = _all_pairs(left, right, crowded)
    pairs = pairs if rest is None else pairs.unionByName(rest)
    name, tail = basename(F.col("file")), basename(F.coalesce("path", F.lit("")))
    again = (F.col("side") == "label") & (name != "") & tail.endswith(name)
    return pairs.filter(~again).drop("side", "key")


def symbol_files(edges: DataFrame) -> DataFrame:
    """``id, file, first_ord``: the file that last defines a symbol, and when it was first defined."""
    return (
        edges.filter(
            (F.col("kind") == "defines")
            & F.col("source").startswith("file:")
            & F.col("target").startswith("code_symbol:")
        )
        .groupBy(F.col("target").alias("id"))
        .agg(
            F.expr("substring(max_by(source, ord), 6)").alias("file"),
            F.min("ord").alias("first_ord"),
        )
    )


def invocations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Script invocations with the attributes of both ends; unknown targets are dropped."""
    target = nodes.select(
        F.col("id").alias("script_id"), F.col("label").alias("script_label"),
        F.coalesce("path", F.lit("")).alias("script_path"),
    )
    source = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("_label"))
    calls = edges.filter((F.col("kind") == "invokes") & F.col("target").startswith("script:")).select(
        F.col("source").alias("source_id"), F.col("target").alias("script_id"),
        F.coalesce(F.col("metadata")["command"], F.lit("")).alias("command"), F.col("ord").alias("inv_ord"),
    )
    return calls.join(target, "script_id").join(source, "source_id", "left").select(
        "*", F.coalesce("_label", "source_id").alias("source_label")
    ).drop("_label")


def _top(df: DataFrame, keys: list[str], order: list, n: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def trace_candidates(
    nodes: DataFrame, symbols: DataFrame, post: DataFrame, stats: CorpusStats, queries: list[str], limit: int
) -> DataFrame:
    """``qid, id, kind, cand, place``: best index rows per query, or, for a query without any, matching symbols.

    The index is asked for four times the limit (64 at least). The substring pass sees only symbols
    with a defining file, in definition order, and is not cut; its rows have ``cand`` 0. ``place``
    orders the candidates of a query without numbering them.
    """
    ord_type = symbols.schema["first_ord"].dataType
    indexed = nodes.filter(F.col("kind").isin(*INDEXED_KINDS)).select("id", "kind", "ord")
    found = search_index(post, "id", queries, stats, require_all=True).join(indexed, "id")
    listed = _top(found, ["qid"], ["score", "ord"], max(limit * 4, 64), "cand")
    place = F.struct(F.col("cand").alias("n"), F.lit(None).cast(ord_type).alias("ord"), F.lit(None).cast("string").alias("id"))
    ranked = materialise(listed.select("qid", "id", "kind", "cand", place.alias("place")))
    answered = {r.qid for r in ranked.select("qid").distinct().collect()}
    missed = [(i, q.strip().lower()) for i, q in enumerate(queries) if i not in answered and q.strip()]
    if not missed:
        return ranked
    labels = nodes.select("id", F.lower("label").alias("_label"))
    pool = symbols.join(labels, "id", "left")
    hits = [
        F.when(
            F.coalesce(F.contains("_label", F.lit(q)), F.lit(False)) | F.contains(F.lower("id"), F.lit(q)), F.lit(i)
        )
        for i, q in missed
    ]
    loose = pool.select("id", "first_ord", F.explode_outer(F.array_compact(F.array(*hits))).alias("qid")).filter("qid IS NOT NULL")
    place = F.struct(F.lit(0).alias("n"), F.col("first_ord").alias("ord"), F.col("id").alias("id"))
    return ranked.unionByName(
        loose.select("qid", "id", F.lit("code_symbol").alias("kind"), F.lit(0).alias("cand"), place.alias("place"))
    )


def symbol_chains(
    candidates: DataFrame, symbols: DataFrame, nodes: DataFrame, calls: DataFrame, limit: int
) -> DataFrame:
    """First ``limit`` chains per query from code symbols to script invocations.

    A query needs at most ``limit`` candidates that match anything, and per join key at most ``limit``
    invocations, so both sides are cut (exactly) before they meet and hot names cannot multiply.
    """
    known = nodes.select("id", F.col("label").alias("symbol_label"), F.col("kind").alias("symbol_kind"))
    code = candidates.filter(F.col("kind") == "code_symbol").select("qid", "id", "cand", "place")
    code = code.join(symbols.select("id", "file"), "id").join(known, "id")
    scripts = calls.select("script_id", F.col("script_label").alias("label"), F.col("script_path").alias("path")).distinct()
    keyed_scripts = script_keys(scripts).select("script_id", "side", "key")
    matched = (
        file_keys(code)
        .join(keyed_scripts.select("side", "key").distinct(), ["side", "key"], "left_semi")
        .select(*code.columns)
        .distinct()
    )
    needed = materialise(_top(matched, ["qid"], ["place"], limit, "_n").drop("_n"))
    needed_keys = file_keys(needed)
    wanted = keyed_scripts.join(needed_keys.select("side", "key").distinct(), ["side", "key"], "left_semi")
    by_key = calls.join(wanted, "script_id")
    heads = _top(by_key, ["side", "key"], ["inv_ord"], limit, "_n").drop("_n")
    pairs = needed_keys.join(heads, ["side", "key"]).drop("side", "key")
    pairs = pairs.dropDuplicates(["qid", "id", "source_id", "script_id"])
    return _top(pairs, ["qid"], ["place", "inv_ord"], limit, "pos")


def trace(
    nodes: DataFrame, edges: DataFrame, post: DataFrame, stats: CorpusStats, queries: list[str], limit: int = 10
) -> DataFrame:
    """Matches per query: ``qid, pos, cand, match_kind, node, chain, incoming, outgoing``.

    Symbol chains come first, then runners (workflow parts, targets, scripts, modules) with at most
    20 neighbours per direction, up to ``limit`` rows per query.
    """
    symbols = symbol_files(edges)
    cands = materialise(trace_candidates(nodes, symbols, post, stats, queries, limit))
    chains = symbol_chains(cands, symbols, nodes, invocations(nodes, edges), limit)
    attrs = nodes.select("id", "label", F.coalesce("path", F.lit("")).alias("path"))
    runners = cands.filter(F.col("kind") != "code_symbol").join(attrs, "id")
    chain = F.struct(
        "file", "source_id", "source_label", "script_id", "script_label", "script_path", "command"
    )
    chain_rows = chains.select(
        "qid", F.lit(0).alias("phase"), "cand", "pos", F.lit("code_symbol_chain").alias("match_kind"),
        F.struct("id", F.col("symbol_label").alias("label"), F.col("symbol_kind").alias("kind"), F.col("file").alias("path")).alias("node"),
        chain.alias("chain"),
    )
    runner_kind = (
        F.when(F.col("kind").isin("workflow", "workflow_job", "workflow_step"), "ci_runner")
        .when(F.col("kind") == "target", "build_target")
        .when(F.col("kind") == "script", "script")
        .otherwise("module")
    )
    runner_rows = runners.select(
        "qid", F.lit(1).alias("phase"), "cand", F.col("cand").alias("pos"), runner_kind.alias("match_kind"),
        F.struct("id", "label", "kind", "path").alias("node"),
    )
    rows = chain_rows.unionByName(runner_rows, allowMissingColumns=True)
    order = Window.partitionBy("qid").orderBy("phase", "pos")
    final = materialise(
        rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)
    )
    centres = final.filter(F.col("phase") == 1).select("node.id").distinct()
    near = capped_neighbours(edges, nodes, centres)
    side = F.struct("pos", "edge_kind", "other_id", "other_label", "other_kind", "other_path", "command")
    folded = near.groupBy("id").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("direction") == d, side))).alias(d)
            for d in ("incoming", "outgoing")
        ]
    )
    return final.withColumn("id", F.when(F.col("phase") == 1, F.col("node.id"))).join(folded, "id", "left").drop("id", "phase")


def has_words(query: str) -> bool:
    return bool(query_words(query))
