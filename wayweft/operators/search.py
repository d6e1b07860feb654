"""BM25 search with prefix terms, over a stored inverted index or straight over a table.

An index is a DataFrame of postings ``term, <key>, tf, dl`` where ``dl`` is the number of indexed
tokens of the row. Sorted by term, a prefix search reads only the matching row groups of its files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions.porter import stem as stem_of
from wayweft.functions.porter import stem_column
from wayweft.functions.tokens import query_words, words
from wayweft.session import broadcast_if_small, materialise, shuffle_width

# BM25 parameters, and the floor for the idf of a term most rows contain.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


def tokenised(rows: DataFrame, *texts: str) -> DataFrame:
    """Add ``tokens`` (of all text columns together) and their number ``dl``."""
    cells = [words(F.coalesce(F.col(t), F.lit(""))) for t in texts]
    tokens = cells[0] if len(cells) == 1 else F.concat(*cells)
    return rows.withColumn("tokens", tokens).withColumn("dl", F.size("tokens"))


def postings(tok: DataFrame, key: str, stem: bool = False) -> DataFrame:
    """``term, <key>, tf, dl``; repeats of a term in a row are folded before any shuffle.

    Stemming works on the distinct words, which grow far slower than the postings, and goes back by
    a join on the word; the postings need that spread by word anyway when an index is written.
    """
    terms = tok.select(key, "dl", F.explode_outer("tokens").alias("term")).filter("term IS NOT NULL")
    counted = terms.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    if stem:
        width = shuffle_width(tok.sparkSession)
        vocabulary = terms.select("term").distinct().repartition(width).withColumn("_stem", stem_of("term"))
        stemmed = counted.join(vocabulary, "term").select(F.col("_stem").alias("term"), key, "dl", "tf")
        counted = stemmed.groupBy("term", key, "dl").agg(F.sum("tf").alias("tf"))
    return counted.select("term", key, "tf", "dl")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def stem_words(spark, tokens: list[str]) -> list[str]:
    """Stems of a few query words, in order."""
    if not tokens:
        return []
    frame = spark.createDataFrame(list(enumerate(tokens)), "i int, w0 string")
    return [r.w0 for r in sorted(stem_column(frame, "w0").collect(), key=lambda r: r.i)]


def any_prefix(term: Column, prefixes: list[str]) -> Column:
    keep = term.startswith(prefixes[0])
    for p in prefixes[1:]:
        keep = keep | term.startswith(p)
    return keep


def index_hits(post: DataFrame, key: str, queries: list[list[str]]) -> DataFrame:
    """Matches ``qid, slot, <key>, tf, dl`` from an index, for several queries in one pass.

    ``queries`` holds the prefixes of each query; ``slot`` is the place of a word in its query. The
    prefixes reach the scan as a pushed-down filter on the sorted term column.
    """
    slots = [
        F.when(F.col("term").startswith(p), F.struct(F.lit(q).alias("qid"), F.lit(i).alias("slot")))
        for q, prefixes in enumerate(queries)
        for i, p in enumerate(prefixes)
    ]
    near = post.filter(any_prefix(F.col("term"), sorted({p for ps in queries for p in ps})))
    spread = near.select(key, "tf", "dl", F.explode_outer(F.array_compact(F.array(*slots))).alias("_at")).filter("_at IS NOT NULL")
    return spread.groupBy("_at.qid", "_at.slot", key).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


@dataclass(frozen=True)
class CorpusStats:
    """Row count and token total of an index."""

    rows: int
    tokens: int

    @staticmethod
    def of(tok: DataFrame) -> "CorpusStats":
        row = tok.agg(F.count("*").alias("n"), F.sum("dl").alias("t")).first()
        return CorpusStats(row.n, row.t or 0)


def idf(rows: Column, matching: Column) -> Column:
    raw = F.log((rows - matching + 0.5) / (matching + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def gain(idf: Column, tf: Column, dl: Column, mean: Column) -> Column:
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / mean))


def bm25(hits: DataFrame, key: str, stats: CorpusStats, queries: list[list[str]], require_all: bool) -> DataFrame:
    """Score ``qid, <key>, score``; lower is better. A query word given twice counts twice.

    The number of matching rows per query word is one row per word of the request, so the join back
    broadcasts a few rows whatever the size of the index. Matches are stored, as they are read twice.
    """
    hits = materialise(hits)
    spread = hits.groupBy("qid", "slot").agg(F.count("*").alias("_n"))
    rarity = spread.select("qid", "slot", idf(F.lit(float(stats.rows)), F.col("_n")).alias("_idf"))
    mean = F.lit(stats.tokens / max(stats.rows, 1))
    value = gain(F.col("_idf"), F.col("tf"), F.col("dl"), mean)
    scored = hits.join(F.broadcast(rarity), ["qid", "slot"]).groupBy("qid", key).agg(
        (-F.sum(value)).alias("score"), F.count("*").alias("_slots")
    )
    if require_all:
        sizes = F.create_map(*[F.lit(x) for q, ps in enumerate(queries) for x in (q, len(ps))])
        scored = scored.filter(F.col("_slots") == sizes[F.col("qid")])
    return scored.select("qid", key, "score")


def _starts(prefix: str):
    return lambda token: token.startswith(prefix)


def scan_scores(tok: DataFrame, key: str, query: str, require_all: bool) -> DataFrame:
    """Scores of an ad-hoc search over a tokenised table, without an index and without a shuffle.

    One pass shrinks every text to its length and its counts of the query words; that small table is
    kept, one aggregation over it gives the corpus figures (a single row), and a projection the score.
    """
    prefixes = query_words(query)
    if not prefixes:
        return tok.select(key, F.lit(0.0).alias("score")).limit(0)
    counts = [F.size(F.filter("tokens", _starts(p))) for p in prefixes]
    small = materialise(tok.select(key, "dl", F.array(*counts).alias("tf")))
    hit = [F.col("tf")[i] > 0 for i in range(len(prefixes))]
    figures = small.agg(
        F.count("*").alias("rows"), F.sum("dl").alias("tokens"),
        *[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hit)],
    ).first()
    rows, mean = F.lit(float(figures.rows)), F.lit((figures.tokens or 0) / max(figures.rows, 1))
    score, keep = F.lit(0.0), None
    for i, h in enumerate(hit):
        score = score - gain(idf(rows, F.lit(float(figures[f"n{i}"]))), F.col("tf")[i], F.col("dl"), mean)
        keep = h if keep is None else (keep & h if require_all else keep | h)
    return small.filter(keep).select(key, score.alias("score"))


def stem_scan_scores(tok: DataFrame, key: str, query: str, require_all: bool) -> DataFrame:
    """Scores of an ad-hoc stemmed search over a tokenised table, without an index.

    The distinct words that begin like a query word are stemmed once and cut down to those whose stem
    starts with one; only these meet the rows' words, before anything is shuffled by row.
    """
    prefixes = stem_words(tok.sparkSession, query_words(query))
    if not prefixes:
        return tok.select(key, F.lit(0.0).alias("score")).limit(0)
    # A stem keeps its word's first letter.
    near_word = F.substring("word", 1, 1).isin(sorted({p[0] for p in prefixes}))
    words = tok.select(key, "dl", F.explode_outer("tokens").alias("word")).filter(near_word)
    terms = words.select("word").distinct().repartition(shuffle_width(tok.sparkSession))
    # Unnested from a list of one: a test on a plain column would move below the distinct words and stem every token.
    terms = terms.select("word", F.explode_outer(F.array(stem_of("word"))).alias("term"))
    wanted = broadcast_if_small(materialise(terms.filter(any_prefix(F.col("term"), sorted(set(prefixes))))))
    near = words.join(wanted, "word").groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return bm25(index_hits(near, key, [prefixes]), key, CorpusStats.of(tok), [prefixes], require_all).drop("qid")


def search_index(
    post: DataFrame, key: str, queries: list[str], stats: CorpusStats, require_all: bool, stem: bool = False
) -> DataFrame:
    """Scores ``qid, <key>, score`` of several searches over an index; a query without words matches nothing."""
    prefixes = [query_words(q) for q in queries]
    if stem:
        flat = iter(stem_words(post.sparkSession, [w for ws in prefixes for w in ws]))
        prefixes = [[next(flat) for _ in ws] for ws in prefixes]
    if not any(prefixes):
        return post.select(F.lit(0).alias("qid"), key, F.lit(0.0).alias("score")).limit(0)
    return bm25(index_hits(post, key, prefixes), key, stats, prefixes, require_all)
