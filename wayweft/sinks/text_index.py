"""Inverted indexes as stored tables: blocks of postings in segments, under versions.

A block holds up to ``BLOCK`` postings of one term: arrays of keys, of term counts and of row lengths,
and what bounds their scores, the largest count and the smallest length. The tasks that read the rows count
their words and make short lists; one range shuffle of these by term and weight makes the blocks, so a
term that most rows hold is spread over many tasks and blocks, the heavy ones first. Added rows become a new segment; segments of one size class are merged ``FAN`` at
a time from their blocks, no text is read again. Searches filter the term column at the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayweft.functions.porter import stem as stem_of
from wayweft.functions.tokens import query_words
from wayweft.operators import search
from wayweft.session import materialise
from wayweft.sinks.versions import Versions

BLOCK = 1024
FAN = 4
#: Tokens, or postings, that a task works on at a time.
STRETCH = 1 << 22
#: Postings of a list before the shuffle, short so that a batch of them stays small.
PIECE = 256
#: Blocks of each query word, heaviest first, whose rows set the bar that other blocks must reach.
PROBED = 8
#: Bounds may fall short of sums in another order by this much.
SLACK = 1e-9


def _stretches(batches, column: str, most: int):
    """Rows in turn, as lists of batches whose lists in ``column`` have at most ``most`` items together, or one row."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, done + most - size, "right"))
            if end <= begin and held:
                yield held
                held, size = [], 0
                continue
            end = max(end, begin + 1)
            held.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1] - done)
            begin = end
    if held:
        yield held


def _column(held: list[pa.RecordBatch], name: str) -> pa.Array:
    return pa.concat_arrays([b.column(name) for b in held])


def _cut(names: pa.Array, term: np.ndarray, columns: dict[str, pa.Array], most: int) -> pa.RecordBatch:
    """Postings as blocks of one term, the heaviest first, at most ``most`` in each; ``term`` is the place in ``names``."""
    tf, dl = columns["tfs"].to_numpy(), columns["dls"].to_numpy()
    order = np.lexsort((-tf / (tf + dl / 64.0), term))
    term, tf, dl = term[order], tf[order], dl[order]
    new = np.flatnonzero(np.diff(term, prepend=-1))
    place = np.arange(len(term)) - np.repeat(new, np.diff(np.append(new, len(term))))
    heads = np.flatnonzero(place % most == 0)
    cuts = np.append(heads, len(term)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(cuts), c.take(pa.array(order))) for c in columns.values()]
    bounds = [pa.array(np.diff(cuts)), pa.array(np.maximum.reduceat(tf, heads)), pa.array(np.minimum.reduceat(dl, heads))]
    return pa.RecordBatch.from_arrays([names.take(pa.array(term[heads])), *bounds, *lists], ["term", "n", "max_tf", "min_dl", *columns])


def _kind(key: T.DataType) -> T.StructType:
    whole = T.IntegerType()
    lists = [("keys", T.ArrayType(key)), ("tfs", T.ArrayType(whole)), ("dls", T.ArrayType(whole))]
    return T.StructType([T.StructField(n, t) for n, t in [("term", T.StringType()), ("n", whole), ("max_tf", whole), ("min_dl", whole), *lists]])


def _once(tok: DataFrame, key: str) -> tuple[DataFrame, Observation | None]:
    """``key, tokens, dl`` of all rows, with what counts them on the way.

    If a key occurs twice at all, rows of one key and length become one row; these are not counted on
    the way, as tasks before a shuffle may run twice.
    """
    rows = tok.select(F.col(key).alias("key"), "tokens", F.col("dl").cast("int").alias("dl"))
    if tok.groupBy(key).count().where("count > 1").limit(1).count():
        return rows.groupBy("key", "dl").agg(F.flatten(F.collect_list("tokens")).alias("tokens")), None
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("rows"), F.sum("dl").alias("tokens")), seen


def _pieces(rows: DataFrame, stem: bool) -> DataFrame:
    """Short blocks of the postings of one stretch of ``key, tokens, dl`` rows at a time, made by the tasks that read them.

    A row's words are counted where the row is, so no token is shuffled. Stems are made of a stretch's
    distinct words; words of one stem are then folded within it, as a row lies in one stretch whole.
    """
    stretch, piece = STRETCH, PIECE

    def count(batches):
        for number, held in enumerate(_stretches(batches, "tokens", stretch)):
            tokens, dl = _column(held, "tokens"), _column(held, "dl")
            row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            if not len(row):
                continue
            coded = tokens.flatten().dictionary_encode()
            at = np.sort(coded.indices.to_numpy().astype(np.int64) << 32 | row)
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            tf, row = np.diff(np.append(heads, len(at))).astype(np.int32), pa.array((at[heads] & 0xFFFFFFFF).astype(np.int32))
            columns = {"keys": _column(held, "key").take(row), "tfs": pa.array(tf), "dls": dl.take(row)}
            out = _cut(coded.dictionary, at[heads] >> 32, columns | {"rows": row} if stem else columns, piece)
            yield out.append_column("stretch", pa.array(np.full(out.num_rows, number, np.int32))) if stem else out

    def fold(batches):
        for held in _stretch_by_stretch(batches):
            coded = _column(held, "term").dictionary_encode()
            lists = {c: _column(held, c) for c in ("keys", "tfs", "dls", "rows")}
            term = np.repeat(coded.indices.to_numpy().astype(np.int64), lists["rows"].value_lengths().to_numpy())
            at = term << 32 | lists.pop("rows").flatten().to_numpy()
            order = np.argsort(at)
            at = at[order]
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            first = pa.array(order[heads])
            tf = np.add.reduceat(lists["tfs"].flatten().to_numpy()[order], heads).astype(np.int32)
            columns = {"keys": lists["keys"].flatten().take(first), "tfs": pa.array(tf), "dls": lists["dls"].flatten().take(first)}
            yield _cut(coded.dictionary, at[heads] >> 32, columns, piece)

    kind = _kind(rows.schema["key"].dataType)
    if not stem:
        return rows.mapInArrow(count, kind)
    whole = T.IntegerType()
    words = rows.mapInArrow(count, T.StructType([*kind.fields, T.StructField("rows", T.ArrayType(whole)), T.StructField("stretch", whole)]))
    return words.withColumn("term", stem_of("term")).mapInArrow(fold, kind)


def _stretch_by_stretch(batches):
    """The batches of each stretch; its rows follow one another."""
    held = []
    for batch in batches:
        number = batch.column("stretch").to_numpy()
        cuts = np.flatnonzero(np.diff(number)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(number)]):
            if held and len(number) and held[0].column("stretch")[0].as_py() != number[begin]:
                yield held
                held = []
            if end > begin:
                held.append(batch.slice(begin, end - begin))
    if held:
        yield held


def _blocks(pieces: DataFrame) -> DataFrame:
    """``term, n, max_tf, min_dl, keys, tfs, dls`` of shorter or older blocks, sorted by term within files."""
    block, stretch = BLOCK, STRETCH
    weight = -F.col("tfs")[0] / (F.col("tfs")[0] + F.col("dls")[0] / 64.0)
    near = pieces.select("term", "keys", "tfs", "dls", weight.alias("weight"))
    near = near.repartitionByRange("term", "weight", F.xxhash64("keys")).sortWithinPartitions("term", "weight").drop("weight")

    def blocks(held):
        coded = _column(held, "term").dictionary_encode()
        lists = {c: _column(held, c) for c in ("keys", "tfs", "dls")}
        term = np.repeat(coded.indices.to_numpy(), lists["tfs"].value_lengths().to_numpy())
        return _cut(coded.dictionary, term, {c: x.flatten() for c, x in lists.items()}, block)

    def run(batches):
        left = []
        for held in _stretches(batches, "tfs", stretch):
            held = left + held
            # The last term may go on.
            same = [pc.equal(b.column("term"), held[-1].column("term")[-1]).to_numpy(zero_copy_only=False) for b in held]
            done = [b.filter(pa.array(~x)) for b, x in zip(held, same)]
            if any(b.num_rows for b in done):
                left = [b.filter(pa.array(x)) for b, x in zip(held, same)]
                yield blocks(done)
            else:
                left = []
                yield blocks(held)
        if left:
            yield blocks(left)

    return near.mapInArrow(run, _kind(pieces.schema["keys"].dataType.elementType))


def append(spark: SparkSession, folder: str, tok: DataFrame, key: str, stem: bool = False) -> "TextIndex":
    """Add the rows of ``tok`` (key, tokens, dl; keys not in the index yet) and commit; merges segments when many have one size.

    A reader of an older version keeps what it had. A writer that meets another one's commit gets
    ``Conflict`` and can try again; its segment is then named by no version.
    """
    versions = Versions(spark, folder)
    now = versions.current()
    if now.number and (now.state["key"], now.state["stem"]) != (key, stem):
        raise ValueError(f"{folder} has key {now.state['key']} and stem {now.state['stem']}")
    rows, seen = _once(tok, key)
    # Stored, as a range shuffle reads its rows twice.
    pieces = materialise(_pieces(rows, stem))
    # A plan that is found to be empty counts nothing.
    counted = seen.get if seen and not pieces.isEmpty() else None
    stats = search.CorpusStats(counted["rows"], counted["tokens"]) if counted else search.CorpusStats.of(tok)
    place = versions.new_place("segment")
    _blocks(pieces).write.parquet(place)
    segments = [*now.state.get("segments", []), {"name": place.rpartition("/")[2], "level": 0, "rows": stats.rows, "tokens": stats.tokens}]
    while same := _crowded(segments):
        place = versions.new_place("segment")
        _blocks(_read(spark, folder, same)).write.parquet(place)
        total = {c: sum(s[c] for s in same) for c in ("rows", "tokens")}
        segments = [s for s in segments if s not in same] + [{"name": place.rpartition("/")[2], "level": same[0]["level"] + 1, **total}]
    versions.commit({"key": key, "stem": stem, "segments": segments}, now.number)
    return TextIndex.open(spark, folder)


def _crowded(segments: list[dict]) -> list[dict]:
    """The segments of the lowest size class that holds ``FAN`` of them."""
    levels = [s["level"] for s in segments]
    full = [level for level in sorted(set(levels)) if levels.count(level) >= FAN]
    return [s for s in segments if s["level"] == full[0]] if full else []


def _read(spark: SparkSession, folder: str, segments: list[dict]) -> DataFrame:
    return spark.read.parquet(*[f"{folder.rstrip('/')}/{s['name']}" for s in segments])


def _postings(blocks: DataFrame, key: str) -> DataFrame:
    each = F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p")
    return blocks.select("term", each).select("term", F.col("p.keys").alias(key), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"))


@dataclass(frozen=True)
class TextIndex:
    """One version of a stored index."""

    key: str
    stem: bool
    stats: search.CorpusStats
    blocks: DataFrame

    @staticmethod
    def open(spark: SparkSession, folder: str) -> "TextIndex | None":
        """The newest version, or None where there is no index."""
        now = Versions(spark, folder).current()
        if not now.number:
            return None
        s = now.state
        stats = search.CorpusStats(sum(x["rows"] for x in s["segments"]), sum(x["tokens"] for x in s["segments"]))
        return TextIndex(s["key"], s["stem"], stats, _read(spark, folder, s["segments"]))

    @property
    def postings(self) -> DataFrame:
        """``term, <key>, tf, dl``; a filter on the term reaches the scan."""
        return _postings(self.blocks, self.key)

    def search(self, queries: list[str], require_all: bool) -> DataFrame:
        """Scores ``qid, <key>, score`` of all matching rows; lower is better."""
        return search.search_index(self.postings, self.key, queries, self.stats, require_all, self.stem)

    def _prefixes(self, query: str) -> list[str]:
        found = query_words(query)
        return search.stem_words(self.blocks.sparkSession, found) if self.stem else found

    def top(self, query: str, k: int) -> DataFrame:
        """``<key>, score`` of the ``k`` best rows with any of the words, ties by key; as ``search`` has them, but most blocks stay closed.

        The rows of each word's heaviest blocks give a bar: the k-th best of their scores, counting these
        blocks alone. A block is opened when its own bound and the largest bounds of the other words
        together reach the bar. Every block of a row that belongs to the result does, so its score is whole.
        """
        prefixes = self._prefixes(query)
        spark = self.blocks.sparkSession
        if not prefixes:
            return self.postings.select(self.key, F.lit(0.0).alias("score")).limit(0)
        post = self.postings
        hits = search.index_hits(post.select("term", self.key, F.lit(1).alias("tf"), F.lit(1).alias("dl")), self.key, [prefixes])
        found = {r.slot: r.n for r in hits.groupBy("slot").agg(F.count("*").alias("n")).collect()}
        mean = F.lit(self.stats.tokens / max(self.stats.rows, 1))
        idf = spark.createDataFrame([(i, found.get(i, 0)) for i in range(len(prefixes))], "slot int, n long")
        idf = idf.select("slot", search.idf(F.lit(float(self.stats.rows)), F.col("n")).alias("idf"))
        weights = {r.slot: r.idf for r in idf.collect()}

        def of_slot(c: Column) -> Column:
            return F.element_at(F.create_map(*[F.lit(x) for item in weights.items() for x in item]), c)

        slots = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(i)) for i, p in enumerate(prefixes)]))
        near = self.blocks.where(search.any_prefix(F.col("term"), sorted(set(prefixes))))
        heads = near.select("term", "max_tf", "min_dl", F.explode(slots).alias("slot"))
        bound = search.gain(of_slot(F.col("slot")), F.col("max_tf"), F.col("min_dl"), mean)
        # A word's gain from several terms is at most the sum of theirs, and never above its limit.
        most = heads.withColumn("bound", bound).groupBy("slot", "term").agg(F.max("bound").alias("bound"))
        most = {r.slot: r for r in most.groupBy("slot").agg(F.sum("bound").alias("bound"), F.count("*").alias("terms")).collect()}
        limit = {i: min(r.bound, weights[i] * (search.K1 + 1)) for i, r in most.items()}
        if not limit:
            return post.select(self.key, F.lit(0.0).alias("score")).limit(0)

        def scored(blocks: DataFrame) -> DataFrame:
            part = search.index_hits(_postings(blocks, self.key), self.key, [prefixes])
            value = search.gain(of_slot(F.col("slot")), F.col("tf"), F.col("dl"), mean)
            return part.groupBy(self.key).agg((-F.sum(value)).alias("score"))

        ranked = []
        for i, p in enumerate(prefixes):
            own = near.where(F.col("term").startswith(p)).withColumn("slot", F.lit(i))
            ranked.append(own.withColumn("bound", bound).orderBy(F.col("bound").desc(), "term").limit(PROBED).drop("slot", "bound"))
        probe = ranked[0]
        for other in ranked[1:]:
            probe = probe.unionByName(other)
        bar = scored(probe.distinct()).orderBy("score").limit(k).agg(F.count("*").alias("n"), F.max("score").alias("bar")).first()
        if bar.n >= k:
            reach = []
            for i, p in enumerate(prefixes):
                if i in limit:
                    own = search.gain(F.lit(weights[i]), F.col("max_tf"), F.col("min_dl"), mean)
                    whole = F.least(F.lit(limit[i]), own + (limit[i] if most[i].terms > 1 else 0.0)) + (sum(limit.values()) - limit[i])
                    reach.append(F.when(F.col("term").startswith(p), whole).otherwise(0.0))
            near = near.where(F.greatest(F.lit(0.0), *reach) >= -bar.bar - SLACK)
        return scored(near).orderBy(F.round("score", 9), self.key).limit(k)
