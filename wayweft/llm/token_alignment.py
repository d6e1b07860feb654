"""Alignment of two tokenizers' tokens over a corpus.

Both tokenizers cut the same bytes, so the offsets where tokens of both end cut a text into groups,
and every token of one side is linked to every token of the other within its group. An array says for
each id of the first vocabulary which id of the second has the same bytes: links of such a pair are
counted in vectors as long as the vocabulary, in each task. All other pairs of ids, which come from
irregular groups, are pre-aggregated and counted in a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.llm.words import slices
from wayweft.session import materialise

FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Irregular pairs whose counts every task holds (12 bytes each); the documents' other pairs are joined.
HELD_PAIRS = 1 << 20
#: Expanded pairs of ids, or counts gathered, that a task works on at a time.
PART = 1 << 20
# Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that long overflow the fast encoder's matcher; such texts take the reference one.
LONG_GAP = re.compile(r"\s{5000}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """Both tokenizers and, for each id, its bytes; made once a Python worker from the files' contents."""

    def __init__(self, first: bytes, second: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(first)
        letters = _byte_letters()
        special = {t["id"] for t in spec["added_tokens"]}
        by_id = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self._json = first
        self._slow = None
        self._fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks={b: i for i, b in by_id.items()}, special_tokens={})
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=second)
        n = self._pieces.get_piece_size()
        if max(n, len(by_id)) > 1 << 16:
            raise ValueError("a pair of ids is counted as 2 x 16 bits; larger vocabularies need wider keys")
        self.tokens_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.tokens_b = [self._piece_bytes(self._pieces.id_to_piece(i), self._pieces.is_byte(i)) for i in range(n)]
        whole = {b: i for i, b in reversed([*enumerate(self.tokens_b)]) if not self._pieces.is_byte(i)}
        single = {b: i for i, b in enumerate(self.tokens_b) if self._pieces.is_byte(i)}
        #: For each id of A the id of B with the same bytes, a plain piece before a byte's; -1 where there is none.
        self.same = np.array([whole.get(b, single.get(b, -1)) if b else -1 for b in self.tokens_a], np.int32)

    @staticmethod
    def _piece_bytes(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        if not LONG_GAP.search(text):
            return self._fast.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._json.decode())
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode_b(self, text: str) -> list[int]:
        return self._pieces.encode(text, num_threads=1)


@lru_cache(1)
def vocabularies(first: bytes, second: bytes) -> Vocabularies:
    return Vocabularies(first, second)


class _Bytes:
    """The bytes of a vocabulary in one array."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.arange(sizes.sum()) + np.repeat(shift, sizes)]


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each of ``sizes``."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the weights of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else order
    return keys[heads], np.add.reduceat(weights[order], heads) if len(keys) else weights


class Aligner:
    """Aligns the texts of a batch at once; arrays of tokens, no Python step a token but in the encoders."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.a, self.b = _Bytes(v.tokens_a), _Bytes(v.tokens_b)
        names = [str(i) for i in range(max(len(v.tokens_a), len(v.tokens_b)))]
        self.names = np.array([[n + end for n in names] for end in (",", "|", ";")], object)

    def _encoded(self, texts: list[str | None]) -> tuple:
        """Ids and bounds of both sides for texts whose joined tokens give space and text back, none for others."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        ids, bounds = [], []
        for encode, table, lead in ((self.v.encode_a, self.a, " "), (self.v.encode_b, self.b, "")):
            lists = [encode(lead + t) if t else [] for t in texts]
            ids.append([np.array(x, np.int64) for x in lists])
        good = np.array([len(r) > 0 and all(t.sizes[x[i]].sum() == len(r) for t, x in zip((self.a, self.b), ids)) for i, r in enumerate(raw)], bool)
        for side, table in enumerate((self.a, self.b)):
            at = np.flatnonzero(good)
            if not len(at):
                break
            want = np.frombuffer(b"".join(raw[i] for i in at), np.uint8)
            wrong = table.joined(np.concatenate([ids[side][i] for i in at])) != want
            ends = np.cumsum([len(raw[i]) for i in at])
            good[at] = np.diff(np.append(0, np.cumsum(wrong)[ends - 1])) == 0
        none = np.zeros(0, np.int64)
        out = []
        for side in ids:
            kept = [x if g else none for x, g in zip(side, good)]
            out.append((np.concatenate([none, *kept]), np.append(0, np.cumsum([*map(len, kept)], dtype=np.int64))))
        return out

    def align(self, texts: list[str | None]) -> dict:
        """Counts and group digest of each text, and its links as (text, pair of ids, occurrences), sorted.

        ``same`` holds the links of ids with the same bytes (by the first id), ``odd`` all others (by
        first id * 65536 + second id).
        """
        (ids_a, rows_a), (ids_b, rows_b) = self._encoded(texts)
        n = len(texts)
        end_a, end_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        both = end_a[np.isin(end_a, end_b, assume_unique=True)]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        row_a = np.repeat(np.arange(n), np.diff(rows_a))
        head_a, head_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        row = row_a[head_a] if len(both) else row_a
        of_row = lambda x: np.bincount(row, weights=x, minlength=n).astype(np.int64)
        groups = np.bincount(row, minlength=n)

        one = np.flatnonzero((size_a == 1) & (size_b == 1))
        a, b = ids_a[head_a[one]], ids_b[head_b[one]]
        keys = [(row[one] << 32) + (a << 16) + b]
        weights = [np.ones(len(one), np.int64)]
        for part in self._expanded(ids_a, ids_b, group_a, group_b, (size_a > 1) | (size_b > 1)):
            keys.append((row[part[0]] << 32) + (part[1] << 16) + part[2])
            weights.append(part[3])
            if sum(map(len, keys)) > 4 * PART:
                x, w = _summed(np.concatenate(keys), np.concatenate(weights))
                keys, weights = [x], [w]
        key, weight = _summed(np.concatenate(keys), np.concatenate(weights))
        first, second = (key >> 16) & 0xFFFF, key & 0xFFFF
        same = self.v.same[first] == second
        return {
            "n_a": np.diff(rows_a), "n_b": np.diff(rows_b), "n_groups": groups, "n_links": of_row(size_a * size_b),
            "groups_sha256": self._digests(ids_a, ids_b, group_a, group_b, size_a, size_b, groups, n),
            "same": (key[same] >> 32, first[same], weight[same]),
            "odd": (key[~same] >> 32, key[~same] & 0xFFFFFFFF, weight[~same]),
        }

    @staticmethod
    def _expanded(ids_a, ids_b, group_a, group_b, wide):
        """(group, first id, second id, links) of the groups marked ``wide``, ``PART`` at a time.

        The ids of a group are counted first, so a long group costs its distinct pairs only.
        """
        at_a, at_b = wide[group_a], wide[group_b]
        left, n_left = _summed((group_a[at_a] << 16) + ids_a[at_a], np.ones(at_a.sum(), np.int64))
        right, n_right = _summed((group_b[at_b] << 16) + ids_b[at_b], np.ones(at_b.sum(), np.int64))
        begin, end = np.searchsorted(right, left >> 16 << 16), np.searchsorted(right, ((left >> 16) + 1) << 16)
        cuts = np.cumsum(end - begin) // PART
        for i, j in zip(*(lambda s: (s, np.append(s[1:], len(left))))(np.flatnonzero(np.diff(cuts, prepend=-1)))):
            sizes = (end - begin)[i:j]
            x = np.repeat(np.arange(i, j), sizes)
            y = np.repeat(begin[i:j], sizes) + _ranges(sizes)
            yield left[x] >> 16, left[x] & 0xFFFF, right[y] & 0xFFFF, n_left[x] * n_right[y]

    def _digests(self, ids_a, ids_b, group_a, group_b, size_a, size_b, groups, n) -> list[str]:
        """The digest of `a1,a2|b1;a3|b2,b3` for each text; the empty string without tokens."""
        # In a group's stretch of all tokens, those of A come first.
        before = np.cumsum(size_a + size_b) - size_a - size_b
        head_a, head_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        places = [before[group_a] + np.arange(len(ids_a)) - head_a[group_a], before[group_b] + size_a[group_b] + np.arange(len(ids_b)) - head_b[group_b]]
        signs = np.empty(len(ids_a) + len(ids_b), object)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[head_a + size_a - 1] = 1
        last_b[head_b + size_b - 1] = 2
        signs[places[0]] = self.names[last_a, ids_a]
        signs[places[1]] = self.names[last_b, ids_b]
        ends = np.append(0, np.cumsum(size_a + size_b))[np.append(0, np.cumsum(groups))]
        out = []
        for i in range(n):
            text = "".join(signs[ends[i] : ends[i + 1]].tolist())
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        return out


@lru_cache(1)
def _aligner(first: bytes, second: bytes) -> Aligner:
    return Aligner(vocabularies(first, second))


_PACK, _UNPACK = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _packed(keys: np.ndarray, weights: np.ndarray) -> bytes:
    """Sorted keys as differences, and weights, byte by byte of their places, compressed."""
    gaps = np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    sums = weights.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return _PACK.compress(np.concatenate([gaps, sums]).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    part = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(12, -1)
    whole = lambda x, kind: np.ascontiguousarray(x.T).view(kind).reshape(-1).astype(np.int64)
    return np.cumsum(whole(part[:4], "<u4")), whole(part[4:], "<u8")


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _lists(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A record of the first stage that holds counts of pairs and no text."""
    size = 1 << 16
    cuts = [0, *range(size, len(keys), size), len(keys)]
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (keys, counts)]
    n = len(cuts) - 1
    none = {"doc_id": pa.int64(), **dict.fromkeys(_NAMES[:4], pa.int64()), "groups_sha256": pa.string(), "same": pa.binary(), "odd": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *[pa.nulls(n, t) for t in none.values()], *lists], ["uid", *none, "pairs", "docs"])


def _first_stage(first: bytes, second: bytes):
    """Tokens to links: a row for each text, and the task's counts of texts by pair of ids."""

    def run(batches):
        worker = _aligner(first, second)
        vector = np.zeros(len(worker.v.same), np.int64)
        uid = TaskContext.get().partitionId() << 40
        keys, counts = [], []

        def counted():
            x, n = _summed(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [x], [n]
            return len(x)

        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                out = worker.align(batch.column("text").to_pylist())
                n = batch.num_rows
                np.add.at(vector, out["same"][1], 1)
                x, c = np.unique(out["odd"][1], return_counts=True)
                keys.append(x)
                counts.append(c)
                if sum(map(len, keys)) > PART and counted() > PART // 2:
                    yield _lists(keys.pop(), counts.pop())
                links = []
                for kind in ("same", "odd"):
                    row, key, weight = out[kind]
                    bounds = np.searchsorted(row, np.arange(n + 1))
                    links.append(pa.array([_packed(key[i:j], weight[i:j]) for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()))
                none = [pa.nulls(n, pa.list_(pa.int64()))] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), batch.column("doc_id").cast(pa.int64()), *[pa.array(out[c]) for c in _NAMES], *links, *none],
                    ["uid", "doc_id", *_NAMES, "same", "odd", "pairs", "docs"],
                )
                uid += n
        used = np.flatnonzero(vector)
        keys.append((used << 16) + worker.v.same[used])
        counts.append(vector[used])
        counted()
        yield _lists(keys[0], counts[0])

    return run


def _second_stage(held: np.ndarray, n_held: np.ndarray, vector: np.ndarray, best: np.ndarray):
    """Sums over the links whose counts the task holds, and the other pairs with their occurrences."""

    def run(batches):
        for batch in batches:
            rest, many, sums, tops = [], [], [], []
            for same, odd in zip(batch.column("same").to_pylist(), batch.column("odd").to_pylist()):
                a, w = _unpacked(same)
                key, v = _unpacked(odd)
                at = np.minimum(np.searchsorted(held, key), max(len(held) - 1, 0))
                known = held[at] == key if len(held) else np.zeros(len(key), bool)
                n = n_held[at[known]]
                top = n == best[key[known] >> 16]
                sums.append(int((vector[a] * w).sum() + (n * v[known]).sum()))
                tops.append(int(w[vector[a] == best[a]].sum() + v[known][top].sum()))
                rest.append(key[~known])
                many.append(v[~known])
            ends = pa.array([0, *accumulate(map(len, rest))], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (rest, many)]
            kept = [batch.column(c) for c in ("uid", "doc_id", *_NAMES)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), *lists], ["uid", "doc_id", *_NAMES, "tops", "sums", "rest", "many"])

    return run


def _threshold(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have as high a count."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()  # at most 63 rows
    level, total = 62, 0
    for r in sorted(levels, reverse=True):
        total += r["count"]
        if total > most:
            break
        level = r.level
    return 1 << level


def align(docs: DataFrame, folder: str = FOLDER, first: str = FIRST, second: str = SECOND, held_pairs: int = HELD_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Rows of texts, and the table of pairs of ids with their counts.

    The first has a row for every row of ``docs`` (doc_id, text, ...): doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256. A pair's count is the number of rows that hold it linked;
    count_sum adds up the counts of a text's links, n_best counts the links whose count is the highest
    of their A id. The second holds (a, b, n) for every pair.

    A null or empty text, and one whose tokens do not give back its bytes, has no tokens: zeros and an empty
    digest. Rows with the same or no doc_id each count as a text of their own. Other columns are
    ignored; empty tables give empty results.

    The driver reads the two vocabulary files and hands them to the tasks. It collects one number for
    each id of A and the counts of at most ``held_pairs`` frequent irregular pairs; the others are joined.
    """
    spark = docs.sparkSession
    files = [Path(folder, name).read_bytes() for name in (first, second)]
    kind = f"uid long, doc_id long, {_COUNTS}, same binary, odd binary, pairs array<long>, docs array<long>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stage = materialise(texts.mapInArrow(_first_stage(*files), kind))

    found = stage.where("uid is null").select(F.explode_outer(F.arrays_zip("pairs", "docs")).alias("p")).where("p is not null")
    counts = materialise(found.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")))
    highest = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("best"))

    same = vocabularies(*files).same
    pair_of = (np.arange(len(same)) << 16) + same
    vector, best = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    top = highest.toArrow()
    best[top.column("a").to_numpy()] = top.column("best").to_numpy()
    ids = spark.createDataFrame(pa.table({"pair": pair_of[same >= 0]}))
    regular = counts.join(F.broadcast(ids), "pair", "left_semi").toArrow()
    vector[regular.column("pair").to_numpy() >> 16] = regular.column("n").to_numpy()
    odd = counts.join(F.broadcast(ids), "pair", "left_anti")
    least = _threshold(odd, held_pairs)
    held = odd.where(F.col("n") >= least).toArrow().sort_by("pair")
    columns = [held.column(c).to_numpy() for c in ("pair", "n")]

    kind = f"uid long, doc_id long, {_COUNTS}, tops long, sums long, rest array<long>, many array<long>"
    summed = stage.where("uid is not null").drop("pairs", "docs").mapInArrow(_second_stage(*columns, vector, best), kind)
    rare = odd.where(F.col("n") < least).join(F.broadcast(highest.withColumnRenamed("a", "id")), F.shiftright("pair", 16) == F.col("id"))
    rare = rare.select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    rest = summed.select("uid", F.explode_outer(F.arrays_zip("rest", "many")).alias("p")).where("p is not null").select("uid", F.col("p.rest").alias("pair"), F.col("p.many").alias("w"))
    more = rest.join(rare, "pair").groupBy("uid").agg(F.sum(F.col("n") * F.col("w")).alias("more"), F.sum(F.when(F.col("is_best"), F.col("w")).otherwise(0)).alias("more_tops"))
    out = summed.drop("rest", "many").join(more, "uid", "left")
    rows = out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("tops") + F.coalesce("more_tops", F.lit(0))).alias("n_best"),
        (F.col("sums") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
    return rows, counts.select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), "n")
