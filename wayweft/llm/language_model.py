"""Text scores from a log-bilinear neural language model, trained with noise-contrastive estimation.

Output units are the end of a text, the most frequent training words, and classes of all other words
by their first two bytes. The model predicts a unit from the three before it: their vectors, weighted
by place, add up to one that is multiplied with all units' output vectors. A class's words then share
its probability by their counts, one part going to words never seen, so all probabilities add up to
one. Tasks train on their own texts from common parameters, whose mean starts the next round.

Counts cover all training texts and are joined by word. The most frequent words, a list of bounded
length, are looked up in the scan that scores; all others are handed on by it and meet their counts in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.llm.line_dedup import NO_ID
from wayweft.llm.words import LOWER, signed, slices, text_bytes, words
from wayweft.session import materialise

OWN_UNITS = 255
CLASSES = 128
#: At most so many words are looked up without a shuffle, at 16 bytes each.
HEAD = 100_000
ORDER, WIDTH = 3, 16
NOISE, BATCH, ROUNDS, RATE = 32, 2048, 2, 0.1
#: Rows of a scoring batch, whose logits should stay in a core's cache.
SCORED_AT_ONCE = 512
SAFE = 60.0
END = 0
FIRST_CLASS = 1 + OWN_UNITS
UNITS = FIRST_CLASS + CLASSES


def held_out(doc_id: Column) -> Column:
    """One in seven texts, by the checksum of the doc_id as text (null: empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )


def word_classes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, class, row bounds) of the words of texts."""
    raw, _ = text_bytes(column)
    prints, bounds, starts, sizes = words(column)
    second = np.where(sizes > 1, LOWER[raw[np.minimum(starts + 1, max(len(raw) - 1, 0))]], 0) if len(prints) else starts
    first = LOWER[raw[starts]].astype(np.int64) if len(prints) else starts
    return prints, (first * 31 + second) % CLASSES, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, cls, c) over the training texts of ``docs`` (text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                prints, cls, _ = word_classes(batch.column("text"))
                unique, at, c = np.unique(prints, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(unique)), pa.array(cls[at].astype(np.int64)), pa.array(c.astype(np.int64))], ["word", "cls", "c"])

    return docs.select("text").mapInArrow(run, "word long, cls long, c long").groupBy("word", "cls").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words, sorted by fingerprint, with counts and units, and what the classes hold."""

    head: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    class_size: np.ndarray
    noise: np.ndarray
    tokens: int
    types: int
    texts: int

    @classmethod
    def of(cls, counts: DataFrame, texts: int) -> Vocabulary:
        # The cut lies between two classes of counts, so no task has to rank the words.
        size = F.floor(F.log2("c") * 16).cast("long")
        held, cut = 0, None
        for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
            held += r["count"]
            if held > HEAD:
                break
            cut = r["size"]
        top = counts.where(size >= cut if cut is not None else F.lit(False)).toArrow()
        word, c, kind = (top.column(x).to_numpy() for x in ("word", "c", "cls"))
        order = np.lexsort((word, -c))
        word, c, kind = word[order], c[order], kind[order]
        unit = np.where(np.arange(len(word)) < OWN_UNITS, 1 + np.arange(len(word)), FIRST_CLASS + kind)
        totals = counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
        mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
        mass[totals.column("cls").to_numpy()] = totals.column("c").to_numpy()
        types[totals.column("cls").to_numpy()] = totals.column("v").to_numpy()
        n, v = int(mass.sum()), int(types.sum())
        own = slice(0, min(OWN_UNITS, len(word)))
        np.subtract.at(mass, kind[own], c[own])
        np.subtract.at(types, kind[own], 1)
        noise = np.zeros(UNITS)
        noise[END], noise[FIRST_CLASS:] = texts, mass
        noise[unit[own]] = c[own]
        noise = (noise + 0.5) / (noise + 0.5).sum()
        # An entry that no word has keeps the lists from being empty.
        word, c, unit = np.append(word.view(np.uint64), np.uint64(0)), np.append(c, 0), np.append(unit, FIRST_CLASS)
        order = np.argsort(word, kind="stable")
        return cls(word[order], c[order], unit[order], mass + types + 1, noise, n + texts, v + (texts > 0), texts)

    def units_of(self, prints: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The units of words; only the few words with units of their own are looked up."""
        own = np.flatnonzero((self.units < FIRST_CLASS) & (self.counts > 0))
        if not len(own):
            return FIRST_CLASS + cls
        word, unit = self.head[own], self.units[own]
        at = np.minimum(np.searchsorted(word, prints), len(word) - 1)
        return np.where(word[at] == prints, unit[at], FIRST_CLASS + cls)

    def find(self, prints: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, count or 0, whether listed) of words."""
        at = np.minimum(np.searchsorted(self.head, prints), len(self.head) - 1)
        hit = (self.head[at] == prints) & (self.counts[at] > 0)
        return np.where(hit, self.units[at], FIRST_CLASS + cls), np.where(hit, self.counts[at], 0), hit


def sequences(units: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(targets, contexts): all units and an end for each text, with the ``ORDER`` units before each."""
    n = len(bounds) - 1
    shift = ORDER * (np.arange(n) + 1) + np.arange(n)
    line = np.full(len(units) + n * (ORDER + 1), END, np.int16)
    target = np.zeros(len(line), bool)
    at = np.arange(len(units)) + np.repeat(shift, np.diff(bounds))
    line[at] = units
    target[at] = True
    target[bounds[1:] + shift] = True
    at = np.flatnonzero(target)
    return line[at], np.stack([line[at - i] for i in range(1, ORDER + 1)])


def first_parameters(noise: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    return {
        "inner": rng.normal(0, 0.1, (UNITS, WIDTH)).astype(np.float32), "outer": rng.normal(0, 0.1, (UNITS, WIDTH)).astype(np.float32),
        "place": np.ones((ORDER, WIDTH), np.float32), "bias": np.log(noise).astype(np.float32),
    }


def predicted(p: dict[str, np.ndarray], contexts: np.ndarray) -> np.ndarray:
    return sum(p["inner"].take(contexts[i], axis=0) * p["place"][i] for i in range(ORDER))


def _summed(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows added up by unit."""
    order = np.argsort(at, kind="stable")
    place = at.take(order)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    out = np.zeros((UNITS, rows.shape[1]), np.float32)
    out[place[first]] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out


class Trainer:
    """Noise-contrastive steps with Adagrad; one noise sample serves a batch."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in p.items()}
        self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.below, self.offset = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        self.seen = 0

    def step(self, target: np.ndarray, contexts: np.ndarray) -> None:
        p, n = self.p, len(target)
        vectors = [p["inner"].take(contexts[i], axis=0) for i in range(ORDER)]
        q = sum(v * w for v, w in zip(vectors, p["place"]))
        noise = np.minimum(np.searchsorted(self.below, self.rng.random(NOISE)), UNITS - 1)
        own, other = p["outer"].take(target, axis=0), p["outer"][noise]
        shift = p["bias"] - self.offset
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) + shift.take(target)))
        down = q @ other.T
        down += shift[noise]
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        dq = up[:, None] * own
        dq += down @ other
        outer = _summed(np.column_stack([up[:, None] * q, up]), target)
        np.add.at(outer, noise, np.column_stack([down.T @ q, down.sum(axis=0)]))
        inner = sum(_summed(dq, contexts[i]) * p["place"][i] for i in range(ORDER))
        place = np.stack([np.einsum("ij,ij->j", dq, v) for v in vectors])
        for k, g in {"outer": outer[:, :-1], "bias": outer[:, -1], "inner": inner, "place": place}.items():
            g = g / n
            self.squares[k] += g * g
            p[k] += RATE * g / np.sqrt(self.squares[k])
        self.seen += n

    def learn(self, target: np.ndarray, contexts: np.ndarray) -> None:
        order = self.rng.permutation(len(target))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            self.step(target.take(part), contexts.take(part, axis=1))


def trained(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` passes of all tasks over the training texts, weighted by their tokens."""
    parameters = first_parameters(vocabulary.noise)
    names = list(parameters)
    for turn in range(rounds):
        start = parameters

        def run(batches, start=start, turn=turn):
            trainer = Trainer(start, vocabulary.noise, turn)
            for whole in batches:
                for batch in slices(whole, "text"):
                    prints, cls, bounds = word_classes(batch.column("text"))
                    trainer.learn(*sequences(vocabulary.units_of(prints, cls), bounds))
            if trainer.seen:
                flat = np.concatenate([trainer.p[k].reshape(-1) for k in names]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat))), pa.array(flat * trainer.seen), pa.array(np.full(len(flat), trainer.seen, np.int64))], ["i", "x", "w"]
                )

        mean = docs.select("text").mapInArrow(run, "i long, x double, w long").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toArrow()
        if mean.num_rows:
            flat = np.empty(mean.num_rows)
            flat[mean.column("i").to_numpy()] = mean.column("x").to_numpy()
            cuts = np.cumsum([parameters[k].size for k in names])[:-1]
            parameters = {k: v.reshape(parameters[k].shape).astype(np.float32) for k, v in zip(names, np.split(flat, cuts))}
    return parameters


def log_probabilities(p: dict[str, np.ndarray], target: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities of targets, by one matrix product a batch."""
    out = np.empty(len(target))
    outer = np.vstack([p["outer"].T, p["bias"][None, :]])
    largest, ones = float(np.sqrt((outer**2).sum(axis=0)).max()), np.ones(UNITS, np.float32)
    for i in range(0, len(target), SCORED_AT_ONCE):
        own = target[i : i + SCORED_AT_ONCE]
        q = np.column_stack([predicted(p, contexts[:, i : i + SCORED_AT_ONCE]), np.ones(len(own), np.float32)])
        logits = q @ outer
        # Far below the largest exponent that single precision holds, no logit has to be taken off first.
        if largest * float(np.sqrt((q**2).sum(axis=1)).max()) > SAFE:
            logits -= logits.max(axis=1)[:, None]
        chosen = logits[np.arange(len(own)), own]
        np.exp(logits, out=logits)
        out[i : i + SCORED_AT_ONCE] = chosen - np.log(logits @ ones)
    return out


def _scored(docs: DataFrame, vocabulary: Vocabulary, parameters: dict[str, np.ndarray]) -> DataFrame:
    """A row per text with counts of tokens, the listed words' part of both scores, and the other words with their number.

    ``uid`` tells rows apart once the result is stored.
    """
    share = np.log10(vocabulary.class_size)
    end_log = float(np.log10(vocabulary.texts + 1))

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                prints, cls, bounds = word_classes(batch.column("text"))
                units, counts, hit = vocabulary.find(prints, cls)
                target, contexts = sequences(units, bounds)
                ends = bounds[1:] + np.arange(len(bounds) - 1) + 1
                sums = np.concatenate([[0], np.cumsum(log_probabilities(parameters, target, contexts) / np.log(10))])
                logs = np.log10(counts + 1.0)
                base = np.concatenate([[0], np.cumsum(logs)])
                inside = np.concatenate([[0], np.cumsum(np.where(units >= FIRST_CLASS, logs - share[cls], 0))])
                known = np.concatenate([[0], np.cumsum(hit)])
                over = lambda x: x[bounds[1:]] - x[bounds[:-1]]
                model = np.diff(np.concatenate([[0], sums[ends]])) + over(inside)
                n = np.diff(bounds) + 1
                rare, times = _rare(prints, hit, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + len(n))), batch.column("doc_id"), batch.column("held_out"), pa.array(n),
                        pa.array(over(known) + (vocabulary.texts > 0)), pa.array(over(base) + end_log), pa.array(model), rare, times,
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "times"],
                )
                uid += len(n)

    kind = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>, times array<int>"
    return docs.mapInArrow(run, kind)


def _rare(prints: np.ndarray, hit: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The words of each text that are not listed, and how often each occurs."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[~hit]
    word = prints[~hit]
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])[: len(row)])
    ends = pa.array(np.searchsorted(row[first], np.arange(len(bounds))).astype(np.int32))
    times = np.diff(np.append(first, len(row))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(signed(word[first]))), pa.ListArray.from_arrays(ends, pa.array(times))


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    A text's tokens are its lower-cased words (A-Z only) and one end. ``base_score`` is its log10
    probability by training counts plus one, ``score`` that of the model; both learn from the texts
    that are not held out. Word fingerprints have 64 bits.

    A null or empty text has the end alone. Equal rows count each in training and get equal scores;
    null doc_ids are training texts. Other columns are left out. Without training texts every token
    is unknown; an empty table gives an empty result.
    """
    keyed = _keyed(docs)
    training = keyed.where(~F.col("held_out"))
    texts = training.count()
    counts = materialise(word_counts(training))
    vocabulary = Vocabulary.of(counts, texts)
    parameters = trained(training, vocabulary, rounds)
    scored = materialise(_scored(keyed, vocabulary, parameters))
    rare = scored.select("uid", F.explode_outer(F.arrays_zip("rare", "times")).alias("r")).where("r is not null")
    rare = rare.select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("n")).join(counts.select("word", "c"), "word")
    rare = rare.groupBy("uid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    out = scored.drop("rare", "times").join(rare, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    floor = float(np.log10(vocabulary.tokens + vocabulary.types + 1))
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
