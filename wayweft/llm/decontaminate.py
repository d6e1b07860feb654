"""Benchmark items in documents, also with other numbers, names and units, by template windows.

Numbers, names and units become typed placeholders. Windows of eight placeholders and words are
hashed and joined with those of the benchmark, and a match counts only where the slots agree: one
value of the item always stands for one value of the document. Where an item has too few plain words
for that, its windows are looked for as they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.llm.shared import carry, in_mask, mask_of, uncarried
from wayweft.llm.words import SPACE, mix, signed, slices, text_bytes, windows, words
from wayweft.session import materialise

WINDOW = 8
#: Windows with fewer plain words say too little; so many of a window's tokens must be words.
LITERALS = 5
#: Windows of placeholders and words, longer ones up to the fifth plain word, and windows as they stand.
TEMPLATE, LONGER, VERBATIM = range(3)
#: An item leaks when this share of its windows is found, or this many windows.
COVERAGE, WINDOWS = 0.4, 20
#: Slots of a match that may contradict each other.
CONFLICTS = 0.2

# Words for numbers and units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
).split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg gram grams "
    "kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute "
    "minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees "
    "celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons hz khz mhz mph kmh"
).split()

_QUIET = np.zeros(256, bool)
_QUIET[list(b".,;:!?\"'()[]{}<>$+-*_`")] = True
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
# What keeps the hashes of the kinds apart, and an odd base with its inverse modulo 2^64.
_SALTS = tuple(np.uint64(x) for x in (0, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _known() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.sort(words(pa.array(list(x)), _QUIET)[0]) for x in (NUMBER_WORDS, UNIT_WORDS))


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def templates(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token fingerprints with placeholders, and without, which are slots, row bounds, first bytes, all bytes) of texts."""
    raw, rows = text_bytes(column)
    prints, bounds, starts, _ = words(column, _QUIET)
    if not len(prints):
        return prints, prints, np.zeros(0, bool), bounds, starts, raw
    head = raw[starts]
    numbers, units = _known()
    number = ((head >= 48) & (head <= 57)) | _member(prints, numbers)
    unit = _member(prints, units) & ~number
    after = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    # A sentence begins at a row's or line's first word and after a full stop, past quotes and blanks.
    back, sentence = starts - 1, np.zeros(len(starts), bool)
    for _ in range(4):
        last = raw[np.maximum(back, 0)]
        sentence |= (back < 0) | (last == 10) | np.isin(last, list(b".!?"))
        back = np.where(SPACE[last] | np.isin(last, list(b"\"'([")), back - 1, back)
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    sentence[heads] = True
    name = capital & ~sentence & ~number & ~unit
    tokens = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, prints)))
    return tokens, prints, number | unit | name, bounds, starts, raw


def _value(raw: np.ndarray, start: int, stop: int) -> str:
    end = start
    while end < stop and not SPACE[raw[end]]:
        end += 1
    return raw[start:end].tobytes().decode(errors="replace").strip(".,;:!?\"'()[]{}<>$+-*_`").lower()


def _longer(tokens: np.ndarray, slot: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, end, hash) of the stretches of more than ``WINDOW`` tokens from a plain word to the fourth after it."""
    plain = np.flatnonzero(~slot)
    at, end = plain[: max(len(plain) - LITERALS + 1, 0)], plain[LITERALS - 1 :] + 1
    good = (row_of[at] == row_of[end - 1]) & (end - at > WINDOW)
    at, end = at[good], end[good]
    if not len(at):
        return at, end, np.zeros(0, np.uint64)
    up, down = (np.cumprod(np.full(len(tokens), x, np.uint64)) for x in (_BASE, _INVERSE))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up)])
    return at, end, mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64)) ^ _SALTS[LONGER]


def _windows_of(batch: pa.RecordBatch, forms: list[tuple[int, int]] | None, mask: np.ndarray | None):
    """(row, pos, kind, length, hash, slots) of the windows of these ``forms`` (kind, length) that ``mask`` lets through.

    Without forms, the windows by which items are looked for; see ``leaks``.
    """
    tokens, prints, slot, bounds, starts, raw = templates(batch.column("text"))
    n_of, stops = np.diff(bounds), text_bytes(batch.column("text"))[1][1:]
    row_of = np.repeat(np.arange(len(n_of)), n_of)
    plain = np.concatenate([[0], np.cumsum(~slot)])
    slots_at = np.flatnonzero(slot)
    items, templated = forms is None, np.zeros(len(n_of), bool)
    if items:
        lengths = sorted({WINDOW, *n_of[(n_of > 0) & (n_of < WINDOW)].tolist()})
        forms = [*((kind, n) for n in lengths for kind in (TEMPLATE, VERBATIM)), (LONGER, 0)]
    for kind, length in forms:
        if kind == LONGER:
            at, end, hashes = _longer(tokens, slot, row_of)
            # Only an item's own templates spare it the longer windows: a document may hold another item as well.
            good = ~templated[row_of[at]] if items else np.ones(len(at), bool)
        else:
            hashes = mix(windows(prints if kind == VERBATIM else tokens, length) + np.uint64(length)) ^ _SALTS[kind]
            n = len(hashes)
            good = row_of[:n] == row_of[length - 1 :]
            says = plain[length:] - plain[:-length] >= min(LITERALS, length)
            if kind == TEMPLATE:
                good &= says
            elif items and length == WINDOW:
                good &= ~says
            if items and length < WINDOW:
                good &= n_of[row_of[:n]] == length
            at = np.arange(n)
            end = at + length
        if mask is not None and len(hashes):
            good &= in_mask(mask, hashes)
        at, end, hashes = at[good], end[good], hashes[good]
        if items and kind == TEMPLATE:
            templated[row_of[at]] = True
        if kind == VERBATIM:
            values = [[]] * len(at)
        else:
            first, last = np.searchsorted(slots_at, at), np.searchsorted(slots_at, end)
            values = [[_value(raw, starts[k], stops[row_of[k]]) for k in slots_at[a:b]] for a, b in zip(first, last)]
        yield row_of[at], at - bounds[row_of[at]], kind, length, hashes, values


def _rows(frame: DataFrame, forms: list[tuple[int, int]] | None, mask: np.ndarray | None) -> DataFrame:
    """(id, rid, pos, kind, length, hash, slots) over the windows of ``frame`` (id, rid, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                for row, pos, kind, length, hashes, values in _windows_of(batch, forms, mask):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(row)), batch.column("rid").take(pa.array(row)), pa.array(pos.astype(np.int32)),
                            pa.array(np.full(len(row), kind, np.int32)), pa.array(np.full(len(row), length, np.int32)), pa.array(signed(hashes)),
                            pa.array(values, pa.list_(pa.string())),
                        ],
                        ["id", "rid", "pos", "kind", "length", "hash", "slots"],
                    )

    return frame.mapInArrow(run, "id long, rid long, pos int, kind int, length int, hash long, slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, rid, item_id, n_windows, coverage, exact): the benchmark items that documents hold.

    An item is found in a document if a share ``COVERAGE`` of its windows, or ``WINDOWS`` of them, lie
    in the document along stretches whose slots agree; ``exact`` tells that no slot was changed.
    Windows of eight tokens with under five plain words are looked for as they stand, and they count
    in the share of all windows; the share of the others, as templates, decides as well. An item with
    no window of five plain words has longer ones as templates, from a plain word to the fourth after
    it. Items of fewer than eight tokens are one window of their own length, as it stands and, with
    five plain words (or nothing else, when shorter), as a template. So a copy of any item with a
    token is found; one with other values needs five plain words, or fewer and no slot.
    ``rid`` is a hash of the text, so rows with equal doc_ids, null ones too, stay apart.

    Null or empty texts hold nothing and repeated rows give one result. Other columns do not matter;
    without items or documents the result is empty. The scan passes windows on by a bit map of fixed
    size, made from all benchmark windows; the join that follows is exact on 64-bit hashes.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("rid"), "text")
    own = materialise(_rows(items, None, None).distinct())
    forms = sorted((r[0], r[1]) for r in own.select("kind", "length").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("rid"), "text")
    seen = _rows(texts, forms, mask_of(own, "hash")).select(F.col("id").alias("doc_id"), F.col("rid"), F.col("pos").alias("at"), "hash", F.col("slots").alias("values"))
    item = own.select(F.col("id").alias("item_id"), F.col("rid").alias("item_rid"), "pos", "hash", "slots", (F.col("kind") == VERBATIM).alias("verbatim"))
    met = seen.join(item, "hash").where(F.size("slots") == F.size("values"))
    run = met.groupBy("doc_id", "rid", "item_id", "item_rid", "verbatim", (F.col("at") - F.col("pos")).alias("shift")).agg(
        F.collect_set("pos").alias("places"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("slots", "values")))).alias("pairs")
    )
    sides = F.size(F.array_distinct(F.col("pairs.slots")))
    agree = F.size("pairs") - sides <= F.size("pairs") * CONFLICTS
    same = F.forall("pairs", lambda p: p["slots"] == p["values"])
    n_of = lambda places: F.size(F.array_distinct(F.flatten(F.collect_list(places)))).cast("long")
    hit = run.where(agree).groupBy("doc_id", "rid", "item_id", "item_rid").agg(
        n_of(F.col("places")).alias("n_windows"), n_of(F.when(~F.col("verbatim"), F.col("places"))).alias("n_templates"), F.bool_and(same).alias("exact")
    )
    counts = own.groupBy(F.col("id").alias("item_id"), F.col("rid").alias("item_rid")).agg(
        F.countDistinct("pos").alias("of"), F.countDistinct(F.when(F.col("kind") != VERBATIM, F.col("pos"))).alias("of_templates")
    )
    share = F.greatest(F.col("n_windows") / F.col("of"), F.col("n_templates") / F.nullif("of_templates", F.lit(0)))
    both = hit.join(counts, hit["item_id"].eqNullSafe(counts["item_id"]) & (hit["item_rid"] == counts["item_rid"])).select(
        "doc_id", "rid", hit["item_id"], "n_windows", share.alias("coverage"), "exact"
    )
    return both.where((F.col("coverage") >= COVERAGE) | (F.col("n_windows") >= WINDOWS))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_r"))
    return uncarried(carry(docs, "doc_id", "text").join(bad, same, "left_anti"), docs)
