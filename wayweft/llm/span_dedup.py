"""Repeated passages across documents, found by sliding spans of sentences.

A sentence ends at a full stop, an exclamation or question mark, or a line feed. One of over sixteen
words is cut on after the smallest word hash of every sixteen words, so a passage is cut alike wherever
it stands. A span is a run of two or more sentences with at least twenty words: the shortest one that
starts at a sentence, or that ends at one (a tail). Together they reach every sentence of any longer
run that repeats. Spans are hashed to 128 bits and joined over all documents, tails only where the
span at their start repeats; sentences of every span that an earlier document holds too, or that
stood before in the same text, are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.llm.line_dedup import NO_ID
from wayweft.llm.shared import MASK_BITS, carry, in_mask, mask_of, mask_rows, uncarried
from wayweft.llm.words import mix, signed, slices, text_bytes, words
from wayweft.session import materialise

SENTENCES, WORDS = 2, 20
LONG = 16


def sentences(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, first byte and words of each sentence, two fingerprints) of texts."""
    raw, rows = text_bytes(column)
    prints, bounds, starts, sizes = words(column)
    n = len(prints)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(len(rows), np.int64), none, none, none.astype(np.uint64), none.astype(np.uint64)
    end = starts + sizes - 1
    for _ in range(2):
        end = np.where(np.isin(raw[end], list(b"\"')]")) & (end > starts), end - 1, end)
    lines = np.searchsorted(np.flatnonzero(raw == 10), starts)
    last = np.isin(raw[end], list(b".!?"))
    last[:-1] |= lines[1:] != lines[:-1]
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    count = np.diff(np.append(first, n))
    sentence, long_ = np.repeat(np.arange(len(first)), count), np.repeat(count > LONG, count)
    # The place of the smallest hash (the last one of equals) of each window of LONG words.
    low, at, step = prints, np.arange(n), 1
    while step < LONG:
        later = low[step:] <= low[:-step]
        low, at, step = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step]), step * 2
    last[at[(sentence[: len(at)] == sentence[LONG - 1 :]) & long_[: len(at)]]] = True
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    count = np.diff(np.append(first, n))
    place = (np.arange(n) - np.repeat(first, count)).astype(np.uint64)
    one = np.add.reduceat(mix(prints + place * np.uint64(0x9E3779B97F4A7C15)), first)
    two = np.add.reduceat(mix(prints ^ mix(place + np.uint64(77))), first)
    return np.searchsorted(first, bounds), starts[first], count, one, two


def spans(column, tails: bool = False):
    """(row, first sentence, end sentence, first byte, end byte, a, b, again, prefix) of all spans of texts.

    With ``tails`` these follow the spans from each start; ``prefix`` is the number of the span at a
    span's start, its own where it is none of the tails.
    """
    raw, rows = text_bytes(column)
    bounds, begins, count, one, two = sentences(column)
    total = np.concatenate([[0], np.cumsum(count)])
    s = np.arange(len(count))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    e = np.maximum(s + SENTENCES, np.searchsorted(total, total[s] + WORDS))
    fits = e <= bounds[1:][row] if len(s) else np.zeros(0, bool)
    prefix = np.cumsum(fits) - 1
    if tails and len(s):
        end = s + 1
        start = np.minimum(end - SENTENCES, np.searchsorted(total, total[end] - WORDS, "right") - 1)
        more = np.flatnonzero(start >= bounds[:-1][row])
        more = more[e[start[more]] < end[more]]
        s, e, row = (np.concatenate([x[fits], y[more]]) for x, y in ((s, start), (e, end), (row, row)))
        prefix = np.concatenate([prefix[fits], prefix[start[more]]])
    else:
        s, e, row, prefix = s[fits], e[fits], row[fits], prefix[fits]
    a, b = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
    for d in range(int((e - s).max()) if len(s) else 0):
        inside = np.flatnonzero(s + d < e)
        step = np.uint64((d + 1) * 0x9E3779B97F4A7C15 % 2**64)
        a[inside] += mix(one[s[inside] + d] + step)
        b[inside] += mix(two[s[inside] + d] ^ step)
    a, b = mix(a), mix(b)
    order = np.lexsort((s, b, a, row))
    same = np.zeros(len(s), bool)
    if len(s):
        x, y = order[1:], order[:-1]
        same[x] = (row[x] == row[y]) & (a[x] == a[y]) & (b[x] == b[y])
    ends = np.append(begins, len(raw))
    stop = np.minimum(ends[e], rows[1:][row]) if len(s) else e
    return row, s - bounds[row], e - bounds[row], begins[s] - rows[row], stop - rows[row], a, b, same, prefix


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("rid"), "text")


def _first_spans(docs: DataFrame, mask: np.ndarray | None = None) -> DataFrame:
    """(doc_id, a, b): each span once for every text that holds it; with ``mask``, each tail of a span that it lets through."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                row, *_, a, b, again, prefix = spans(batch.column("text"), mask is not None)
                new = ~again
                if mask is not None:
                    new &= (prefix != np.arange(len(prefix))) & in_mask(mask, a[prefix])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row[new])), pa.array(signed(a[new])), pa.array(signed(b[new]))], ["doc_id", "a", "b"]
                )

    return docs.mapInArrow(run, "doc_id long, a long, b long")


def _suspect_spans(docs: DataFrame, mask: np.ndarray, tail_mask: np.ndarray) -> DataFrame:
    """The spans that the masks let through or that stood before in the same text, with their places."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                row, s, e, begin, end, a, b, again, prefix = spans(batch.column("text"), True)
                tail = prefix != np.arange(len(prefix))
                hit = np.flatnonzero(again | np.where(tail, in_mask(tail_mask, a), in_mask(mask, a)))
                at = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at), batch.column("rid").take(at), pa.array(signed(a[hit])), pa.array(signed(b[hit])), pa.array(again[hit]),
                        *[pa.array(x[hit].astype(np.int64)) for x in (s, e, begin, end)],
                    ],
                    ["doc_id", "rid", "a", "b", "again", "s", "e", "begin", "stop"],
                )

    return docs.mapInArrow(run, "doc_id long, rid long, a long, b long, again boolean, s long, e long, begin long, stop long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, sources, cuts): for each text with repeated spans their places, and the documents that hold them first."""
    keyed = _keyed(docs)

    def in_several(found: DataFrame) -> DataFrame:
        seen = found.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        return materialise(seen.where("first < last").select("a", "b", "first"))

    starts = in_several(_first_spans(keyed))
    mask = mask_of(starts, "a")
    # A tail repeats only where the span at its start does.
    tails = in_several(_first_spans(keyed, mask))
    suspects = _suspect_spans(keyed, mask, mask_of(tails, "a"))
    # Spans of a text that repeat in it need no other document; the others look for their first one.
    found = suspects.join(starts.unionByName(tails), ["a", "b"], "left").where("again or first < doc_id")
    cut = F.struct("begin", "stop", "s", "e")
    source = F.when(F.col("first") < F.col("doc_id"), F.nullif(F.col("first"), F.lit(NO_ID)))
    out = found.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set(source)).alias("sources"), F.sort_array(F.collect_set(cut)).alias("cuts"))
    return materialise(out)


def dedup_spans(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages, plus n_sentences, n_removed and sources.

    The first holder of a span is the smallest doc_id that has it; there its first place stays, and
    all sentences of its other places go, up to the next sentence's first word. ``sources`` lists the
    first holders of what was removed.

    A null or empty text has no sentences and becomes empty. Rows that share a doc_id are one document,
    so equal rows stay equal; null doc_ids come before all others. Texts of under two sentences or
    twenty words never repeat. Columns named like the new ones are replaced; an empty table gives an
    empty result.
    """
    cuts = repeated_spans(docs).select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "sources", "cuts")
    new = ("n_sentences", "n_removed", "sources")
    own = carry(docs, "doc_id", "text", new=new)
    # Only documents that a bit map of cut ones lets through are shuffled to their cuts.
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    low = number.bitwiseAND(F.lit((1 << MASK_BITS) - 1))
    own = own.join(F.broadcast(mask_rows(cuts, "_d")), F.shiftright(low, 6) == F.col("w"), "left")
    cut = F.coalesce(F.expr("b & (1L << CAST(low & 63 AS INT)) <> 0"), F.lit(False))
    own = own.withColumn("low", low).withColumn("cut", cut).select("doc_id", "text", "others", "cut")
    joined = own.where("cut").join(cuts.hint("shuffle_hash"), (number == F.col("_d")) & (F.xxhash64("text") == F.col("_r")), "left")
    spared = own.where("not cut").withColumns({c: F.lit(None).cast(cuts.schema[c].dataType) for c in ("sources", "cuts")})
    joined = joined.select("text", "others", "sources", "cuts").unionByName(spared.select("text", "others", "sources", "cuts"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                bounds, *_ = sentences(batch.column("text"))
                texts, removed = [], []
                for text, places in zip(batch.column("text").cast(pa.binary()), batch.column("cuts")):
                    text, at, kept, gone = text.as_py() or b"", 0, [], 0
                    sentence = 0
                    for x in places.as_py() or []:
                        kept.append(text[at : max(at, x["begin"])])
                        at = max(at, x["stop"])
                        gone += max(0, x["e"] - max(sentence, x["s"]))
                        sentence = max(sentence, x["e"])
                    texts.append(b"".join([*kept, text[at:]]).decode())
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("others"), pa.array(texts, pa.string()), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), batch.column("sources")],
                    ["others", "text", *new],
                )

    kind = f"others {joined.schema['others'].dataType.simpleString()}, text string, n_sentences long, n_removed long, sources array<long>"
    out = joined.mapInArrow(run, kind).withColumn("sources", F.coalesce("sources", F.array().cast("array<bigint>")))
    return uncarried(out, docs, new)
