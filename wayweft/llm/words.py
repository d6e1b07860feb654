"""Words of Arrow text columns as 64-bit fingerprints, made without a Python step per word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z are lower-cased. A fingerprint is a sum of random table entries by place and byte, so two
different words share one with a chance of 2^-64. Texts are worked off in pieces of about a megabyte
that end at white space, so memory does not follow the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)
_ODD = np.random.Generator(np.random.PCG64(21)).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _piece(raw: np.ndarray, heads: np.ndarray, quiet: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, first bytes and lengths of the words of a piece; a word never spans one of ``heads``.

    Bytes marked in ``quiet`` are left out of words; words of nothing else vanish.
    """
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[heads] = solid[heads]
    if quiet is None:
        at = np.flatnonzero(solid)
        runs = np.flatnonzero(first[at])
    else:
        at = np.flatnonzero(solid & ~quiet[raw])
        runs = np.flatnonzero(np.diff(np.cumsum(first)[at], prepend=0))
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    sizes = np.diff(np.append(runs, len(at)))
    place = np.arange(len(at)) - np.repeat(runs, sizes)
    values = _TABLE[place & (_PLACES - 1), LOWER[raw[at]]]
    if sizes.max() > _PLACES:
        values = values * (np.uint64(2) * (place // _PLACES).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(values, runs)), at[runs], sizes


def words(column, quiet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, bounds of each row's words, first byte of each word, bytes of each word)."""
    raw, rows = text_bytes(column)
    prints, starts, sizes = [], [], []
    begin = 0
    while begin < len(raw):
        end = min(len(raw), begin + PIECE)
        if end < len(raw):
            # Up to the next white space or row, whichever comes first.
            limit = rows[np.searchsorted(rows, end)]
            while end < limit:
                gap = np.flatnonzero(SPACE[raw[end : min(limit, end + 4096)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(limit, end + 4096)
        heads = rows[np.searchsorted(rows, begin) : np.searchsorted(rows, end)] - begin
        h, s, n = _piece(raw[begin:end], heads, quiet)
        prints.append(h)
        starts.append(s + begin)
        sizes.append(n)
        begin = end
    if not prints:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64), none, none
    at = np.concatenate(starts)
    return np.concatenate(prints), np.searchsorted(at, rows), at, np.concatenate(sizes)


def windows(prints: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint for each run of ``size`` consecutive words (rows are not minded)."""
    n = len(prints) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += prints[i : i + n] * _ODD[i]
    return mix(total)


def shingle_sets(prints: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's distinct runs of ``size`` words, sorted; fewer words count as one run, none as none."""
    every = windows(prints, size)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif n:
            out.append(windows(prints[a:b], n) ^ mix(np.array([n])))
        else:
            out.append(every[:0])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Fingerprints as Spark's BIGINT."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Parts of a batch whose texts have at most ``most`` bytes together, or one row."""
    _, rows = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(rows, rows[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
