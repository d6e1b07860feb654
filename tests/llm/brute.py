"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import math
import re
import zlib

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))


def near_duplicates(rows, size, percent):
    """(doc_id, set size, component, kept) of (doc_id, text) by all pairs that share a shingle."""
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for a, b in {(x, y) for group in holders.values() for i, y in enumerate(group) for x in group[:i]}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def base_scores(rows):
    """{doc_id: (held out, tokens, known, training tokens, base score)}."""
    out_of = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = collections.Counter()
    for d, text in rows:
        if not out_of[d]:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, text in rows:
        tokens = [*words(text), None]
        score = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out[d] = (out_of[d], len(tokens), sum(counts[t] > 0 for t in tokens), n, score)
    return out


def fingerprints(rows, size, radius):
    """(doc_id, fingerprint, component) of (doc_id, text) by all pairs; a hash is made bit by bit."""
    import xxhash

    prints = {}
    for doc, text in rows:
        w = words(text)
        runs = [w[i : i + size] for i in range(len(w) - size + 1)] or ([w] if w else [])
        hashes = [xxhash.xxh64(" ".join(r).encode(), 42).intdigest() for r in runs]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    low = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if low[b] < low[a] and (prints[a] ^ prints[b]).bit_count() <= radius:
                    low[a], changed = low[b], True
    return sorted((d, f"{p:016x}", low[d]) for d, p in prints.items())


def alignment(texts, folder):
    """Counts and digest of each text, and {(a, b): texts that hold the pair linked}, token by token."""
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    cut = []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [piece(i) for i in b]
        groups = []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            i = j = 0
            while i < len(a):
                x, y, left, right = [a[i]], [b[j]], len(bytes_a[i]), len(bytes_b[j])
                while left != right:
                    if left < right:
                        i += 1
                        x.append(a[i])
                        left += len(bytes_a[i])
                    else:
                        j += 1
                        y.append(b[j])
                        right += len(bytes_b[j])
                groups.append((x, y))
                i, j = i + 1, j + 1
        cut.append(groups)
    counts = collections.Counter(p for groups in cut for p in {(s, t) for x, y in groups for s in x for t in y})
    best = collections.defaultdict(int)
    for (s, _), n in counts.items():
        best[s] = max(best[s], n)
    out = []
    for groups in cut:
        links = [(s, t) for x, y in groups for s in x for t in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return out, dict(counts)


def hard_negatives(rows, positives=5, negatives=10, every=100):
    """The contract's rows from (vec_id, label, vector), in Python's integers, all scores made and sorted."""
    good = []
    for i, label, vector in rows:
        if i is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    anchors = {}
    for r in good:
        if r[0] % every == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r, key=lambda r: r[1:])
    out = []
    for i, label, vector in anchors.values():
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), j, k) for j, k, v in good if j != i)
        same = [(-s, j) for s, j, k in scored if k == label][:positives]
        for p, chosen in same:
            near = [(-s, j) for s, j, k in scored if k != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(i, chosen, rank, j, p, s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)
