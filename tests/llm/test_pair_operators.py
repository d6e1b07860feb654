"""Token alignment, hard negatives and SimHash against plain versions."""

import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import odd_rows
from wayweft.llm import hard_negatives, simhash, token_alignment
from wayweft.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
needs_vocabularies = pytest.mark.skipif(not Path(token_alignment.FOLDER).exists(), reason="needs the vocabulary files")
VECTORS = "vec_id long, label int, embedding array<float>"


# SimHash


def test_every_close_pair_agrees_under_a_mask():
    for radius in (1, 2, 3, 4):
        family = simhash.masks(radius)
        assert len(family) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(3000):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flips & m for m in family)
    assert all(any(not (1 << a | 1 << b) & m for m in simhash.masks(2)) for a, b in combinations(range(64), 2))


@needs_tables
def test_simhash_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute.fingerprints([(r.doc_id, r.text) for r in docs.collect()], 4, 4)
    assert sorted(map(tuple, QUERIES["op13_simhash"][0](spark, FOLDER).collect())) == want


def _reached(prints, radius):
    low = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if low[b] < low[a] and ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                    low[a], changed = low[b], True
    return {p: c for p, c in low.items()}


@pytest.mark.parametrize(("radius", "few"), [(4, 256), (4, 0), (3, 0), (2, 1)])
def test_links_of_crowded_buckets(spark, monkeypatch, radius, few):
    """Fingerprints around a few values, and chains: groups are those of all pairs, whichever way they are found."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(5)
    prints = {0, -1}
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(18):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            prints.add(base - 2**64 if base >> 63 else base)
    from wayweft.llm.graph import components

    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "bits long"), radius)
    got = {r.node: r.component for r in components(edges).collect()}
    assert {p: got.get(p, p) for p in prints} == _reached(prints, radius)


def test_simhash_of_odd_rows(spark, odd, clashing, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    groups = {(r.doc_id, r.component_id) for r in rows}
    # 1 and 2 hold one text; 3, 4 and 5 have none; 7 has two texts and is one document.
    assert groups == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, None), (6, 6), (7, 7)}
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert sorted(map(str, simhash.near_duplicates(clashing).collect())) == sorted(map(str, rows))
    assert simhash.near_duplicates(none).count() == 0
    # A document of two texts joins the groups of both.
    two = [(1, "one two three four five"), (5, "one two three four five"), (5, "six seven eight nine ten"), (9, "six seven eight nine ten")]
    got = simhash.near_duplicates(spark.createDataFrame(two, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (9, 1)}


# Token alignment

TEXTS = [
    "The quick brown fox.", "Zürich naïve façade — 12,345.67 €", "", None, "<|endoftext|> is text, <s> too </s> <unk> <0x41>", "日本語のテキスト 🤖🤖 and more",
    "two  spaces\tand\ttabs\r\nlines\n\n\nend ", " leading", "under▁score", "a" * 5000, " " * 12000 + "x", "\x00\x01 control", "The quick brown fox.", "ﬁ ligature ①", "x",
]


@needs_vocabularies
@pytest.mark.parametrize("held", [1 << 20, 7, 0])
def test_alignment_of_odd_texts(spark, held):
    """Whatever number of pairs the tasks hold, sums are those of the plain version."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows, pairs = token_alignment.align(docs, held_pairs=held)
    want, counts = brute.alignment(TEXTS, token_alignment.FOLDER)
    got = {r.doc_id: r for r in rows.collect()}
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, TEXTS[i]
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts


@needs_tables
@needs_vocabularies
def test_alignment_of_the_table(spark, monkeypatch):
    """The whole table, with parts so small that counts are handed on and groups expanded piece by piece."""
    monkeypatch.setattr(token_alignment, "PART", 2000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute.alignment([r.text for r in docs], token_alignment.FOLDER)
    got = {r.doc_id: r for r in QUERIES["op11_token_alignment"][0](spark, FOLDER).collect()}
    for d, w in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w


@needs_vocabularies
def test_alignment_of_odd_rows(odd, clashing, none):
    rows, pairs = token_alignment.align(odd)
    got = sorted(map(str, rows.collect()))
    assert len(got) == len(odd_rows()) and pairs.count() > 0
    assert sorted(map(str, token_alignment.align(clashing)[0].collect())) == got
    empty, no_pairs = token_alignment.align(none)
    assert empty.count() == 0 and no_pairs.count() == 0


@needs_vocabularies
def test_fast_encoder_is_the_reference_one():
    """The encoder in use gives the ids of the file's own one, character by character of the first planes."""
    from tokenizers import Tokenizer

    first, second = (Path(token_alignment.FOLDER, n).read_bytes() for n in (token_alignment.FIRST, token_alignment.SECOND))
    v = token_alignment.vocabularies(first, second)
    plain = Tokenizer.from_str(first.decode())
    plain.encode_special_tokens = True
    texts = ["".join(f" a{chr(c)}1{chr(c)}{chr(c)} " for c in range(i, i + 16)) for i in range(0, 0x30000, 16) if not 0xD800 <= i < 0xE000]
    want = plain.encode_batch(texts, add_special_tokens=False)
    assert all(v.encode_a(t) == w.ids for t, w in zip(texts, want))


# Hard negatives


def _vectors(n, seed, width=8, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, rng.randrange(10), [float(c + spread * rng.gauss(0, 1)) for c in rng.choice(centres)]) for i in range(n)]


def _mined(spark, rows, kind="vec_id long, label int, embedding array<double>", **options):
    return sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, kind).repartition(5), **options).collect()))


@pytest.mark.parametrize(("spread", "options"), [(1.0, {}), (0.02, {}), (0.02, {"every": 3, "block": 8, "round_values": 400}), (0.3, {"every": 5, "block": 16, "round_values": 1000})])
def test_negatives(spark, spread, options):
    """Loose and tight vectors, one round and many, small blocks."""
    rows = _vectors(900, 3, spread=spread)
    assert _mined(spark, rows, **options) == brute.hard_negatives(rows, every=options.get("every", 100))


def test_bounds_leave_scores_out():
    """On vectors in tight groups, the tree makes only a part of all scores."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 256
    near = np.floor(centres[rng.integers(0, 20, 400)] + rng.normal(size=(400, 16)))
    tree = hard_negatives.Tree(np.arange(400), np.zeros(400, np.int64), near, np.zeros(400, np.int64))
    q = np.floor(rng.normal(size=(300, 16)) * 256)
    exact = tree.q @ q.T
    low = np.quantile(exact, 0.98, axis=1)
    high = np.full(400, 2.0**62)
    scores, made = tree.scores(q, low, high, np.ones(exact.shape, bool))
    assert made.mean() < 0.4
    assert (scores[made] == exact[made]).all() and not ((exact >= low[:, None]) & ~made).any()


def test_negatives_of_odd_rows(spark):
    """Nulls, non-finite components, ties, repeats, equal anchors, short and huge vectors."""
    nan, inf = float("nan"), float("inf")
    rows = _vectors(300, 5, 4)
    rows += [(i, 1, [1.0, 0.5, -0.5, 0.25]) for i in range(1000, 1400)]  # a crowd of equal vectors, four of them anchors
    rows += [(2000, None, [1.0] * 4), (None, 1, [1.0] * 4), (2100, 1, None), (2200, 1, [1.0, None, 0.0, 0.0]), (2300, 1, [nan, 0.0, 0.0, 0.0]), (2400, 1, [inf, 0.0, 0.0, 0.0])]
    rows += [(2500, 2, [0.5, 0.5]), (2501, 2, []), (2600, 3, [])] + [(100, 4, [0.1, 0.2, 0.3, 0.4]), (5, 6, [0.4, 0.3, 0.2, 0.1]), rows[5]]
    assert _mined(spark, rows) == brute.hard_negatives(rows)
    wide = [(i, i % 3, [x * 3e6 for x in v]) for i, _, v in rows[:300]]
    assert _mined(spark, wide) == brute.hard_negatives(wide)
    clashing = spark.createDataFrame(rows[:300], "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(clashing.withColumns({c: F.lit("x") for c in ("w", "score", "q", "block", "centre", "rank")}))
    assert sorted(map(tuple, got.collect())) == brute.hard_negatives(rows[:300])
    assert _mined(spark, [], VECTORS) == []
    assert _mined(spark, [(1, 1, [1.0])], VECTORS) == []


@needs_tables
def test_negatives_of_the_table(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"][0](spark, FOLDER).collect())) == brute.hard_negatives(rows)
