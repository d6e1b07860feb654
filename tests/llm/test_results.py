"""Results against SQL, brute force and held-out texts."""

import html
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.oracle import compare, connect
from wayweft.llm import decontaminate, fixity, graph, html_text, language_model, licenses, line_dedup, mixing, near_dedup, quality, span_dedup
from wayweft.llm.catalog import QUERIES
from wayweft.llm.words import shingle_sets
from wayweft.llm.words import words as word_arrays

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if sql))
def test_sql(spark, con, name):
    run, sql = QUERIES[name]
    assert compare(run(spark, FOLDER), con, sql) == ""


def test_word_arrays_follow_pieces(monkeypatch):
    """Small pieces cut at white space give the same words as one large piece."""
    from wayweft.llm import words as module

    texts = ["One two  three\tFOUR\nfive " * 50, None, "", "x" * 500 + " " + "é" * 90, "tail"]
    whole = word_arrays(pa.array(texts))
    monkeypatch.setattr(module, "PIECE", 64)
    pieces = word_arrays(pa.array(texts))
    assert all((a == b).all() for a, b in zip(whole, pieces))
    assert np.diff(whole[1]).tolist() == [len(brute.words(t)) for t in texts]
    flat = [w for t in texts for w in brute.words(t)]
    assert len(set(whole[0].tolist())) == len(set(flat))
    assert [len(s) for s in shingle_sets(whole[0], whole[1], 4)] == [5, 0, 0, 1, 1]


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, QUERIES["op3_near_dedup"][0](spark, FOLDER).collect()))
    assert got == brute.near_duplicates(rows, 4, 80)


def test_loose_copies(spark):
    """A crowd of copies with many edits: every link is found, also between two that share no link with the first."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert sorted(map(tuple, got.collect())) == brute.near_duplicates(rows, 4, 80)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {v for e in edges if e[0] != e[1] for v in e}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((v, find(v)) for v in linked)


def test_leaks(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    flat = lambda rows, k: {r[k]: " ".join(r.text.split()) for r in rows}
    texts, wanted = flat(docs.collect(), "doc_id"), flat(items.collect(), "item_id")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(d, i) for d, t in texts.items() for i, w in wanted.items() if w in t}


def test_leaks_with_other_slots(spark):
    question = "A farmer called Smith sells 12 baskets of apples for 5 dollars each and then buys 12 more baskets, how much money does the farmer Smith have left at the end"
    changed = question.replace("12", "31").replace("Smith", "Miller").replace("5 dollars", "8 euros")
    broken = question.replace("12", "31", 1).replace("Smith", "Miller", 1).replace("5 dollars", "8 euros")
    clean = "A farmer went to the market in the morning and came home late in the evening without any of the apples that were in the cart before"
    rows = [(1, f"Some words before it. {question}. And after."), (2, f"Other words. {changed}?"), (3, f"So then. {broken}."), (4, clean)]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, question)], "item_id long, text string"))
    assert sorted((r.doc_id, r.exact) for r in got.collect()) == [(1, True), (2, False)]


def test_leaks_of_short_blank_and_slot_dense_items(spark):
    items = [
        (1, "Ein Bauer hat 12 Huehner und 7 Kuehe"), (2, "Calculate 12 + 7 - 4 * 31 / 2 + 9 - 55 + 3"), (3, "What is 12 + 7?"), (4, ""), (5, None), (6, " \n "),
        (7, "Anna, Berta und 12 Freunde kaufen 7 Karten, dann noch 4 Karten, und Anna zahlt 31 Euro, aber wie viel zahlt Berta?"),
        (8, "the plain few"), (9, "A farmer who has many old cows sells some of them at the market"),
    ]
    alone = [(i, t) for i, t in items if t and len(t.split()) >= 8]
    texts = {i: f"Some words that come before: {t} And then some words after it." for i, t in items if t and t.strip()}
    texts |= {20: texts[7].replace("12", "13").replace("31", "40"), 21: "Ein Bauer hat sehr viel zu tun und What is that", 22: texts[1].replace("7", "8")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for given in (items, alone):
        ids = {i for i, t in given if t and t.strip()}
        got = decontaminate.leaks(docs, spark.createDataFrame(given, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id, r.exact) for r in got} == {(i, i, True) for i in ids} | {(20, 7, False)}


def test_spans(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(say(9) for _ in range(6))
    flat = " ".join(word() for _ in range(60))  # no full stop at all
    rows = [(d, " ".join([say(12), say(7), extra, say(11), say(8)])) for d, extra in enumerate([passage, say(30), passage, flat, flat, say(9)])]
    got = {r.doc_id: r for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, r in got.items() if r.n_removed} == {2, 4}
    assert got[2].sources == [0] and got[4].sources == [3]
    assert got[0].text == rows[0][1] and got[2].text == rows[2][1].replace(f"{passage} ", "")
    assert len(got[4].text.split()) < len(rows[4][1].split()) - 30
    again = spark.createDataFrame([(1, f"{passage} {say(9)} {passage} {say(9)}")], "doc_id long, text string")
    out = span_dedup.dedup_spans(again).first()
    assert out.n_removed == 6 and out.text.count(passage) == 1 and out.sources == []


def test_span_tails_and_unmarked_passages(spark):
    """The short last sentences of a passage go too, and a passage of 51 words within unmarked text is always found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    flat = lambda n: " ".join(word() for _ in range(n))
    passage = " ".join([say(15), say(15), say(3), say(2)])
    rows = [(0, f"{say(9)} {passage} {say(9)}"), (1, f"{say(8)} {passage} {say(9)}"), (2, f"{say(8)} {passage} {say(9)} {passage} {say(7)}")]
    wanted = {d: " ".join(t.replace(passage, "").split()) for d, t in rows if d}
    for k in range(100):
        shared = flat(51) if k % 4 else " ".join(rng.choice("xyz") + str(k) for _ in range(51))
        rows += [(10 + 2 * k, f"{flat(30)} {shared} {flat(30)}"), (11 + 2 * k, f"{flat(33)} {shared} {flat(33)}")]
    got = {r.doc_id: r for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d].text for d in wanted} == wanted and got[1].n_removed == 4 and got[2].sources == [0]
    assert all(got[11 + 2 * k].n_removed and got[11 + 2 * k].sources == [10 + 2 * k] for k in range(100))


def test_base_and_model_scores(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.base_scores(rows)
    got = {r.doc_id: r for r in QUERIES["op9_lm_scores"][0](spark, FOLDER).collect()}
    for d, (out, n, known, total, score) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    fresh = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_model_adds_up_to_one():
    p = language_model.first_parameters(np.full(language_model.UNITS, 1 / language_model.UNITS))
    contexts = np.zeros((language_model.ORDER, language_model.UNITS), np.int16) + 7
    logs = language_model.log_probabilities(p, np.arange(language_model.UNITS), contexts)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    out = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inside = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        assert out[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", inside)).split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav><a href=x>Home</a></nav><main><p>A &lt;b&gt; &amp; c&nbsp;d.</p><aside>More</aside><div class='share-bar'>Share it.</div></main>", "A <b> & c d."),
        ("<div class='content has-sidebar'><h2>On cats</h2><p>The cat of the house is on the mat and it was happy there.</p></div><div id=comments><p>It is the best that I have read of the lot in this.</p></div>", "On cats The cat of the house is on the mat and it was happy there."),
        ("<script>var x = '<p>no</p>'</script><article><header><h1>Title of it</h1></header><p>One.<p>Two<br>three.</article><footer>The end of the page.</footer>", "Title of it One. Two three."),
        ("<article><p>The story of it all.</p><form><p>Enter the name of it.</p></form><ul class='related'><li><a href=1>Other</a></ul>", "The story of it all."),
        ("no markup at all but the text of a page", "no markup at all but the text of a page"),
        ("<p>cut off <b", "cut off"),
    ],
)
def test_page_parts(page, text):
    assert html_text.main_text(page) == text


STORY = "The cat of the house is on the mat and it was happy there for all of the day."
FOREIGN = "Kissa istui talon edessä koko päivän, katseli lintuja, söi kalaa, joi maitoa, nukkui sohvalla."
SCRIPT = "猫は一日中家の前に座って鳥を眺め、魚を食べ、牛乳を飲み、夕方になるとソファの上で眠った。翌朝になると猫はまた庭に出て、隣の犬と長い間見つめ合っていた。"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=content><h2>Cats</h2><p>{STORY}</p></div><section><article><h3>Next story</h3></article></section>", f"Cats {STORY} Next story"),
        (f"<div>Top</div><article><p>{STORY}</p></article><div>Tail of it</div><div><a href=1>All of the links of the house and of the mat are in this one line</a></div>", STORY),
        (f"<nav>Etusivu</nav><div><p>{FOREIGN}</p><p>{FOREIGN}</p></div><footer>Loppu</footer>", f"{FOREIGN} {FOREIGN}"),
        (f"<nav>家</nav><div><p>{SCRIPT}</p></div><footer>終</footer>", SCRIPT),
        ("<nav>Home</nav><article>Short</article><footer>End</footer>", "Short"),
    ],
)
def test_pages_by_blocks(page, text):
    """Stories outside an article, and in languages or scripts without known stop words."""
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><div class='promotion-content'><p>{STORY}</p></div></article>", STORY),
        (f"<article><p>{STORY}</p><div class='promotion-content'><p>Buy it.</p></div></article>", STORY),
        (f"<article><div class='promotion-content'><p>{STORY}</p><aside>{STORY}</aside><div class='comments'>{STORY}</div></div></article>", STORY),
        (f"<div class='promotion-content'><p>{STORY}</p></div><p>{STORY}</p>", STORY),
        (f'<article><p class="a>{STORY}</p></article>', STORY),
    ],
)
def test_doubted_and_broken_parts(page, text):
    """A class name that articles are about as well is a doubt inside an article; a quote that stays open ends with its tag."""
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("part", ["<div></span>", "<svg>", "<svg/>", "<button>x", "</b></i>", "<script/></script>", "<p>a</p></section>", "<div></p>"])
def test_pages_in_linear_time(part):
    """A megabyte of open, stray and unclosed tags."""
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    html_text.main_text(f"<article><p>{STORY}</p>{page}")
    assert time.process_time() - began < 8


def test_repeated_rows_are_one_document(spark):
    line = "a line of more than forty characters that is met in many documents"
    rows = [(1, line)] * 4 + [(2, line)] + [(d, f"x\n{line} too") for d in (3, 3, 4, 5, 6, 7)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_dropped) for r in out.collect())
    assert got == [(1, 0)] * 4 + [(2, 0), (3, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 0)]


def test_licences(spark, docs):
    lines = [line for r in docs.collect() for line in r.text.split("\n")]
    # The corpus states licences by these four sentences.
    known = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    }
    model = licenses.fit(docs)
    got = sorted((r.line, r.family) for r in licenses.scan(docs, model).collect())
    assert got == sorted((line, known[line]) for line in lines if line in known)
    others = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction", "mit"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
        ("The licence of the pub was renewed by the public office under the general terms of the town.", None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(others)], "doc_id long, text string")
    assert {r.doc_id: r.family for r in licenses.scan(rows, model).collect()} == {i: f for i, (_, f) in enumerate(others) if f}


def test_short_licences(docs):
    """Statements without word trigrams are compared whole."""
    lines = [(f"{mark}{text}", family) for family, texts in licenses.SHORT.items() for text in texts for mark in ("", "// ")]
    others = [("the License", None), ("MIT", None), ("SPDX-License-Identifier: Foo", None), ("MIT pub", None), ("License", None)]
    rows = docs.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(lines + others)], "doc_id long, text string")
    model = licenses.fit(docs)
    # At most PASS of the paragraphs kept out are above the lowest threshold, so it holds.
    assert model.threshold == 0.5
    assert {r.line: r.family for r in licenses.scan(rows, model).collect()} == dict(lines)


def test_lines_in_batches(spark, con, docs):
    """Any number of batches, and so of runs and merges, gives the same lines."""
    want = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_dropped").collect()
    got = line_dedup.dedup_lines(docs, batches=8).select("doc_id", "text", "n_dropped").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.sql("SHOW TABLES").where("tableName like 'line_%'").count() == 0


def test_shards_hold_exact_quotas(spark):
    quotas = spark.createDataFrame([(0, 300), (1, 7), (2, 90)], "rank long, quota long")
    rows = mixing.shard_quotas(quotas, shards=5).collect()
    assert {r: sum(x.blocks for x in rows if x.rank == r) for r in (0, 1, 2)} == {0: 300, 1: 7, 2: 90}
    sizes = [sum(x.blocks for x in rows if x.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 3
    for r in (0, 1, 2):
        spans = sorted((x.first, x.first + x.blocks) for x in rows if x.rank == r)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0


def test_hypergeometric_law(spark):
    sql = mixing.hypergeometric("50L", "20L", "10L", "u")
    got = spark.range(4000).selectExpr("(id + 0.5D) / 4000 AS u").selectExpr(f"{sql} AS k").groupBy("k").count().collect()
    from math import comb

    for r in got:
        assert r["count"] / 4000 == pytest.approx(comb(20, r.k) * comb(30, 10 - r.k) / comb(50, 10), abs=5e-4)


def test_mixture_rows(spark, docs):
    plan = {r.doc_id: r.taken for r in QUERIES["op1_mix_sources"][0](spark, FOLDER).collect()}
    size = {r.doc_id: len(brute.words(r.text)) for r in docs.collect()}
    drawn = {}
    for r in mixing.mixture(docs).select("doc_id").collect():
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + size[r.doc_id]
    assert drawn == {d: n for d, n in plan.items() if n}


def test_mix_comes_near_its_targets(spark, tmp_path):
    """One long document among short ones, in six sources; what is missing is less than any document left over."""
    rows = [(100 * k + i, f"s{k}", 1000 if i == 20 else 100 + 7 * (i % 3) * (k % 2)) for k in range(6) for i in range(21)]
    rows += [(1, "s0", 30), (700, None, 0), (701, "s1", 0), (None, "s2", 50), (None, "s2", 60)]
    docs = spark.createDataFrame([(d, s, "w " * n) for d, s, n in rows], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_mix_sources"][0](spark, str(tmp_path)).collect()
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = connect(str(tmp_path)).sql(f"SELECT {', '.join(names)} FROM ({mixing.SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in got)
    source = {d: t for d, t, _ in rows}
    assert len(got) == len(rows)
    for name in {t for _, t, _ in rows}:
        mine = [r for r in got if source[r.doc_id] == name]
        taken, target = sum(r.taken for r in mine), mine[0].target
        passes = int(target // mine[0].source_size) if mine[0].source_size else 0
        left = [r["size"] for r in mine if r["size"] and r.doc_id is not None and r.taken == r["size"] * passes]
        assert taken <= target and (taken > target - min(left) if left else taken == target)


def test_shards_are_cut_by_bytes_and_keep_their_order(spark, docs):
    whole, cut = mixing.mixture(docs, shards=3), mixing.mixture(docs, shards=3, part_bytes=20_000)
    assert whole.rdd.getNumPartitions() == 3 and cut.rdd.getNumPartitions() > 10
    key = ["doc_id", "shard", "copy"]
    assert whole.select(key).collect() == cut.select(key).collect()


def test_rules_are_ordered_by_what_they_reject_for_what_they_read(spark):
    """Rows of 100 characters: a rule that reads nothing costs 1 a row, one that reads the text 101."""
    rows = spark.range(200).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "id >= 100 AS base_failed")
    rule = quality.Rule
    none = lambda: F.lit(0)
    rules = [
        rule("never", lambda: F.lit(False), none), rule("half_dear", lambda: F.col("doc_id") < 50), rule("same_half", lambda: F.col("doc_id") < 51),
        rule("few_cheap", lambda: F.col("doc_id") >= 98, none), rule("failed_only", lambda: F.col("doc_id") >= 100, none),
        rule("most_cheap", lambda: F.col("doc_id") < 40, none), rule("null", lambda: F.lit(None).cast("boolean")),
    ]
    # After most_cheap, the two halves are worth 10 and 11 of the rows left; then nothing but few is rejected.
    got = [r.name for r in quality.ordered(rows, rules)]
    assert got == ["most_cheap", "few_cheap", "same_half", "never", "failed_only", "half_dear", "null"]
    assert [r.name for r in quality.ordered(rows.limit(0), rules)][0] == "never" and quality.ordered(rows, []) == []


def test_fixity_finds_what_was_changed(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    records = fixity.packed(pages, per_file=20)
    left = records.select("file", "offset", "length", "digest")
    right = left.where("offset % 7 <> 3").withColumn("digest", F.when(F.col("offset") % 5 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    roots, faults = fixity.audit(left, right)
    want = sorted((r.file, r.offset, "missing" if r.offset % 7 == 3 else "changed") for r in left.collect() if r.offset % 7 == 3 or r.offset % 5 == 0)
    assert sorted((r.file, r.offset, r.status) for r in faults.collect()) == want
    assert fixity.audit(left, left)[1].count() == 0
    assert {r.file for r in roots.where("left_digest <> right_digest").collect()} == {f for f, *_ in want}


def test_rule_order_changes_no_verdict(docs):
    want = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    got = {r.doc_id: r.kept for r in quality.judged(docs, list(reversed(quality.RULES))).collect()}
    assert got == want


def test_pipeline(spark, con, docs):
    """All five stages against their plain versions, one after the other."""
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE TABLE documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    db.sql(f"DELETE FROM documents WHERE doc_id IN (SELECT doc_id FROM ({quality.SQL}) WHERE NOT kept)")
    marked = line_dedup.SQL.replace("sha256(", "(")
    db.sql(f"CREATE TABLE lines AS {marked}")
    db.sql("UPDATE documents SET text = l.kept_sha256 FROM lines l WHERE l.doc_id = documents.doc_id")
    rows = db.sql("SELECT doc_id, text FROM documents").fetchall()
    kept = {d for d, _, _, k in brute.near_duplicates(rows, 5, 80) if k}
    items = [" ".join(r[0].split()) for r in con.sql("SELECT text FROM benchmark").fetchall()]
    kept = {d for d, t in rows if d in kept and not any(i in " ".join(t.split()) for i in items)}
    db.sql(f"DELETE FROM documents WHERE doc_id NOT IN ({','.join(map(str, kept))})")
    taken = {d: n for d, n in db.sql(f"SELECT doc_id, taken // greatest(size, 1) FROM ({mixing.SQL})").fetchall() if n}
    texts = dict(db.sql("SELECT doc_id, text FROM documents").fetchall())
    got = corpus_pipeline.run(spark, FOLDER).collect()
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert copies == taken


def test_leaks_of_a_slot_dense_item_beside_another_one(spark):
    """A document that holds a template window of one item is still searched for the longer windows of another."""
    dense = "12 apples 13 Paris 14 cost 15 London 16 when 17 Rome 18 sold 19 Oslo 20 today"
    plain = "the quick brown fox jumps over the lazy dog while many small birds sing above"
    items = spark.createDataFrame([(1, dense), (2, plain)], "item_id long, text string")
    other = "32 apples 33 Berlin 34 cost 35 Madrid 36 when 37 Lima 38 sold 39 Cairo 40 today"
    docs = spark.createDataFrame([(1, f"we saw {other}"), (2, f"we saw {other} and {plain}")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (2, 2)}


def test_all_paragraphs_teach_the_unknown_class(spark):
    """What only a few of many documents say is counted as well."""
    filler = [(i, "\n".join(["plain words that name no terms"] * 40)) for i in range(500)]
    odd = [(i, "the pub has licensed waiters under general conditions") for i in range(1000, 1400)]
    docs = spark.createDataFrame(filler + odd, "doc_id long, text string")
    counts = {}
    store = licenses.materialise

    def stored(df):
        out = store(df)
        if "kept_out" in out.columns:
            counts["all"] = sum(r.n for r in out.collect()) if "n" in out.columns else out.count()
        return out

    licenses.materialise = stored
    try:
        licenses.fit(docs)
    finally:
        licenses.materialise = store
    assert counts["all"] == 500 * 40 + 400


def test_signs_leave_no_statement_out(docs):
    model = licenses.fit(docs)
    signs = licenses._signs(model)
    said = [t for per in model.trigrams.values() for trigrams in per for t in trigrams] + [t for per in model.short.values() for t in per]
    assert [t for t in said if not any(set(words) <= set(t.split(" ")) for words in signs)] == []


def test_licences_are_found_in_the_pass_that_learns(spark, docs, monkeypatch):
    """One pass over all paragraphs gives what a second one with the model would."""
    said = [f"{mark}{text}" for texts in licenses.SHORT.values() for text in texts for mark in ("", "// ")]
    said += ["Licensed // under -- the Apache License, Version 2.0.", "LICENSED UNDER CC BY-NC 4.0.", "the License", "a pub under the Apache License"]
    rows = [(i, f"first\n\n{t}") for i, t in enumerate(said)] + [(None, "Released under the MIT License.")] * 3 + [(7, None), (8, "")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    # The regression adds up in any order, so probabilities differ in late digits.
    found = lambda out: sorted(map(repr, out.withColumn("probability", F.round("probability", 2)).collect()))
    want = found(licenses.scan(rows, licenses.fit(rows)))
    calls, whole = [], licenses.paragraphs
    monkeypatch.setattr(licenses, "paragraphs", lambda *a: calls.append(a) or whole(*a))
    assert found(licenses.scan(rows)) == want
    assert len(calls) == 1 and want
