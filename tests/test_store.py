"""Versions of stored tables, and stored text indexes."""

import random

import pytest
from pyspark.sql import functions as F

from wayweft.operators import search
from wayweft.plans.snapshot import Snapshot
from wayweft.sinks import store, text_index
from wayweft.sinks.versions import Conflict, Versions


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    one, two = Versions(spark, folder), Versions(spark, folder)
    assert one.current() == (0, {})
    assert one.commit({"a": 1}, 0).number == 1
    with pytest.raises(Conflict):
        two.commit({"a": 2}, 0)
    assert two.commit({"a": 2}, 1).number == 2
    (tmp_path / "v" / "_versions" / "3.json").write_text('{"a": 3')  # a writer that broke off
    assert one.current() == (2, {"a": 2})
    assert one.commit({"a": 4}, 2) == (4, {"a": 4}) and two.current() == (4, {"a": 4})


def test_reader_during_an_overwrite(spark, tmp_path, snapshot):
    """A reader keeps its version while another one is written, and the next reader sees the new one."""
    folder = str(tmp_path / "s")
    assert store.read_snapshot(spark, folder) is None
    store.write_snapshot(snapshot, folder)
    old = store.read_snapshot(spark, folder)
    before = old.nodes.count()
    less = Snapshot(snapshot.files, snapshot.nodes.where("kind = 'script'"), snapshot.edges, snapshot.warnings)
    store.write_snapshot(less, folder)
    assert old.nodes.count() == before and old.symbol_postings.count() > 0
    new = store.read_snapshot(spark, folder)
    assert 0 < new.nodes.count() == snapshot.nodes.where("kind = 'script'").count() < before
    assert Versions(spark, folder).clean() == 1
    assert store.read_snapshot(spark, folder).nodes.count() == new.nodes.count()
    assert store.clear_store(spark, str(tmp_path)) == 1 and store.read_snapshot(spark, folder) is None


def test_stored_indexes_answer_like_fresh_ones(spark, tmp_path, snapshot):
    folder = str(tmp_path / "s")
    store.write_snapshot(snapshot, folder)
    stored = store.read_snapshot(spark, folder)
    for kind in ("symbol", "doc"):
        fresh, kept = (sorted(map(str, getattr(s, f"{kind}_postings").collect())) for s in (snapshot, stored))
        assert fresh == kept and fresh
        assert getattr(snapshot, f"{kind}_stats") == getattr(stored, f"{kind}_stats")


def _texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("be", "ca", "do", "fu") for b in ("r", "rt", "st", "mm", "lo")]
    return [(i, " ".join(rng.choices(vocabulary, range(1, 21), k=rng.randrange(1, 60))) + " all") for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_index_in_parts(spark, tmp_path, monkeypatch, block):
    """Appended and merged segments, blocks of any size, and the best rows by bounds, against the scan."""
    monkeypatch.setattr(text_index, "BLOCK", block)
    monkeypatch.setattr(text_index, "PROBED", 2)
    tok = search.tokenised(spark.createDataFrame(_texts(400, 1), "doc_id long, text string"), "text").select("doc_id", "tokens", "dl")
    folder = str(tmp_path / "i")
    for part in range(6):
        index = text_index.append(spark, folder, tok.where(F.col("doc_id") % 6 == part), "doc_id")
    assert [s["level"] for s in Versions(spark, folder).current().state["segments"]] == [1, 0, 0]
    assert index.stats == search.CorpusStats.of(tok)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, search.postings(tok, "doc_id").collect()))
    for query, all_words in (("bert all", True), ("ca fumm", False), ("nothing", False), ("", False)):
        want = {r.doc_id: round(r.score, 9) for r in search.scan_scores(tok, "doc_id", query, all_words).collect()}
        assert {r.doc_id: round(r.score, 9) for r in index.search([query], all_words).collect()} == want
        if not all_words:
            best = sorted((s, d) for d, s in want.items())[:10]
            assert [(round(r.score, 9), r.doc_id) for r in index.top(query, 10).collect()] == best


def test_index_plan_and_misuse(spark, tmp_path):
    tok = search.tokenised(spark.createDataFrame(_texts(50, 2), "doc_id long, text string"), "text").select("doc_id", "tokens", "dl")
    index = text_index.append(spark, str(tmp_path / "i"), tok, "doc_id")
    plan = index.search(["bert"], False)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,bert)" in plan and "regexp_extract_all" not in plan
    with pytest.raises(ValueError):
        text_index.append(spark, str(tmp_path / "i"), tok, "doc_id", stem=True)
    assert text_index.TextIndex.open(spark, str(tmp_path / "none")) is None
    empty = text_index.append(spark, str(tmp_path / "e"), tok.limit(0), "doc_id")
    assert empty.top("bert", 5).count() == 0 and empty.search(["bert"], True).count() == 0


def test_index_words_are_counted_where_rows_are(spark, tmp_path, monkeypatch):
    """No token is shuffled (F10, F11, F12); stretches of a few tokens, a key of two rows and rows without words give the same postings."""
    monkeypatch.setattr(text_index, "STRETCH", 7)
    monkeypatch.setattr(text_index, "PIECE", 2)
    texts = [(1, "run a runs b a running"), (2, ""), (3, None), (4, "b run c d e f g h i j k"), (5, "a runs")]
    for rows in (texts, [*texts, (1, "a c a b runs d")]):
        tok = search.tokenised(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "text").select("doc_id", "tokens", "dl")
        for stem in (False, True):
            index = text_index.append(spark, str(tmp_path / f"{len(rows)}{stem}"), tok, "doc_id", stem)
            assert index.stats == search.CorpusStats.of(tok)
            assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, search.postings(tok, "doc_id", stem).collect()))
            once, _ = text_index._once(tok, "doc_id")
            if len(rows) == len(texts):
                assert "Exchange" not in text_index._pieces(once, stem)._jdf.queryExecution().executedPlan().toString()
