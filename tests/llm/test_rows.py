"""Odd rows through every operator and stage: nulls, blank and long texts, repeats, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import CLASHES, odd_rows
from wayweft.llm import decontaminate, fixity, html_text, language_model, licenses, line_dedup, mixing, near_dedup, quality, span_dedup

OPERATORS = {
    "lines": line_dedup.dedup_lines,
    "quality": quality.judged,
    "near": lambda d: near_dedup.near_duplicates(d, 4, 80),
    "spans": span_dedup.dedup_spans,
    "scores": lambda d: language_model.scores(d, rounds=1),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_keep_their_number(odd, clashing, none, name):
    run = OPERATORS[name]
    assert run(odd).count() == len(odd_rows())
    assert run(clashing).count() == len(odd_rows())
    assert run(none).count() == 0


def test_clashing_columns_are_carried(clashing):
    out = span_dedup.dedup_spans(clashing)
    kept = [c for c in CLASHES if c != "sources"]
    assert out.where(" or ".join(f"`{c}` <> 'x'" for c in kept)).count() == 0
    assert out.columns == [c for c in clashing.columns if c != "sources"] + ["n_sentences", "n_removed", "sources"]


def test_mixture(odd, clashing, none):
    out = mixing.mixture(odd)
    assert out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 4  # two equal rows, two copies each
    named = mixing.mixture(clashing)
    assert dict(named.dtypes)["shard"] == "int" and named.where("size <> 'x'").count() == 0
    assert mixing.mixture(none).count() == 0


def test_leaks_and_licences(odd, clashing, none, spark):
    items = spark.createDataFrame([(1, odd_rows()[0][1]), (None, "a short item"), (3, None), (4, "")], "item_id long, text string")
    got = decontaminate.leaks(odd, items)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got.collect()) == [(False, 1, 1), (False, 2, 1), (True, 0, 1)]
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(clashing, items).where("text like 'w%' and length(text) < 2000").count() == 0
    model = licenses.fit(odd)
    assert licenses.scan(odd, model).count() == 0
    assert licenses.scan(none, model).count() == 0


def test_pages(spark):
    kind = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (None, "u", "", None), (2, "u", "<p>", "x"), (2, "u", "<p>", "x"), (3, "u", "<article>" + "<p>One more line of the text.</p>" * 5000, "x")]
    pages = spark.createDataFrame(rows, kind)
    out = {(r.page_id, r.n_chars) for r in html_text.extract(pages).collect()}
    assert out == {(1, 0), (None, 0), (2, 0), (3, 5000 * 27 - 1)}
    assert fixity.fixity_report(pages).agg(F.sum("n_records")).first()[0] == 5
    assert fixity.fixity_report(pages.limit(0)).count() == 0


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages(odd, none, place, tmp_path, spark):
    spark.createDataFrame([(1, "an item that no text has at all in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, odd, str(tmp_path))
    extra = ["shard", "copy"] if name == "source_mix" else []
    assert out.columns == odd.columns + extra
    assert out.count() >= 1
    assert stage(spark, none, str(tmp_path)).count() == 0
