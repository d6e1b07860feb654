"""The registered queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayweft.llm import decontaminate, fixity, hard_negatives, html_text, language_model, licenses, line_dedup, mixing, near_dedup, quality, simhash, span_dedup, token_alignment
from wayweft.llm.shared import table


def op1_mix_sources(spark, folder):
    sized = mixing.with_sizes(table(spark, folder, "documents"))
    out = mixing.drawn(sized, mixing.mix_plan(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op2_warc_fixity(spark, folder):
    return fixity.fixity_report(table(spark, folder, "pages"))


def op3_near_dedup(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


def op4_license_scan(spark, folder):
    out = licenses.scan(table(spark, folder, "documents"))
    return out.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "line")


def op5_quality_rules(spark, folder):
    out = quality.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_span_dedup(spark, folder):
    out = span_dedup.dedup_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "sources", F.sha2("text", 256).alias("kept_sha256"))


def op7_decontaminate(spark, folder):
    out = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "item_id", "n_windows", "coverage", "exact")


def op8_line_dedup(spark, folder):
    out = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_lm_scores(spark, folder):
    return language_model.scores(table(spark, folder, "documents"))


def op10_html_text(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


def op11_token_alignment(spark, folder):
    rows, _ = token_alignment.align(table(spark, folder, "documents"))
    return rows


def op12_hard_negatives(spark, folder):
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


def op13_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


QUERIES = {
    "op1_mix_sources": (op1_mix_sources, mixing.SQL),
    "op2_warc_fixity": (op2_warc_fixity, fixity.SQL),
    "op3_near_dedup": (op3_near_dedup, None),
    "op4_license_scan": (op4_license_scan, None),
    "op5_quality_rules": (op5_quality_rules, quality.SQL),
    "op6_span_dedup": (op6_span_dedup, None),
    "op7_decontaminate": (op7_decontaminate, None),
    "op8_line_dedup": (op8_line_dedup, line_dedup.SQL),
    "op9_lm_scores": (op9_lm_scores, None),
    "op10_html_text": (op10_html_text, None),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_hard_negatives": (op12_hard_negatives, hard_negatives.SQL),
    "op13_simhash": (op13_simhash, None),
}
