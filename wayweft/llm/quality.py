"""Quality rules as a short-circuit cascade, ordered by what a sample says they reject for their cost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.llm.shared import BLANKS, carry, text_words, uncarried
from wayweft.session import materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: One row in so many, and at most so many rows, are judged to order the rules; verdicts do not depend on it.
SAMPLE_EVERY, SAMPLE_ROWS = 64, 2000


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("_words", text_words(F.col("text")))
    n = F.size("_words")
    # Three-word windows, sorted with their places; the repeated ones equal a neighbour, and the gaps
    # between their places, at most three each, add up to the words they cover.
    windows = "transform(sequence(1, size(_words) - 2), i -> struct(concat_ws(' ', _words[i - 1], _words[i], _words[i + 1]) AS w, i AS i))"
    docs = docs.withColumn("_sorted", F.when(n >= 4, F.expr(f"sort_array({windows})")))
    twice = "x.w = get(_sorted, k - 1).w OR x.w = get(_sorted, k + 1).w"
    docs = docs.withColumn("_again", F.expr(f"sort_array(transform(filter(_sorted, (x, k) -> {twice}), x -> x.i))"))
    covered = F.expr(
        "aggregate(_again, struct(0L AS total, -9 AS last), (s, i) -> struct(s.total + least(3, i - s.last) AS total, i AS last), s -> s.total)"
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    out = docs.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": _count_of(text, SYMBOLS),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_words", "_sorted", "_again")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed)


NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept")


@dataclass(frozen=True)
class Rule:
    """A named test on a row with the base measures; true rejects the document.

    ``reads`` is the number of characters that the test goes over, the whole text by default.
    """

    name: str
    rejects: Callable[[], Column]
    reads: Callable[[], Column] = lambda: F.length(_text())


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _letters_upper() -> Column:
    return F.length(_text()) - F.length(F.translate(_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))


RULES = [
    Rule("symbols", lambda: _share(F.col("n_symbols"), F.col("n_words"), 10), lambda: F.lit(0)),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 15), lambda: F.lit(0)),
    Rule("repeated_lines", lambda: _share(F.col("n_dup_lines"), F.size(F.split(_text(), "\n")), 30)),
    Rule("capitals", lambda: _share(_letters_upper(), F.col("word_chars"), 40)),
    Rule("exclamations", lambda: _share(_count_of(_text(), "!?"), F.col("n_words"), 30)),
    Rule("digits", lambda: _share(_count_of(_text(), "0123456789"), F.col("word_chars"), 30)),
]


def ordered(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """``rules`` by rejections per cost on a sample with base measures, the best first.

    The cost of a rule is one for each row it sees and the characters it reads there. The sample's rows
    that pass the base are summed up by which rules reject them, in one job; then the best rule is
    taken, the rows that it rejects leave, and the next one is judged by the rows that come that far.
    Ties go to the cheaper rule, then to the earlier. The order decides what the rows cost, never which
    ones pass.
    """
    if not rules:
        return []
    hits = F.array(*[F.coalesce(r.rejects(), F.lit(False)) for r in rules]).alias("hits")
    costs = [F.sum(1 + r.reads().cast("long")).alias(f"cost{i}") for i, r in enumerate(rules)]
    sample = materialise(sample)  # else the measures are made again for every test that uses them
    groups = sample.where(~F.col("base_failed")).groupBy(hits).agg(F.count("*").alias("n"), *costs).collect()
    order, left = [], list(range(len(rules)))
    while left:
        gains = {}
        for i in left:
            cost = sum(g[f"cost{i}"] for g in groups)
            gains[i] = (-sum(g["n"] for g in groups if g["hits"][i]) / max(cost, 1), cost, i)
        best = min(left, key=gains.get)
        order.append(best)
        left.remove(best)
        groups = [g for g in groups if not g["hits"][best]]
    return [rules[i] for i in order]


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the base measures, base_failed, failed_rule and kept.

    Words are runs of characters other than ASCII white space. The base fails texts of under 50 words
    and those with over half of their words in a three-word window that occurs twice. The others go
    through the rules, one after the other up to the first that rejects (``failed_rule``); ``kept``
    means that none does, which does not depend on the order.

    A null or empty text has no words and fails the base. Rows are judged one by one, so repeated
    rows get equal verdicts, and a null doc_id or other nulls change nothing. Columns named like the
    new ones are replaced; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    own = carry(docs, "doc_id", "text", new=NEW)
    rules = ordered(base_measures(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_EVERY)) == 0).limit(SAMPLE_ROWS)), rules)
    verdict = F.when(F.col("base_failed"), F.lit(None).cast("string"))
    for rule in rules:
        verdict = verdict.when(rule.rejects(), F.lit(rule.name))
    out = base_measures(own).withColumn("failed_rule", verdict)
    return uncarried(out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()), docs, NEW)


def good_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were."""
    out = judged(carry(docs, "doc_id", "text"))
    # Tested on an unnested copy: a test on the verdict itself is moved below the measures, which it would
    # then hold several times over.
    out = out.select("others", "text", F.explode_outer(F.array("kept")).alias("good")).where("good")
    return uncarried(out, docs)


SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)),
windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL),
covered AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, i + d AS place FROM counted, (VALUES (0), (1), (2)) AS t(d) WHERE n >= 2) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^!?]', '', 'g')) AS bangs,
         length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, len(string_split(text, chr(10))) AS n_lines
  FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 100 * upper > 40 * word_chars OR 100 * bangs > 30 * n_words
            OR 100 * digits > 30 * word_chars) AS kept
FROM based
"""
