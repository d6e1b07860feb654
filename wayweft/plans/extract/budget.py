"""How much of a source file no rule explains.

Without a grammar, three things tell that a line is no code: three names in a row with nothing between
them (prose), characters that occur in no language outside texts (binary contents), and brackets that
close what was never opened. The last needs what came before, so the lines are folded within the row;
nothing is unnested or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of a file's bytes that may be unexplained, and the length from which it is asked for.
BUDGET = 0.5
LEAST_BYTES = 8
#: Words that may stand beside a name in one of the brace languages.
KEYWORDS = (
    "abstract as async auto await bool boolean case catch chan char class const constexpr crate declare default defer delete "
    "do double dyn else enum explicit export extends extern final float fn for friend from func function get go if impl "
    "implements import in inline instanceof int interface let long map match mod move mut namespace native new of operator "
    "override package private protected pub public range readonly ref register return set short signed static struct switch "
    "synchronized template throw throws trait transient try type typedef typename typeof union unsafe unsigned use using var "
    "virtual void volatile where while yield"
).split()
#: Further ones of Python.
PYTHON_KEYWORDS = "and assert def del elif except finally global is lambda nonlocal not or pass raise with".split()


def _words(keywords: list[str]) -> str:
    return rf"\b(?:{'|'.join(keywords)})\b"


def _prose(keywords: list[str]) -> str:
    """Three names in a row, none a keyword: what ``_PROSE`` finds once keywords are cut out and all letters are ASCII, read at one go."""
    letter, char = r"[A-Za-z_\x{80}-\x{10ffff}]", r"[\w\x{80}-\x{10ffff}]"
    free = rf"(?!(?:{'|'.join(keywords)})(?!{char}))"
    name, gap = rf"{letter}{char}*+", r"[ \t]++"
    return rf"(?<!{char})(?=\d*+{name}{gap}{name}{gap}{letter}){free}\d*+{name}{gap}{free}{name}{gap}{free}{letter}"


_WORDS = _words(KEYWORDS)
_PROSE = r"[A-Za-z_]\w*[ \t]+[A-Za-z_]\w*[ \t]+[A-Za-z_]"
_BINARY = "[\\x00-\\x08\\x0e-\\x1f\\ufffd]"


def _without(line: Column, marks: str) -> Column:
    for mark in marks:
        line = F.replace(line, F.lit(mark))
    return line


def unexplained(lines: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Bytes of the lines (without comments and texts) that are no code."""
    prose = _prose(keywords)

    def measured(line: Column) -> Column:
        # Opened less closed brackets.
        step = F.octet_length(_without(line, ")]}")) - F.octet_length(_without(line, "([{"))
        # Letters beyond ASCII count as letters of names.
        odd = line.rlike(prose) | line.rlike(_BINARY)
        return F.struct(step.alias("step"), odd.alias("odd"), F.octet_length(line).alias("bytes"))

    def fold(acc: Column, m: Column) -> Column:
        bad = (acc["depth"] + m["step"] < 0) | m["odd"]
        return F.struct(F.greatest(acc["depth"] + m["step"], F.lit(0)).alias("depth"), (acc["bad"] + F.when(bad, m["bytes"]).otherwise(0)).alias("bad"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("bad"))
    return F.aggregate(F.transform(lines, measured), start, fold, lambda acc: acc["bad"])


def over_budget(lines: Column, text: Column, more_words: list[str] | None = None) -> Column:
    """The unexplained share in whole hundredths where it is beyond the budget, else null; folded once, through one array."""
    total = F.octet_length(text)

    def judged(bad: Column) -> Column:
        return F.when((total >= LEAST_BYTES) & (bad > total * BUDGET), F.floor(bad * 100 / total).cast("int"))

    return F.transform(F.array(unexplained(lines, [*KEYWORDS, *(more_words or [])])), judged)[0]


def message(path: Column, percent: Column) -> Column:
    return F.concat(F.lit("parse error "), path, F.lit(": "), percent.cast("string"), F.lit(f"% of it is no code, more than {BUDGET:.0%}"))


#: The same for a SQL relation ``bare(path, total, line, i)`` of numbered lines, ending in ``refused(path, message)``.
SQL = rf"""
marked AS (
  SELECT path, total, i, line, sum(length(regexp_replace(line, '[^(\[{{]+', '', 'g')) - length(regexp_replace(line, '[^)\]}}]+', '', 'g'))) OVER (PARTITION BY path ORDER BY i) AS level,
    regexp_replace(regexp_replace(line, '[^\x00-\x7f]', 'x', 'g'), '{_WORDS}', ';', 'g') AS plain FROM bare),
judged AS (
  SELECT path, total, line, regexp_matches(plain, '{_PROSE}') OR regexp_matches(line, '[\x00-\x08\x0e-\x1f\x{{fffd}}]')
    OR level < least(0, coalesce(min(level) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS bad FROM marked),
shares AS (SELECT path, total, CAST(sum(CASE WHEN bad THEN strlen(line) ELSE 0 END) AS BIGINT) AS n FROM judged GROUP BY path, total),
refused AS (
  SELECT path, concat('parse error ', path, ': ', n * 100 // total, '% of it is no code, more than {BUDGET:.0%}') AS message
  FROM shares WHERE total >= {LEAST_BYTES} AND n > total * {BUDGET})"""
