"""Porter stemming as staged CASE expressions (M. F. Porter, "An algorithm for suffix stripping", 1980).

Words under 3 or over 64 bytes pass through unstemmed. The suffix tables below are fixed values of
the published algorithm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (suffix, replacement), tested from top to bottom, the first suffix that fits decides.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"),
]
STEP_3 = [
    ("ical", "ic"), ("ness", ""), ("icate", "ic"), ("iciti", "ic"), ("ful", ""), ("ative", ""),
    ("alize", "al"),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

# One vowel-consonant turn from the start of the word, then one more turn. ``y`` is a vowel after a consonant.
FIRST_TURN = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*[^aeiou]"
NEXT_TURN = "[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"
HAS_VOWEL = "[aeiou]|.y"
SHORT_END = "(?:[^aeiouy][aeiouy]|(?:^|[aeiou])y[aeiouy])[^aeiouwxy]$"


@dataclass(frozen=True)
class Dialect:
    """How one SQL engine spells the two predicates the stemmer needs."""

    matches: str
    ends: str
    size: str


SPARK = Dialect("regexp({0}, '{1}')", "endswith({0}, '{1}')", "octet_length({0})")


def _cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def stem_steps(d: Dialect, word: str = "w") -> list[str]:
    """The CASE expressions to apply one after another to a column named ``word``."""

    def has(expr: str, pattern: str) -> str:
        return d.matches.format(expr, pattern)

    def ends(tail: str) -> str:
        return f"({d.ends.format(word, tail)} AND length({word}) > {len(tail)})"

    def turns_over_1(expr: str) -> str:
        return has(expr, FIRST_TURN + NEXT_TURN)

    def turns_over_0(expr: str) -> str:
        return has(expr, FIRST_TURN)

    def turns_equal_1(expr: str) -> str:
        return f"({turns_over_0(expr)} AND NOT {turns_over_1(expr)})"

    def guarded(body: str) -> str:
        return f"CASE WHEN length({word}) < 2 THEN {word} {body} ELSE {word} END"

    def swap(rules: list[tuple[str, str]], test) -> str:
        arms = []
        for tail, new in rules:
            base = _cut(word, len(tail))
            arms.append(f"WHEN {ends(tail)} THEN CASE WHEN {test(base)} THEN concat({base}, '{new}') ELSE {word} END")
        return guarded(" ".join(arms))

    plural = guarded(
        f"WHEN {ends('sses')} OR {ends('ies')} THEN {_cut(word, 2)} "
        f"WHEN {d.ends.format(word, 'ss')} THEN {word} "
        f"WHEN {d.ends.format(word, 's')} THEN {_cut(word, 1)}"
    )
    # A removed -ed or -ing leaves a marker, so that the repair step touches only those words.
    past = guarded(
        f"WHEN {ends('eed')} THEN CASE WHEN {turns_over_0(_cut(word, 3))} THEN {_cut(word, 1)} ELSE {word} END "
        f"WHEN {ends('ed')} THEN CASE WHEN {has(_cut(word, 2), HAS_VOWEL)} THEN concat({_cut(word, 2)}, '+') ELSE {word} END "
        f"WHEN {ends('ing')} THEN CASE WHEN {has(_cut(word, 3), HAS_VOWEL)} THEN concat({_cut(word, 3)}, '+') ELSE {word} END"
    )
    bare = _cut(word, 1)
    twin = " OR ".join(f"{d.ends.format(word, c + c + '+')}" for c in "bcdfghjkmnpqrtvwxy0123456789")
    repair = (
        f"CASE WHEN NOT {d.ends.format(word, '+')} THEN {word} "
        f"WHEN {ends('at+')} OR {ends('bl+')} OR {ends('iz+')} THEN concat({bare}, 'e') "
        f"WHEN {twin} THEN {_cut(word, 2)} "
        f"WHEN {turns_equal_1(bare)} AND {has(bare, SHORT_END)} THEN concat({bare}, 'e') ELSE {bare} END"
    )
    y_end = guarded(
        f"WHEN {d.ends.format(word, 'y')} AND {has(_cut(word, 1), HAS_VOWEL)} THEN concat({_cut(word, 1)}, 'i')"
    )
    drop = guarded(
        " ".join(
            f"WHEN {ends(tail)} THEN CASE WHEN {turns_over_1(_cut(word, len(tail)))}"
            + (f" AND {has(_cut(word, 3), '[st]$')}" if tail == "ion" else "")
            + f" THEN {_cut(word, len(tail))} ELSE {word} END"
            for tail in STEP_4
        )
    )
    final_e = guarded(
        f"WHEN {d.ends.format(word, 'e')} AND ({turns_over_1(bare)} OR ({turns_equal_1(bare)} "
        f"AND NOT {has(bare, SHORT_END)})) THEN {bare}"
    )
    double_l = guarded(f"WHEN {d.ends.format(word, 'll')} AND {turns_over_1(bare)} THEN {bare}")
    return [
        plural, past, repair, y_end, swap(STEP_2, turns_over_0), swap(STEP_3, turns_over_0), drop, final_e, double_l,
    ]


def stem(column: str) -> Column:
    """Stem of a folded word column.

    The steps are chained through one-element arrays, whose lambda variable names the word of each
    step once. So the expression stays small even where the optimizer copies it into a filter.
    """
    chain = f"array({column})"
    for step in stem_steps(SPARK, "w"):
        chain = f"transform({chain}, w -> {step})"
    return F.expr(f"CASE WHEN octet_length({column}) BETWEEN 3 AND 64 THEN {chain}[0] ELSE {column} END")


def stem_column(df: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` (folded words) by its stem."""
    return df.withColumn(column, stem(column))
