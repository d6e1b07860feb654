"""Word tokens for the full-text indexes, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}\p{Co}]+)"
QUERY_WORD = re.compile(r"[A-Za-z0-9]+")


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with one mark (to U+024F, and U+1E00 to U+1EFF) and their base letters, by decomposition."""
    pairs = []
    for code in [*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and chr(code).islower():
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accent_table()
COMBINING = "\\p{Mn}+"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, BASE)


def words(text: Column) -> Column:
    """All index tokens of a text: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(1))


def query_words(query: str | None) -> list[str]:
    """Tokens of a search string: ASCII letters and digits only, in order, repeats kept."""
    return [w.lower() for w in QUERY_WORD.findall(query or "")]
