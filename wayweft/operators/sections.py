"""Heading-delimited sections of prose documents, found inside each row without a shuffle.

Lines that can start a heading get their line number in front. One left-to-right replacement then
turns every heading into a section mark, which is also what makes overlapping underline candidates
resolve the way a line-by-line reader resolves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.functions.strings import lines_of, strip

DOC_SUFFIXES = (".md", ".mdx", ".markdown", ".rst", ".txt")

ATX = r"(?U)^#{1,6}[^\S\n]+.+?[^\S\n]*#*[^\S\n]*$"
UNDERLINE = "(?U)^[=\\-~^\"'`*+]{3,}\\s*$"

# Unicode noncharacters, which text interchange excludes, as in-row marks.
NUM_OPEN, NUM_CLOSE, SECTION, TITLE_END = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

_NUMBER = f"{NUM_OPEN}(\\d+){NUM_CLOSE}"
# An ATX line, or any numbered line together with the underline below it.
HEADING = (
    f"(?mU)^{_NUMBER}(?:#{{1,6}}[^\\S\\n]+(.+?)[^\\S\\n]*#*[^\\S\\n]*$"
    f"|(.*)\\n(?:{NUM_OPEN}\\d+{NUM_CLOSE})?[=\\-~^\"'`*+]{{3,}}[^\\S\\n]*$)"
)


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: the columns of ``docs`` but its text, ``section``, ``start_line``, ``body``, ``pos``.

    A heading directly followed by another heading (or the end) yields no row, nor does a text
    before the first heading that is blank.
    """
    rest = [c for c in docs.columns if c != text]
    lined = docs.select(*rest, lines_of(F.coalesce(F.col(text), F.lit(""))).alias("_lines"))

    def numbered(line, i):
        below = F.get("_lines", i + 1)
        may_head = line.rlike(ATX) | ((strip(line) != "") & F.coalesce(below.rlike(UNDERLINE), F.lit(False)))
        mark = F.concat(F.lit(NUM_OPEN), (i + 1).cast("string"), F.lit(NUM_CLOSE), line)
        return F.when(may_head, mark).otherwise(line)

    joined = F.concat(F.array_join(F.transform("_lines", numbered), "\n"), F.lit("\n"))
    marked = F.regexp_replace(joined, HEADING, f"{SECTION}$1{NUM_CLOSE}$2$3{TITLE_END}")
    cut = lined.select(*rest, F.posexplode_outer(F.split(marked, SECTION, -1)).alias("pos", "_piece")).filter("pos IS NOT NULL")
    headed = F.col("pos") > 0
    tail = F.when(headed, F.substring_index("_piece", TITLE_END, -1)).otherwise(F.col("_piece"))
    fields = cut.select(
        *rest, "pos",
        F.when(headed, strip(F.regexp_extract("_piece", f"^\\d+{NUM_CLOSE}([^{TITLE_END}]*){TITLE_END}", 1)))
        .otherwise("").alias("section"),
        F.when(headed, F.regexp_extract("_piece", r"^(\d+)", 1).cast("int")).otherwise(1).alias("start_line"),
        tail.alias("_tail"),
    )
    body = strip(F.col("_tail"))
    has_lines = (F.col("pos") == 0) | (F.col("_tail") != "\n")
    return fields.filter(has_lines & ((body != "") | (F.col("section") != ""))).select(
        *rest, "pos", "section", "start_line", body.alias("body")
    )
