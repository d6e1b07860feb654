"""Facts of markdown files: local links outside code, and tool names in lists and inline code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.functions.strings import basename, clean_lines, join_path, parent, strip
from wayweft.model import node_id
from wayweft.plans.extract.facts import emit, fact, one, union
from wayweft.sources.scan import is_local_link

FENCE = r"(?ms)^[ \t>]*(`{3,}|~{3,})[^\n]*$.*?(?:^[ \t>]*\1[`~]*[ \t]*$|\z)"
CODE_SPAN = r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)"
TEXT = r"\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)?\]"
DEST = r"(<[^<>\n]*+>|[^\s()<>]*+(?:\([^\s()]*+\)[^\s()]*+)?)"
INLINE_TAIL = r"\(\s*+" + DEST + r"(?:\s+(?:\"[^\"]*+\"|'[^']*+'|\([^()]*+\)))?\s*+\)"
LINK = r"(?<![!\\])" + TEXT + r"(?:" + INLINE_TAIL + r"|\[[^\[\]\n]*+\]|(?![(\[:]))"
DEFINITION = r"(?m)^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|\S+)"
MARKER = r"(?:[-*+]|\d{1,9}[.)])"
IDENT = r"[A-Za-z_][\w.-]+"
LIST_IDENT = (
    r"(?mU)^([ \t]*)" + MARKER + r"[ \t]+(" + IDENT + r")[ \t]*$"
    r"(?=\s*\z|\n[ \t]*\n(?!\1[ \t]{2,}\S)|\n(?!\1[ \t])[ \t]*" + MARKER + r"[ \t]|\n#)"
)


def _without_code(text):
    """Text without fenced blocks, and without indented blocks that follow plain paragraphs."""
    open_text = F.regexp_replace(clean_lines(text), FENCE, "\n")
    blocks = F.split(open_text, r"\n[ \t]*(?=\n)")

    def shown(block, i):
        before = F.coalesce(F.get(blocks, i - 1), F.lit(""))
        indented = ~block.rlike(r"(?m)^(?! {4}|\t)[ \t]*\S") & block.rlike(r"\S")
        return F.when(indented & ~before.rlike(r"(?m)^[ \t]*" + MARKER + r"[ \t]"), "").otherwise(block)

    return F.array_join(F.transform(blocks, shown), "\n")


def markdown(files: DataFrame, turn: int) -> DataFrame:
    file_id = node_id("file", "path")
    own = one(files, fact([turn, 0], file_id, "file", basename(F.col("path")), F.col("path")))
    docs = files.select("path", _without_code(F.col("text")).alias("_open"))
    prose = docs.select(
        "path", "_open", F.regexp_replace(F.regexp_replace("_open", CODE_SPAN, " "), r"<!--(?s:.*?)-->", "").alias("_prose")
    )
    return union(own, _links(prose, turn, file_id), _tools(prose, turn, file_id))


def _links(prose: DataFrame, turn: int, file_id) -> DataFrame:
    defs = prose.select(
        "path", F.posexplode_outer(F.regexp_extract_all("_prose", F.lit(DEFINITION), F.lit(0))).alias("_n", "_d")
    ).filter("_n IS NOT NULL").select(
        "path", _label(F.regexp_extract("_d", DEFINITION, 1)).alias("ref"), F.regexp_extract("_d", DEFINITION, 2).alias("dest"), "_n"
    )
    first = defs.groupBy("path", "ref").agg(F.min_by("dest", "_n").alias("_named"))
    uses = prose.select("path", F.posexplode_outer(F.regexp_extract_all("_prose", F.lit(LINK), F.lit(0))).alias("_n", "_m")).filter("_n IS NOT NULL")
    inline = F.col("_m").endswith(")")
    shown = F.regexp_extract("_m", r"^\[(.*?)\](?:\[(.*)\])?$", 1)
    given = F.regexp_extract("_m", r"^(?s:.*)\]\[([^\]]*)\]$", 1)
    ref = F.when(~inline, _label(F.when(given != "", given).otherwise(shown)))
    found = uses.select(
        "path", "_n", ref.alias("ref"), F.when(inline, F.regexp_extract("_m", r"(?s)^" + TEXT + INLINE_TAIL + r"$", 1)).alias("_dest")
    ).join(first, ["path", "ref"], "left")
    href = strip(F.regexp_replace(F.coalesce("_dest", "_named"), r"^<(.*)>$", "$1"))
    local = found.select("path", "_n", href.alias("href")).filter(F.col("href").isNotNull() & is_local_link(F.col("href")))
    target = strip(F.substring_index("href", "#", 1))
    aimed = local.withColumn("target", target).filter("target <> ''").withColumn(
        "target", join_path(parent(F.col("path")), F.col("target"))
    )
    return one(
        aimed,
        fact(
            [turn, 1, F.col("_n")], node_id("file", "target"), "file", basename(F.col("target")), F.col("target"), None,
            node_id("file", "path"), "depends_on",
        ),
    )


def _label(text):
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def _tools(prose: DataFrame, turn: int, file_id) -> DataFrame:
    listed = F.regexp_extract_all("_open", F.lit(LIST_IDENT), F.lit(2))
    plain = F.filter(listed, lambda w: ~(w.startswith("_") & w.endswith("_")))
    spans = F.transform(F.regexp_extract_all("_open", F.lit(CODE_SPAN), F.lit(2)), lambda c: strip(c))
    coded = F.filter(spans, lambda c: (F.length(c) >= 3) & c.rlike(rf"(?U)^{IDENT}$"))
    names = F.array_sort(F.array_distinct(F.concat(plain, coded)))
    return emit(
        prose,
        F.transform(
            names,
            lambda t, i: fact([turn, 2, i], node_id("module", F.lit("tool"), t), "module", F.concat(F.lit("tool:"), t), None, None, file_id, "depends_on"),
        ),
    )
