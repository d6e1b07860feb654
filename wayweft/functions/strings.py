"""String and path expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space, for trimming.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries other than \n.
LINE_BREAKS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory part, empty for a top-level name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last extension in lower case with its dot; dotfiles and names without a dot have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def join_path(base: Column, target: Column) -> Column:
    """Lexical join that drops ``.`` and doubled slashes but keeps ``..`` segments."""
    joined = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), target))
    return tidy_path(joined)


def tidy_path(path: Column) -> Column:
    slashes = F.regexp_replace(path, r"/{2,}", "/")
    dots = F.regexp_replace(slashes, r"(?:^|(?<=/))\./", "")
    return F.regexp_replace(dots, r"(?<=.)/\.?$", "")


def resolve_dots(path: Column) -> Column:
    """Collapse ``.`` and ``..``; climbing above the root stays at the root."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    return F.array_join(folded, "/")


def last_segment(text: Column) -> Column:
    """Name after the last ``::``, ``->`` and ``.``, tried in that order."""
    tail = F.substring_index(F.substring_index(F.substring_index(text, "::", -1), "->", -1), ".", -1)
    return strip(tail)


def unquote(text: Column) -> Column:
    """Drop one pair of matching outer quotes, backticks or angle brackets."""
    bare = strip(text)
    return F.regexp_replace(bare, r"(?s)^(?:\"(.*)\"|'(.*)'|`(.*)`|<(.*)>)$", "$1$2$3$4")


def unquote_word(text: Column) -> Column:
    """Drop one pair of matching outer single or double quotes."""
    return F.regexp_replace(strip(text), r"(?s)^(?:\"(.*)\"|'(.*)')$", "$1$2")


def clean_lines(text: Column) -> Column:
    """Text with every kind of line boundary as ``\\n``."""
    return F.regexp_replace(text, LINE_BREAKS, "\n")


def lines_of(text: Column) -> Column:
    """Lines without a phantom last line when the text ends in a line break."""
    return F.split(F.regexp_replace(clean_lines(text), r"\n\z", ""), "\n", -1)


def glob_to_regex(glob: str) -> str:
    """Case-sensitive glob where ``*`` also crosses ``/`` and ``[...]`` is a character class."""
    out, i = ["(?s)^"], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 3 if glob[i + 1 : i + 2] == "^" else i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close]
            negate, body = ("^", body[1:]) if body.startswith("^") else ("", body)
            out.append("[" + negate + "".join("\\" + c if c in "[]\\^&" else c for c in body) + "]")
            i = close
        else:
            out.append(ch if ch.isalnum() or ch in "/_ " else "\\" + ch)
        i += 1
    return "".join(out) + "$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_to_regex(glob))
