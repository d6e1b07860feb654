"""Facts of source code: definitions, imports and calls.

Python goes through the standard parser in a small helper. The brace languages are cut into marks by
one pattern per language inside the JVM; the helper only nests them. Backslash pairs, comments and
strings are neutralised first, with patterns whose repeats are single character classes, so that
input of any shape cannot overflow the matcher's stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions.helpers import CALL, DEF, FAULT, IMPORT, nest_scopes, python_facts
from wayweft.functions.strings import basename, strip, suffix
from wayweft.model import node_id
from wayweft.plans.extract.budget import PYTHON_KEYWORDS, message, over_budget
from wayweft.plans.extract.facts import WARNING, emit, fact, nothing, one, union, warning

# Callees that are no calls.
NO_CALLS = ("", "if", "for", "while", "switch", "catch", "return", "typeof", "new", "import", "require")
# Words before a parenthesis that are syntax in one of the languages.
SYNTAX = (
    "func", "fn", "match", "else", "sizeof", "synchronized", "do", "throw", "await", "async", "in", "of", "case", "void",
    "delete", "defined", "constexpr", "function", "with", "try", "assert", "alignof", "decltype", "noexcept", "yield", "loop",
)
_NOT = "(?!(?:if|for|while|switch|catch|return|new|throw|else|case|assert|await|yield|function|with|sizeof|do)\\b)"
MARK = "\ufdd0(\\d+)\ufdd1"
ARGS = r"\([^(){};]*+\)"


@dataclass(frozen=True)
class Language:
    """Marks as (kind, pattern with the name in group 1), tried in order, and import patterns."""

    suffixes: tuple[str, ...]
    marks: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    import_blocks: tuple[tuple[str, str], ...] = ()


_END = (("open", r"(\{)"), ("close", r"(\})"), ("end", r"(;)"))
_CALL = (("call", r"\b([A-Za-z_]\w*)\s*(?:<[^<>(){};\n]{0,100}>)?\("),)
_NEW = ("call", r"\bnew\s+([\w.:]+)")

JS = Language(
    (".js", ".jsx", ".ts", ".tsx"),
    (
        ("call", r"\bnew\s+([\w$.]+)"),
        (
            "arrow",
            r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]{0,200})?=\s*(?:async\s+)?"
            r"(?:function\b\s*\*?\s*[\w$]*|\([^()]*+\)\s*(?::[^=;{}\n]{0,200})?=>|[A-Za-z_$][\w$]*\s*=>)",
        ),
        ("def", r"\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)"),
        ("def", r"\bclass\s+(?!extends\b)([A-Za-z_$][\w$]*)"),
        (
            "body",
            MARK.replace("(", "(?:") + r"[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+){0,4}\*?\s*"
            + _NOT + r"([A-Za-z_$#][\w$]*)\s*(?:<[^<>()]{0,100}>)?" + ARGS + r"\s*(?::[^{};=]{0,200})?\{",
        ),
        ("line", MARK),
        ("call", r"(?<![\w$])([A-Za-z_$][\w$]*)\s*(?:<[^<>(){};\n]{0,100}>)?(?:\?\.)?\("),
        *_END,
    ),
    (r"(?m)^" + MARK.replace("(", "(?:") + r"[ \t]*import\b[^;'\"()]*+['\"]([^'\"\n]+)['\"]", r"\b(?:require|import)\s*\(\s*['\"`]([^'\"`\n]+)['\"`]"),
)
GO = Language(
    (".go",),
    (("def", r"\bfunc\s*(?:\([^)]*+\)\s*)?([A-Za-z_]\w*)"), ("line", MARK), *_CALL, *_END),
    (r"(?m)^" + MARK.replace("(", "(?:") + r"\s*import\s+(?:[\w.]+\s+)?[\"`]([^\"`]+)[\"`]",),
    ((r"(?m)^" + MARK.replace("(", "(?:") + r"\s*import\s*\(([^)]*)\)", r"[\"`]([^\"`\n]+)[\"`]"),),
)
RUST = Language(
    (".rs",),
    (
        ("def", r"\bfn\s+([A-Za-z_]\w*)(?=[^{};]*+\{)"), ("def", r"\b(?:struct|enum|trait)\s+([A-Za-z_]\w*)"), ("line", MARK),
        ("call", r"\b([A-Za-z_]\w*!)(?=\s*[(\[{])"), ("call", r"(?<!\bfn\s)" + _CALL[0][1]), *_END,
    ),
    (r"(?m)^" + MARK.replace("(", "(?:") + r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);",),
)
JAVA = Language(
    (".java",),
    (
        _NEW, ("def", r"\b(?:class|interface)\s+([A-Za-z_]\w*)"),
        (
            "def",
            r"\b" + _NOT + r"[A-Za-z_][\w.]*(?:<[^(){};]{0,200}>)?(?:\[\])?\s+([A-Za-z_]\w*)\s*" + ARGS + r"\s*(?:throws\s+[^{};]*+)?(?=[{;])",
        ),
        ("def", r"\b" + _NOT + r"([A-Z]\w*)\s*" + ARGS + r"\s*(?:throws\s+[^{};]*+)?(?=\{)"),
        ("line", MARK), *_CALL, *_END,
    ),
    (r"(?m)^" + MARK.replace("(", "(?:") + r"\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;",),
)
CPP = Language(
    (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp"),
    (
        (
            "def",
            r"\b" + _NOT + r"(~?[A-Za-z_][\w:~]*)\s*" + ARGS + r"\s*(?:const\s*|noexcept\s*|override\s*|final\s*){0,3}(?::[^{};]*+)?(?=\{)",
        ),
        ("line", MARK), *_CALL, *_END,
    ),
    (r"(?m)^" + MARK.replace("(", "(?:") + r"[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]",),
)
LANGUAGES = (JS, GO, RUST, JAVA, CPP)


def _numbered(text: Column) -> Column:
    """Every line with its number in front."""
    lines = F.split(_unix(text), "\n", -1)
    return F.array_join(
        F.transform(lines, lambda l, i: F.concat(F.lit("\ufdd0"), (i + 1).cast("string"), F.lit("\ufdd1"), l)), "\n"
    )


def _unix(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _without_comments(text: Column) -> Column:
    pairs = F.regexp_replace(text, r"\\[^\n]", "__")
    strings = r"(\"[^\"\n]*+\"|'[^'\n]*+'|`[^`]*+`)"
    return F.regexp_replace(pairs, strings + r"|//[^\n]*+|/\*(?s:.*?)\*/", "$1")


def _without_strings(text: Column, rust: bool) -> Column:
    single = "'[^'\\n]'" if rust else "'[^'\\n]*+'"
    return F.regexp_replace(text, r"\"[^\"\n]*+\"|`[^`]*+`|" + single, '""')


def _without_lookahead(pattern: str) -> str:
    """The pattern of a token cut out of its text: what had to follow is gone."""
    at = pattern.rfind("(?=")
    return pattern if at < 0 else pattern[:at]


def _marks(tokens: Column, lang: Language) -> Column:
    """``kind, name`` of every token; a method head at a line start yields the line as well."""
    def marks_of(token):
        out = F.lit(None)
        for kind, pattern in reversed(lang.marks):
            name = F.regexp_extract(token, _without_lookahead(pattern), 1)
            mark = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
            cells = F.array(mark)
            if kind == "body":
                line = F.struct(F.lit("line").alias("kind"), F.regexp_extract(token, MARK, 1).alias("name"))
                cells = F.array(line, mark)
            out = F.when(token.rlike("^(?:" + _without_lookahead(pattern) + ")$"), cells).otherwise(out)
        return out

    return F.flatten(F.array_compact(F.transform(tokens, marks_of)))


def _code_facts(turn: int) -> tuple[Column, Column]:
    """Facts of ``_defs``/``_calls`` entries ``name, line, scope``."""
    file_id = node_id("file", "path")

    def symbol(name):
        return node_id("code_symbol", F.col("path"), name)

    defs = F.transform(
        "_defs",
        lambda d, i: fact(
            [turn, 1, DEF, i], symbol(d["name"]), "code_symbol", d["name"], F.col("path"), d["line"], file_id, "defines"
        ),
    )
    calls = F.transform(
        "_calls",
        lambda c, i: fact(
            [turn, 1, CALL, i], node_id("code_symbol", c["name"]), "code_symbol", c["name"], None, None,
            F.when(c["scope"].isNotNull(), symbol(c["scope"])).otherwise(file_id), "calls",
        ),
    )
    return defs, calls


def _imports(modules: Column, turn: int) -> Column:
    named = F.filter(F.transform(modules, lambda m: strip(m)), lambda m: m != "")
    return F.transform(
        named,
        lambda m, i: fact([turn, 1, IMPORT, i], node_id("module", m), "module", m, None, None, node_id("file", "path"), "imports"),
    )


def _python(files: DataFrame, turn: int) -> DataFrame:
    plain = F.regexp_replace("text", r"(?s:\"{3}.*?\"{3}|'{3}.*?'{3})|\"[^\"\n]*+\"|'[^'\n]*+'|#[^\n]*+", '""')
    found = files.filter(suffix(F.col("path")) == ".py").select(
        "path", over_budget(F.split(plain, "\n", -1), F.col("text"), PYTHON_KEYWORDS).alias("_share"), python_facts("text").alias("_all")
    )
    split = found.select(
        "path", F.when(F.exists("_all", lambda f: f["stage"] == FAULT), F.col("_share")).alias("_over"),
        F.filter("_all", lambda f: f["stage"] == DEF).alias("_defs"),
        F.filter("_all", lambda f: f["stage"] == IMPORT).alias("_mods"),
        F.filter("_all", lambda f: (f["stage"] == CALL) & ~f["name"].isin(*NO_CALLS)).alias("_calls"),
    )
    defs, calls = _code_facts(turn)
    # A fault within the budget leaves what can be read around it; beyond it the file keeps its own node and says why.
    refused = F.array(warning([turn, 1], message(F.col("path"), F.col("_over"))))
    found = F.concat(defs, _imports(F.transform("_mods", lambda m: m["name"]), turn), calls)
    return emit(split, F.when(F.col("_over").isNotNull(), refused).otherwise(found))


def _braces(files: DataFrame, turn: int, lang: Language) -> DataFrame:
    mine = files.filter(suffix(F.col("path")).isin(*lang.suffixes)).filter(F.col("text").rlike(r"\S"))
    open_code = mine.select("path", "text", _without_comments(_numbered(F.col("text"))).alias("_code"))
    bare = open_code.select("path", "_code", "text", _without_strings(F.col("_code"), lang is RUST).alias("_bare"))
    pattern = "(?m)" + "|".join(p for _, p in lang.marks)
    tokens = F.regexp_extract_all("_bare", F.lit(pattern), F.lit(0))
    lines = F.split(F.regexp_replace("_bare", MARK, ""), "\n", -1)
    judged = bare.select("path", "_code", "_bare", over_budget(lines, F.col("text")).alias("_over"))
    # A refused file is not read further.
    marked = judged.select("path", "_code", F.when(F.col("_over").isNull(), _marks(tokens, lang)).alias("_m"), "_over")
    nested = marked.select(
        "path", "_code", "_over", nest_scopes(F.transform("_m", lambda m: m["kind"]), F.transform("_m", lambda m: m["name"])).alias("_all")
    )

    def last_name(entry):
        plain = F.regexp_extract(entry["name"], r"([\w$~#!]+)$", 1)
        return F.struct(plain.alias("name"), entry["line"].alias("line"), F.regexp_extract(entry["scope"], r"([\w$~#]+)$", 1).alias("scope"))

    split = nested.select(
        "path", "_over",
        F.transform(F.filter("_all", lambda f: f["what"] != "call"), last_name).alias("_defs"),
        F.filter(
            F.transform(F.filter("_all", lambda f: f["what"] == "call"), last_name),
            lambda c: ~c["name"].isin(*NO_CALLS, *SYNTAX),
        ).alias("_calls"),
        F.concat(
            *[F.regexp_extract_all("_code", F.lit(p), F.lit(1)) for p in lang.imports],
            *[
                F.flatten(F.transform(F.regexp_extract_all("_code", F.lit(block), F.lit(1)), _inside(inner)))
                for block, inner in lang.import_blocks
            ],
        ).alias("_mods"),
    )
    defs, calls = _code_facts(turn)
    # A file beyond the budget keeps its own node and says why.
    refused = F.array(warning([turn, 1], message(F.col("path"), F.col("_over"))))
    return emit(split, F.when(F.col("_over").isNotNull(), refused).otherwise(F.concat(defs, _imports(F.col("_mods"), turn), calls)))


def _inside(pattern: str):
    return lambda block: F.regexp_extract_all(block, F.lit(pattern), F.lit(1))


def _occurs(suffixes: tuple[str, ...], endings: list[str] | None) -> bool:
    return endings is None or any(e in endings for e in suffixes)


def refusals(files: DataFrame, turn: int, endings: list[str] | None = None) -> DataFrame:
    """The warnings among the facts of ``code``: files beyond the error budget, judged in one pass for all brace languages."""
    known = [s for lang in LANGUAGES if _occurs(lang.suffixes, endings) for s in lang.suffixes]
    parts = [_python(files, turn).filter(F.col("kind") == WARNING)] if _occurs((".py",), endings) else []
    if known:
        mine = files.select("path", "text", suffix(F.col("path")).alias("_ending")).filter(F.col("_ending").isin(known))
        mine = mine.filter(F.col("text").rlike(r"\S"))
        plain = mine.select("path", "text", "_ending", _without_comments(_unix(F.col("text"))).alias("_code"))
        code = F.col("_code")
        bare = F.when(F.col("_ending").isin(*RUST.suffixes), _without_strings(code, True)).otherwise(_without_strings(code, False))
        lines = F.split(F.regexp_replace(bare, MARK, ""), "\n", -1)
        judged = plain.select("path", over_budget(lines, F.col("text")).alias("_over"))
        refused = F.array(warning([turn, 1], message(F.col("path"), F.col("_over"))))
        parts.append(emit(judged, F.when(F.col("_over").isNotNull(), refused)))
    return union(*parts) if parts else nothing(files)


def code(files: DataFrame, turn: int, endings: list[str] | None = None) -> DataFrame:
    """Facts of source files; ``endings`` names the file endings that occur, to leave idle languages out."""
    own = one(files, fact([turn, 0], node_id("file", "path"), "file", basename(F.col("path")), F.col("path")))
    parts = [_python(files, turn)] if _occurs((".py",), endings) else []
    return union(own, *parts, *[_braces(files, turn, lang) for lang in LANGUAGES if _occurs(lang.suffixes, endings)])
