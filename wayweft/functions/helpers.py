"""Small per-row Python helpers for what column expressions cannot say; Arrow batches carry the rows."""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TEXT = T.StringType()


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields.items()]))


_WORD = re.compile(r"[^\W_]+", re.UNICODE)
SNIPPET_TOKENS = 16


def _folded(word: str) -> str:
    """Lower case; letters with one mark lose it, as in the index."""
    parts = (unicodedata.normalize("NFD", c) for c in word.lower())
    return "".join(p[0] if len(p) == 2 and unicodedata.combining(p[1]) else unicodedata.normalize("NFC", p) for p in parts)


def _extract(text: str, prefixes: list[str], stems: dict | None) -> str:
    """Best run of tokens around the query words, with marks, in the manner of SQLite's snippet()."""
    spans = [m.span() for m in _WORD.finditer(text)]
    names = [_folded(text[a:b]) for a, b in spans]
    if stems:
        names = [stems.get(n, n) for n in names]
    hits = [(i, k) for i, n in enumerate(names) for k, p in enumerate(prefixes) if n.startswith(p)]
    total = len(spans)
    starts = [0] + [
        i for i in range(1, total) if re.search(r"[.:][ \t\n\r]+$", text[spans[i - 1][1] : spans[i][0]])
    ]

    def score(begin: int) -> tuple[int, int, int]:
        seen, value, first, last = set(), 0, -1, -1
        for i, k in hits[bisect_left(hits, (begin, -1)) : bisect_left(hits, (begin + SNIPPET_TOKENS, -1))]:
            value += 1 if k in seen else 1000
            seen.add(k)
            first, last = (i if first < 0 else first), i + 1
        return value, first, last

    best, begin = 0, 0
    for i, _ in hits:
        value, first, last = score(i)
        if value > best:
            shift = first - (SNIPPET_TOKENS - (last - first)) // 2
            best, begin = value, max(0, min(shift, total - SNIPPET_TOKENS))
        if total > SNIPPET_TOKENS:
            open_at = starts[bisect_right(starts, i) - 1]
            if open_at < i:
                value = score(open_at)[0] + (120 if open_at == 0 else 100)
                if value > best:
                    best, begin = value, open_at
    marked = {i for i, _ in hits}
    end = min(begin + SNIPPET_TOKENS, total)
    out, at = [], 0 if begin == 0 else spans[begin][0]
    for i in range(begin, end):
        a, b = spans[i]
        word = text[a:b]
        out += [text[at:a], f"<mark>{word}</mark>" if i in marked else word]
        at = b
    tail = text[at:] if end >= total else "..."
    return ("..." if begin > 0 else "") + "".join(out) + tail


@F.pandas_udf(TEXT)
def snippet(texts: pd.Series, prefixes: pd.Series) -> pd.Series:
    return pd.Series([_extract(t or "", list(p), None) for t, p in zip(texts, prefixes)])


@F.pandas_udf(TEXT)
def stemmed_snippet(texts: pd.Series, prefixes: pd.Series, stems: pd.Series) -> pd.Series:
    """As ``snippet``, with a map from folded word to stem per row."""
    return pd.Series(
        [_extract(t or "", list(p), dict(s) if s is not None else None) for t, p, s in zip(texts, prefixes, stems)]
    )


# --- Python sources -------------------------------------------------------------------------------

PY_FACTS = _rows(stage=T.IntegerType(), name=TEXT, line=T.IntegerType(), scope=TEXT)
DEF, IMPORT, CALL, FAULT = 0, 1, 2, 3
# Nodes that hold no other ones.
_LEAVES = (ast.expr_context, ast.Name, ast.Constant, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)


class _PyFacts(ast.NodeVisitor):
    """Definitions, imports and calls with the innermost enclosing definition."""

    def __init__(self, text: str):
        self.lines, self.scope, self.found = text.split("\n"), None, []

    def generic_visit(self, node):
        for field in node._fields:
            value = getattr(node, field, None)
            for child in value if type(value) is list else (value,):
                if isinstance(child, ast.AST) and not isinstance(child, _LEAVES):
                    self.visit(child)

    def note(self, stage: int, name: str, node: ast.AST) -> None:
        self.found.append((stage, name, node.lineno, self.scope))

    def visit_FunctionDef(self, node):
        for extra in node.decorator_list:
            self.visit(extra)
        self.note(DEF, node.name, node)
        outer, self.scope = self.scope, node.name
        for child in ast.iter_child_nodes(node):
            if child not in node.decorator_list:
                self.visit(child)
        self.scope = outer

    visit_AsyncFunctionDef = visit_ClassDef = visit_FunctionDef

    def visit_Import(self, node):
        for alias in node.names:
            self.note(IMPORT, alias.name, node)

    def visit_ImportFrom(self, node):
        if node.module != "__future__":
            self.note(IMPORT, "." * node.level + (node.module or ""), node)

    def visit_Call(self, node):
        func = node.func
        name = getattr(func, "id", None) or getattr(func, "attr", None)
        if name is None:
            shown = self.lines[func.lineno - 1 : func.end_lineno]
            name = ast.unparse(func) if len(shown) > 1 else shown[0][func.col_offset : func.end_col_offset]
            name = name.split(".")[-1].strip()
        self.note(CALL, name, node)
        self.generic_visit(node)


def _python(text: str):
    visitor = _PyFacts(text)
    try:
        visitor.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        rough = re.finditer(r"(?m)^[ \t]*(?:(?:async[ \t]+)?def|class)[ \t]+(\w+)|^[ \t]*(?:from|import)[ \t]+([\w.]+)", text or "")
        fault = (FAULT, str(error), getattr(error, "lineno", None), None)
        return [(DEF if m[1] else IMPORT, m[1] or m[2], text.count("\n", 0, m.start()) + 1, None) for m in rough] + [fault]
    return visitor.found


@F.arrow_udf(PY_FACTS)
def python_facts(texts: pa.Array) -> pa.Array:
    return pa.array([_python(t or "") for t in texts.to_pylist()], to_arrow_type(PY_FACTS))


# --- Brace languages --------------------------------------------------------------------------------


def _nest(kinds, names):
    """Line and enclosing definition of every definition and call in a stream of marks."""
    stack, depth, line, pending, out = [], 0, 1, None, []
    for kind, name in zip(kinds, names):
        if kind == "line":
            line = int(name)
            if pending and pending[1]:
                pending = None
        elif kind == "open":
            if pending:
                stack.append((depth, pending[0]))
                pending = None
            depth += 1
        elif kind == "close":
            depth -= 1
            while stack and stack[-1][0] >= depth:
                stack.pop()
        elif kind == "end":
            pending = None
        else:
            scope = pending[0] if pending else stack[-1][1] if stack else None
            out.append((kind, name, line, scope))
            if kind in ("def", "arrow"):
                pending = (name, kind == "arrow")
            elif kind == "body":
                stack.append((depth, name))
                depth += 1
    return out


SCOPES = _rows(what=TEXT, name=TEXT, line=T.IntegerType(), scope=TEXT)


@F.arrow_udf(SCOPES)
def nest_scopes(kinds: pa.Array, names: pa.Array) -> pa.Array:
    """Null lists of marks hold none."""
    ends = np.cumsum(kinds.value_lengths().fill_null(0).to_numpy())
    kind, name = (a.flatten().to_numpy(zero_copy_only=False) for a in (kinds, names))
    return pa.array([_nest(kind[a:b], name[a:b]) for a, b in zip([0, *ends], ends)], to_arrow_type(SCOPES))


# --- Shell ----------------------------------------------------------------------------------------

COMMANDS = _rows(bare=T.BooleanType(), env=T.ArrayType(TEXT), head=TEXT, args=T.ArrayType(TEXT), text=TEXT)
_HEREDOC = re.compile(r"<<-?[ \t]*\\?(['\"]?)(\w+)\1")
_PARENS = re.compile(r"\s*\)")
_SUBST = re.compile(r"\$\((?!\()|`")
# What a word, a double-quoted piece and a substitution pass over without a look at each character.
_WORD_RUN = re.compile(r"[^\s;&|()<>\"'`\\$]+")
_SKIPS = {'"': re.compile(r'[^"\\`$]+'), "$(": re.compile(r"[^)\"'\\`$]+"), "${": re.compile(r"[^}\"'\\`$]+")}
# Characters that begin nothing but a word.
_WORD_HEADS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_./-\"'$")
_FILE_REDIR = re.compile(r"[&][ \t]*[\d-]+$")
_DEEP = 200
_SHELL = re.compile(
    r"""(?P<skip>\\\n|[^\S\n]+|(?<![^\s;&|(])\#[^\n]*)|(?P<redir>\d*(?:<<<|>>|<<|>&|<&|&>|[<>])&?[ \t]*\d*-?)"""
    r"""|(?P<sep>;;|&&|\|\||[;&|\n()])"""
)
_ASSIGN = re.compile(r"([A-Za-z_]\w*)\+?=")
# Words that introduce a command rather than name one.
_SHELL_WORDS = frozenset("if then elif else fi do done while until for in case esac { } ! time function select".split())


def _close(text: str, i: int, depth: int = 0) -> int:
    """End of the quoted or substituted piece that starts at ``i``; absurdly deep nesting runs to the end."""
    if depth > _DEEP:
        return len(text)
    if text[i] == "\\":
        return min(i + 2, len(text))
    if text[i] == "'" or text[i] == "`":
        j = text.find(text[i], i + 1)
        return len(text) if j < 0 else j + 1
    ends = {'"': '"', "$(": ")", "${": "}"}
    opener = '"' if text[i] == '"' else text[i : i + 2]
    if opener not in ends:
        return i + 1
    i += len(opener)
    stop, run = ends[opener], _SKIPS[opener].match
    while i < len(text) and text[i] != stop:
        plain = run(text, i)
        if plain:
            i = plain.end()
            continue
        nested = text[i] in "\\`" or text.startswith(("$(", "${"), i) or (opener != '"' and text[i] in "\"'")
        i = _close(text, i, depth + 1) if nested else i + 1
    return min(i + 1, len(text))


def _without_heredocs(text: str) -> str:
    """Drop heredoc bodies that end; each line is looked at once."""
    if "<<" not in text:
        return text
    lines, ends, out, i = text.split("\n"), {}, [], 0
    for n, line in enumerate(lines):
        ends.setdefault(line.strip(), []).append(n)
    while i < len(lines):
        last = i
        for mark in _HEREDOC.finditer(lines[i]):
            spots = ends.get(mark[2], [])
            k = bisect_right(spots, last)
            last = spots[k] if k < len(spots) else last
        out.append(lines[i] if last == i else _HEREDOC.sub(" ", lines[i]))
        i = last + 1
    return "\n".join(out)


def _unquote(word: str) -> str:
    word = word.strip()
    return word[1:-1] if len(word) > 1 and word[0] == word[-1] and word[0] in "\"'" else word


def _inner(text: str):
    """Texts of the outermost command substitutions inside a word."""
    mark = _SUBST.search(text)
    while mark:
        end = _close(text, mark.start())
        yield text[mark.end() : end - 1]
        mark = _SUBST.search(text, max(end, mark.end()))


def _commands(text: str, depth: int = 0):
    """Simple commands of a script in source order, with those inside substitutions after their host."""
    text = _without_heredocs(text)
    plain, bare, i, words, span, skip_word, loop, opened = [], [], 0, [], None, False, False, 0

    def flush():
        nonlocal words, span, loop
        env, hosted = [], words
        for word in hosted:
            name = _ASSIGN.match(word)
            if not name:
                break
            env.append(name[1])
        words = hosted[len(env) :]
        whole = text[span[0] : span[1]].strip() if span else ""
        if words:
            plain.append((False, env, _unquote(words[0]), [_unquote(w) for w in words[1:]], whole))
        else:
            bare.extend((True, [name], None, [], e) for name, e in zip(env, hosted))
        if depth < 20:
            for word in hosted:
                if "$(" not in word and "`" not in word:
                    continue
                for sub in _inner(word) if not word.startswith("'") else ():
                    more, more_bare = _commands(sub, depth + 1)
                    plain.extend(more)
                    bare.extend(more_bare)
        words, span, loop = [], None, False

    while i < len(text):
        if text[i] == " ":
            i += 1
            continue
        m = None if text[i] in _WORD_HEADS else _SHELL.match(text, i)
        if m and m["skip"]:
            i = m.end()
        elif m and m["redir"]:
            i, skip_word = m.end(), not _FILE_REDIR.search(m[0])
        elif m:
            named = m[0] == "(" and _PARENS.match(text, m.end())  # function definition
            if named or (m[0] == ")" and not opened):  # or case pattern
                words = []
            opened += {"(": 1, ")": -(opened > 0)}.get(m[0], 0)
            flush()
            i, skip_word = m.end(), False
        else:
            j = i
            while j < len(text):
                run = _WORD_RUN.match(text, j)
                if run:
                    j = run.end()
                elif text[j] in "\"'`\\$":
                    j = _close(text, j)
                else:
                    break
            word = text[i:j]
            if skip_word:
                skip_word = False
            elif not words and not loop and word in _SHELL_WORDS:
                loop = word in ("for", "select", "case", "function")
            elif not loop:
                words.append(word)
                span = (span[0] if span else i, j)
            i = j
    flush()
    return plain, bare


@F.arrow_udf(COMMANDS)
def shell_commands(texts: pa.Array) -> pa.Array:
    """Commands of shell texts, then their bare assignments."""
    return pa.array([_all_commands(t) for t in texts.to_pylist()], to_arrow_type(COMMANDS))


def _all_commands(text: str | None):
    if not text:
        return []
    try:
        return [c for part in _commands(text) for c in part]
    except RecursionError:
        return []


# --- YAML -----------------------------------------------------------------------------------------


try:
    import yaml
except ImportError:
    yaml = None
_FAST_YAML = getattr(yaml, "CSafeLoader", None)
# The two loaders of PyYAML read texts without these characters alike, unless the fast one gives up.
_READ_APART = re.compile("[\t?%\x85\u2028\u2029\ufeff]")


def _load(text: str):
    """The value of a YAML text; the fast loader reads plain texts, the other one all others and words what is wrong."""
    if _FAST_YAML is not None and not _READ_APART.search(text):
        try:
            return yaml.load(text, _FAST_YAML)
        except Exception:
            pass
    return yaml.safe_load(text)


def _plain(value):
    """Mappings and lists as they are; every scalar as its text behind ``s:`` for strings, ``v:`` otherwise."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    return ("s:" if isinstance(value, str) else "v:") + str(value)


# The wording of the two warnings on YAML files.
BAD_YAML, NO_MAPPING = "invalid YAML: {}", "top-level YAML must be a mapping, got {}"


def _yaml(text: str):
    """(JSON of a mapping, what is wrong); one odd file never ends the task, also not with anchors that hold themselves."""
    if yaml is None:
        return None, "no YAML reader installed"
    try:
        read = _load(text)
        found = {str(k): _plain(v) for k, v in read.items()} if isinstance(read, dict) else None
        shown = json.dumps(found, ensure_ascii=False)
    except Exception as exc:
        return None, BAD_YAML.format(exc)
    if found is not None:
        return shown, None
    return None, None if read is None else NO_MAPPING.format(type(read).__name__)


@F.pandas_udf(T.StructType([T.StructField("json", TEXT), T.StructField("error", TEXT)]))
def yaml_object(texts: pd.Series) -> pd.DataFrame:
    """YAML mappings as JSON, or what is wrong with them."""
    return pd.DataFrame([_yaml(t or "") for t in texts], columns=["json", "error"])
