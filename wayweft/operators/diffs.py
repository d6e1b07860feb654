"""Analytics over pull-request patches: line numbering, changed symbols, comment checks, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayweft.functions.strings import SPACE_CHARS, basename, strip

# Fixed value: how a hunk's header gives the first line on both sides.
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"

# Per file extension, the patterns whose first group is a changed symbol.
SYMBOL_PATTERNS = {
    "go": [
        r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)",
        r"\btype\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    ],
    "rs": [
        r"\b(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)",
        r"\b(?:pub\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)",
        r"\b(?:pub\s+)?enum\s+([A-Za-z_][A-Za-z0-9_]*)",
    ],
    "py": [
        r"\bdef\s+([A-Za-z_][A-Za-z0-9_]*)",
        r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)",
    ],
    "ts|tsx|js|jsx|mjs|cjs": [
        r"\b(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"\b(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"\b(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=",
        r"\b(?:export\s+)?interface\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"\b(?:export\s+)?type\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=",
    ],
    "c|cc|cpp|cxx|h|hpp": [
        r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)",
        r"\bstruct\s+([A-Za-z_][A-Za-z0-9_]*)",
    ],
    "java": [
        r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)",
        r"\binterface\s+([A-Za-z_][A-Za-z0-9_]*)",
    ],
}
# Words that are never symbols.
KEYWORDS = (
    "if", "else", "for", "while", "return", "switch", "case", "break", "continue", "import", "package",
    "from", "as", "in", "is", "and", "or", "not", "true", "false", "null", "nil", "None", "True", "False",
    "self", "this", "new", "void", "int", "string", "bool", "let", "const", "var", "fn", "def", "func",
    "type", "class", "struct", "enum", "impl", "interface", "pub", "static", "public", "private",
    "protected", "final", "async", "await", "function", "export",
)
# Stop words of the added-identifier list.
ADDED_STOP_WORDS = ("import", "from", "return", "class", "def", "func")


def _request(df: DataFrame) -> list[str]:
    """The column that tells requests apart, where a table holds several; equal file names then stay apart."""
    return ["request"] if "request" in df.columns else []


def _file(df: DataFrame) -> list[str]:
    return [*_request(df), "filename"]


def _first_of_request(rows: DataFrame, at: str, most: int) -> DataFrame:
    """The first ``most`` rows of a request, or of the whole table, by ``at``, numbered in ``pos``."""
    if not _request(rows):
        rows = rows.orderBy(at).limit(most)
    place = F.row_number().over(Window.partitionBy(*_request(rows)).orderBy(at))
    return rows.withColumn("pos", place).filter(F.col("pos") <= most)


def _role(line: Column) -> Column:
    return (
        F.when(line.rlike(HUNK), "hunk")
        .when(line.startswith("+++") | line.startswith("---"), "other")
        .when(line.startswith("+"), "add")
        .when(line.startswith("-"), "del")
        .when(line.startswith(" ") | (line == ""), "ctx")
        .otherwise("other")
    )


def _hunk_start(line: Column, side: int) -> Column:
    """The first line number that a hunk's header names, 1: old side, 2: new side."""
    return F.coalesce(F.regexp_extract(line, HUNK, side).try_cast("int"), F.lit(0))


#: For each side (old, new): the group of the header and the first letters of the roles that don't count there.
_SIDES = ((1, "ao"), (2, "do"))


def _numbers(lines: Column, marks: Column, base: list[Column]) -> list[Column]:
    """What the next line has as number on both sides after ``lines``, whose roles' first letters are ``marks``.

    The last header says where to count from; without one it is ``base``.
    """
    tail = F.substring_index(marks, "h", -1)
    head = F.length(marks) - F.length(tail)
    out = []
    for (side, other), start in zip(_SIDES, base):
        passed = F.length(F.translate(tail, other, ""))
        out.append(F.when(head > 0, _hunk_start(F.get(lines, head - 1), side)).otherwise(start) + passed)
    return out


def _numbered(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``filename, <keep>, numbered``: the lines of each patch as structs pos, line, role, old_line, new_line.

    Nothing leaves its row. Lines are counted in blocks of about the square root of their number, so
    the work stays far below the square of a long patch.
    """
    own = _file(files)
    rows = files.select(*own, *[c for c in keep if c not in own], F.split("patch", "\n", -1).alias("_lines"), "patch")
    marked = rows.withColumn("_marks", F.array_join(F.transform("_lines", lambda line: F.left(_role(line), F.lit(1))), ""))
    step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.length("_marks"))).cast("int"))
    marked = marked.withColumn("_step", step)
    lines, marks = F.col("_lines"), F.col("_marks")

    def block(at: Column) -> Column:
        old, new = _numbers(lines, F.left(marks, at), [F.lit(0), F.lit(0)])
        return F.struct(
            at.alias("at"), F.slice(lines, at + 1, F.col("_step")).alias("lines"), F.substring(marks, at + 1, F.col("_step")).alias("marks"),
            old.alias("old"), new.alias("new"),
        )

    def number(b: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            role = _role(line)
            counted = _numbers(b["lines"], F.left(b["marks"], i), [b["old"], b["new"]])
            old, new = [F.when(role == "hunk", _hunk_start(line, side)).otherwise(n) for (side, _), n in zip(_SIDES, counted)]
            return F.struct((b["at"] + i).alias("pos"), line.alias("line"), role.alias("role"), old.alias("old_line"), new.alias("new_line"))

        return F.transform(b["lines"], one)

    blocks = F.transform(F.sequence(F.lit(0), F.length(marks) - 1, F.col("_step")), block)
    filled = marked.withColumn("_blocks", F.when(F.col("patch") != "", blocks))
    return filled.select(*own, *[c for c in keep if c not in own], F.flatten(F.transform("_blocks", number)).alias("numbered"))


def numbered_lines(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``filename, <keep>, pos, line, role``, ``old_line`` and ``new_line``, the numbers a line has (or would have) on either side."""
    rows = _numbered(files, keep)
    rest = [c for c in rows.columns if c != "numbered"]
    return rows.select(*rest, F.explode_outer("numbered").alias("_l")).filter("_l IS NOT NULL").select(*rest, "_l.*")


def hunk_spans(files: DataFrame) -> DataFrame:
    """``filename, spans``: the visible lines of a file as stretches ``side, first, last``, one a hunk and side.

    A hunk shows its lines without a gap, so its header and two counts say all. Rows of the same file
    are taken together.
    """
    own = _file(files)
    # A hunk begins at the start of a line only.
    hunks = F.split("patch", "\n(?=" + HUNK.removeprefix("^") + ")", -1)

    def sides(hunk: Column) -> Column:
        roles = F.transform(F.split(hunk, "\n", -1), _role)
        counts = [F.size(F.filter(roles, lambda r: r.isin(kind, "ctx"))) for kind in ("del", "add")]
        first = [_hunk_start(hunk, side) for side, _ in _SIDES]
        return F.array(
            *[
                F.struct(F.lit(name).alias("side"), start.alias("first"), (start + n - 1).alias("last"))
                for name, start, n in zip(("LEFT", "RIGHT"), first, counts)
            ]
        )

    rows = files.filter(F.col("patch") != "").select(*own, F.flatten(F.transform(hunks, sides)).alias("spans"))
    shown = rows.withColumn("spans", F.filter("spans", lambda s: s["first"] <= s["last"]))
    return shown.groupBy(*own).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def hunk_lines(files: DataFrame) -> DataFrame:
    """Visible lines ``filename, side, line``; context lines are visible on both sides."""
    own = _file(files)
    shown = hunk_spans(files).select(*own, F.explode_outer("spans").alias("_s")).filter("_s IS NOT NULL")
    lines = shown.select(*own, "_s.side", F.explode(F.sequence("_s.first", "_s.last")).alias("line"))
    return lines.distinct()


def _tagged(line: Column) -> Column:
    """A numbered line with its ``[N#]`` or ``[O#]`` tag."""
    body = F.substring(line["line"], F.lit(2), F.length(line["line"]))

    def tag(sign: str, letter: str, number: str) -> Column:
        return F.concat(F.lit(f"{sign} [{letter}"), line[number].cast("string"), F.lit("] "), body)

    return (
        F.when(line["role"] == "add", tag("+", "N", "new_line"))
        .when(line["role"] == "del", tag("-", "O", "old_line"))
        .when(line["role"] == "ctx", tag(" ", "N", "new_line"))
        .otherwise(line["line"])
    )


def annotate(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``filename, <keep>, annotated``: whole patches with line tags, made inside their rows; files without a patch are left out."""
    rows = _numbered(files, keep).filter("numbered IS NOT NULL")
    return rows.withColumn("annotated", F.array_join(F.transform("numbered", _tagged), "\n")).drop("numbered")


def render_chunks(files: DataFrame, max_bytes: int = 8192) -> DataFrame:
    """``filename, file_pos, <other columns>, chunk, truncated``: one review block per file, long patches cut."""
    shape = ("status", "additions", "deletions")
    rest = [c for c in files.columns if c not in (*_file(files), "file_pos", *shape, "patch", "chunk", "truncated")]
    head = F.concat(
        F.lit("\n### "), F.col("filename"), F.lit(" ("), F.col("status"), F.lit(" +"),
        F.col("additions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"), F.lit(")\n"),
    )
    text = F.col("annotated")
    long = F.length(text) > max_bytes
    body = (
        F.when(text.isNull(), F.lit("(no patch — binary or too large)\n"))
        .when(long, F.concat(F.lit("```diff\n"), F.left(text, F.lit(max_bytes)), F.lit("\n... [truncated]\n```\n")))
        .otherwise(F.concat(F.lit("```diff\n"), text, F.lit("\n```\n")))
    )
    rows = _numbered(files, ("file_pos", *shape, *rest))
    rows = rows.withColumn("annotated", F.array_join(F.transform("numbered", _tagged), "\n"))
    return rows.select(*_file(files), "file_pos", *rest, F.concat(head, body).alias("chunk"), F.coalesce(long, F.lit(False)).alias("truncated"))


def _ascii_edges(pattern: str) -> str:
    """Word edges that see only ASCII word characters, in every Java version."""
    return "(?<![A-Za-z0-9_])" + pattern.removeprefix("\\b").removesuffix("\\b")


def file_symbols(files: DataFrame) -> DataFrame:
    """``filename, file_pos, name, score, first``: changed symbols and their counts per file."""
    own = _file(files)
    lines = files.filter(F.col("patch") != "").select(
        *own, "file_pos", F.posexplode_outer(F.split("patch", "\n", -1)).alias("pos", "line")
    ).filter("pos IS NOT NULL")
    changed = lines.filter(F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^(\+\+\+|---)"))
    body = F.expr("substring(line, 2)")
    names = F.lit(None).cast("array<string>")
    for ext, patterns in SYMBOL_PATTERNS.items():
        found = F.array(*[F.regexp_extract(body, _ascii_edges(p), 1) for p in patterns])
        names = F.when(F.col("filename").rlike(rf"\.({ext})$"), found).otherwise(names)
    hits = changed.select(*own, "file_pos", "pos", F.posexplode_outer(names).alias("pat", "name")).filter("pat IS NOT NULL")
    counted = (
        hits.filter((F.length("name") >= 2) & ~F.col("name").isin(*KEYWORDS))
        .groupBy(*own, "file_pos", "name")
        .agg(F.count("*").alias("_count"), F.min(F.struct("pos", "pat")).alias("first"))
    )
    exported = F.when(F.col("filename").endswith(".go"), F.col("name").rlike("^[A-Z]")).when(
        F.col("filename").endswith(".py"), ~F.col("name").startswith("_")
    ).otherwise(False)
    return counted.withColumn("score", F.col("_count") + F.when(exported, 2).otherwise(0)).drop("_count")


def changed_symbols(files: DataFrame, max_total: int = 20, max_per_file: int = 5) -> DataFrame:
    """``pos, name, score``: best changed symbols over all files of a request, each name once."""
    in_file = Window.partitionBy(*_file(files)).orderBy(F.desc("score"), "first")
    kept = file_symbols(files).withColumn("_rank", F.row_number().over(in_file)).filter(F.col("_rank") <= max_per_file)
    place = F.struct((-F.col("score")).alias("neg"), "file_pos", "_rank")
    once = kept.groupBy(*_request(files), "name").agg(F.min(place).alias("_at"))
    return _first_of_request(once, "_at", max_total).select(*_request(files), "pos", "name", (-F.col("_at.neg")).alias("score"))


def trace_names(files: DataFrame, symbols: DataFrame, cap: int = 50) -> DataFrame:
    """``pos, name``: file basenames without extension, then changed symbols, each once, at most ``cap``."""
    own = _request(files)
    names = files.select(
        *own, F.struct(F.lit(0).alias("phase"), F.col("file_pos").alias("n")).alias("_at"),
        F.regexp_replace(basename(F.col("filename")), r"\.[^.]+$", "").alias("name"),
    ).unionByName(symbols.select(*own, F.struct(F.lit(1).alias("phase"), F.col("pos").alias("n")).alias("_at"), "name"))
    top = names.groupBy(*own, "name").agg(F.min("_at").alias("_at"))
    return _first_of_request(top, "_at", cap).select(*own, "pos", "name")


def validate_inline(comments: DataFrame, spans: DataFrame) -> DataFrame:
    """Check review comments against the visible stretches of ``hunk_spans``, one row a file, in one join.

    ``comments``: comment_id, path, line, side, body, start_line, start_side, and request where both
    tables have it. Adds ``kept``; a start
    line stays only when it lies before the line and is visible on its side.
    """
    side = F.when(F.col("side") == "LEFT", "LEFT").otherwise("RIGHT")
    start_side = F.when(F.col("start_side").isin("LEFT", "RIGHT"), F.col("start_side"))
    own = _request(spans)
    clean = comments.select(
        *own, "comment_id", "path", "line", side.alias("side"), strip(F.coalesce("body", F.lit(""))).alias("body"),
        F.when(F.col("start_line") < F.col("line"), F.col("start_line")).alias("start_line"),
        start_side.alias("start_side"),
    )

    def shown(side: Column, line: Column) -> Column:
        return F.coalesce(F.exists("spans", lambda s: (s["side"] == side) & line.between(s["first"], s["last"])), F.lit(False))

    # Comments without a path meet no file; a second key keeps them from meeting in one task.
    spread = F.when(F.coalesce("path", F.lit("")) == "", F.xxhash64("comment_id", "line")).otherwise(F.xxhash64("path"))
    shown_in = spans.withColumnRenamed("filename", "path").withColumn("_spread", F.xxhash64("path"))
    joined = clean.withColumn("_spread", spread).join(shown_in, [*own, "path", "_spread"], "left")
    kept = shown(F.col("side"), F.col("line")) & (F.coalesce("path", F.lit("")) != "") & (F.col("body") != "")
    judged = joined.withColumns({"kept": kept, "_started": shown(F.coalesce("start_side", "side"), F.col("start_line"))})
    started = F.col("kept") & F.col("_started")
    return judged.select(
        *own, "comment_id", "path", "line", "side", "body",
        F.when(started, F.col("start_line")).alias("start_line"),
        F.when(started, F.col("start_side")).alias("start_side"),
        "kept",
    )


def added_identifiers(files: DataFrame) -> DataFrame:
    """``pos, name``: identifiers of three letters and more on added lines, each once, in order."""
    own = _request(files)
    lines = files.filter(F.col("patch") != "").select(
        *own, "file_pos", F.posexplode_outer(F.split("patch", "\n", -1)).alias("line_pos", "line")
    ).filter("line_pos IS NOT NULL")
    added = lines.filter(F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    whole = F.regexp_extract_all(F.expr("substring(line, 2)"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    found = F.filter(whole, lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]{2,}$"))
    words = added.select(*own, "file_pos", "line_pos", F.posexplode_outer(found).alias("word_pos", "name")).filter("word_pos IS NOT NULL")
    return (
        words.filter(~F.col("name").isin(*ADDED_STOP_WORDS))
        .groupBy(*own, "name")
        .agg(F.min(F.struct("file_pos", "line_pos", "word_pos")).alias("first"))
    )


# Fixed value: how a review states its verdict.
VERDICT = r"(?i)(?:^|\n)\s*(?:\*\*Verdict\*\*|Verdict)[^\n]*?(approve|comment|request[_\s]?changes)"


def verdict(text: Column) -> Column:
    """``approve``, ``request_changes`` or ``comment`` as a review text states it; ``comment`` by default."""
    raw = F.regexp_replace(F.lower(F.regexp_extract(text, VERDICT, 1)), r"\s", "_")
    return F.when(raw.isin("approve", "request_changes"), raw).otherwise("comment")


def verdict_event(name: Column) -> Column:
    return F.upper(name)


# Fixed value: the fenced block that holds comments.
INLINE_BLOCK = r"(?is)```(?:inline-comments|inline|json)\s*\n(.*?)\n```"
INLINE_TYPE = (
    "array<struct<path:string,line:string,side:string,body:string,start_line:string,startLine:string,"
    "start_side:string,startSide:string>>"
)


def split_inline_block(reviews: DataFrame, text: str = "text") -> DataFrame:
    """Add ``review_body`` (text without its first comment block) and ``inline`` (the parsed block)."""
    body = F.rtrim(F.regexp_replace(text, INLINE_BLOCK + r"(.*)", "$2"), F.lit(SPACE_CHARS))
    block = F.regexp_extract(text, INLINE_BLOCK, 1)
    none = F.array().cast(INLINE_TYPE)
    # A lone object is no list of comments, though the reader would take it for one.
    block = F.when(block.rlike(r"^\s*\["), block)
    return reviews.withColumn("review_body", body).withColumn(
        "inline", F.coalesce(F.from_json(block, INLINE_TYPE), none)
    )


def inline_comments(reviews: DataFrame, key: str) -> DataFrame:
    """The comments of ``split_inline_block`` as rows for ``validate_inline``."""
    rows = reviews.select(key, F.posexplode_outer("inline").alias("_i", "_c")).filter("_i IS NOT NULL")
    return rows.select(
        F.concat_ws("#", F.col(key).cast("string"), F.col("_i").cast("string")).alias("comment_id"),
        "_c.path", F.expr("try_cast(_c.line AS int)").alias("line"), "_c.side", "_c.body",
        F.expr("try_cast(coalesce(_c.start_line, _c.startLine) AS int)").alias("start_line"),
        F.coalesce("_c.start_side", "_c.startSide").alias("start_side"),
    )
