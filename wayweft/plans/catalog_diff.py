"""Registered patch, review, cache and change-feed queries, with the same queries in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayweft.operators import diffs, evidence, overlay, packing
from wayweft.session import ensure_checkpoint_dir, materialise
from wayweft.sources import pulls
from wayweft.sources import tables as t
from wayweft.streaming import changes

ENDINGS = ", ".join(repr(e) for e in t.PATCH_ENDINGS)
WORDS = ", ".join(repr(w) for w in t.PATCH_WORDS)
LF = "chr(10)"

FILES_SQL = rf"""
files AS (
  SELECT concat('src/', source, '/f', doc_id, '.', ([{ENDINGS}])[doc_id % 6 + 1]) AS filename, doc_id AS file_pos, source,
    'modified' AS status, CAST(len(string_split(text, {LF})) AS INTEGER) AS additions, 0 AS deletions,
    array_to_string(list_transform(string_split(text, {LF}), lambda x, i: concat(
      CASE WHEN (i - 1) % 10 = 0 THEN concat('@@ -', (i - 1) * 2 + 1, ',10 +', (i - 1) * 3 + 5, ',12 @@ part', {LF}) ELSE '' END,
      CASE WHEN (i - 1) % 5 < 2 THEN '+' WHEN (i - 1) % 5 = 2 THEN '-' ELSE ' ' END, ([{WORDS}])[(i - 1) % 8 + 1], x)), {LF}) AS patch
  FROM documents)"""

LINES_SQL = rf"""
plines AS (
  SELECT filename, file_pos, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT filename, file_pos, string_split(patch, {LF}) AS l FROM files WHERE patch <> '')),
roles AS (
  SELECT *, CASE WHEN regexp_matches(line, '^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@') THEN 'hunk' WHEN line LIKE '+++%' OR line LIKE '---%' THEN 'other'
    WHEN line LIKE '+%' THEN 'add' WHEN line LIKE '-%' THEN 'del' WHEN line LIKE ' %' OR line = '' THEN 'ctx' ELSE 'other' END AS role FROM plines),
hunks AS (SELECT *, sum((role = 'hunk')::INT) OVER (PARTITION BY filename ORDER BY pos) AS hunk FROM roles),
numbered AS (
  SELECT *, CAST(coalesce(max(CASE WHEN role = 'hunk' THEN CAST(regexp_extract(line, '^@@ -(\d+)', 1) AS INT) END) OVER (PARTITION BY filename, hunk), 0)
      + coalesce(sum((role IN ('del', 'ctx'))::INT) OVER (PARTITION BY filename, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS old_line,
    CAST(coalesce(max(CASE WHEN role = 'hunk' THEN CAST(regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)', 1) AS INT) END) OVER (PARTITION BY filename, hunk), 0)
      + coalesce(sum((role IN ('add', 'ctx'))::INT) OVER (PARTITION BY filename, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS new_line
  FROM hunks),
visible AS (
  SELECT DISTINCT filename, side, line FROM (
    SELECT filename, 'RIGHT' AS side, new_line AS line FROM numbered WHERE role IN ('add', 'ctx')
    UNION ALL SELECT filename, 'LEFT', old_line FROM numbered WHERE role IN ('del', 'ctx'))),
annotated AS (
  SELECT filename, string_agg(CASE role WHEN 'add' THEN concat('+ [N', new_line, '] ', line[2:]) WHEN 'del' THEN concat('- [O', old_line, '] ', line[2:])
    WHEN 'ctx' THEN concat('  [N', new_line, '] ', line[2:]) ELSE line END, {LF} ORDER BY pos) AS annotated FROM numbered GROUP BY 1),
chunks AS (
  SELECT f.filename, file_pos, source, concat({LF}, '### ', f.filename, ' (', status, ' +', additions, '/-', deletions, ')', {LF},
    CASE WHEN annotated IS NULL THEN concat('(no patch — binary or too large)', {LF})
      WHEN length(annotated) > 8192 THEN concat('```diff', {LF}, left(annotated, 8192), {LF}, '... [truncated]', {LF}, '```', {LF})
      ELSE concat('```diff', {LF}, annotated, {LF}, '```', {LF}) END) AS chunk, coalesce(length(annotated) > 8192, false) AS truncated
  FROM files f LEFT JOIN annotated a USING (filename))"""


def diff_line_numbers(spark, folder):
    return diffs.numbered_lines(t.patch_files(spark, folder)).select("filename", "pos", "role", "old_line", "new_line")


def diff_hunk_sets(spark, folder):
    return diffs.hunk_lines(t.patch_files(spark, folder))


def diff_annotate(spark, folder):
    return diffs.annotate(t.patch_files(spark, folder)).select("filename", F.md5("annotated").alias("annotated_md5"))


def diff_render_chunks(spark, folder):
    return diffs.render_chunks(t.patch_files(spark, folder)).select("filename", F.md5("chunk").alias("chunk_md5"), "truncated")


def diff_inline_validate(spark, folder):
    return diffs.validate_inline(t.inline_rows(spark, folder), diffs.hunk_spans(t.patch_files(spark, folder)))


INLINE_SQL = f"""WITH {FILES_SQL}, {LINES_SQL}, raw AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem),
notes AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS INT)) AS comment_id, filename AS path,
    CAST(l_quantity AS INT) AS line, CASE WHEN l_returnflag = 'R' THEN 'LEFT' ELSE 'RIGHT' END AS side,
    trim(CASE WHEN l_linestatus = 'F' THEN concat(' check ', l_linenumber) WHEN l_linenumber > 1 THEN 'see above' ELSE '  ' END) AS body,
    CAST(l_quantity AS INT) - l_linenumber * 2 + 4 AS start_line,
    CASE l_suppkey % 3 WHEN 0 THEN 'LEFT' WHEN 1 THEN 'RIGHT' END AS start_side
  FROM raw LEFT JOIN files ON file_pos = l_partkey),
seen AS (
  SELECT n.*, body <> '' AND EXISTS (SELECT 1 FROM visible v WHERE v.filename = n.path AND v.side = n.side AND v.line = n.line) AS kept,
    start_line < n.line AND EXISTS (SELECT 1 FROM visible v WHERE v.filename = n.path AND v.side = coalesce(n.start_side, n.side) AND v.line = n.start_line) AS started
  FROM notes n)
SELECT comment_id, path, line, side, body, CASE WHEN kept AND started THEN start_line END AS start_line,
  CASE WHEN kept AND started THEN start_side END AS start_side, kept FROM seen"""


def diff_file_symbols(spark, folder):
    return diffs.file_symbols(t.patch_files(spark, folder)).select("filename", "name", "score")


def diff_changed_symbols(spark, folder):
    return diffs.changed_symbols(t.patch_files(spark, folder))


def _symbols_sql() -> str:
    arms = []
    for ext, patterns in diffs.SYMBOL_PATTERNS.items():
        for n, p in enumerate(patterns):
            arms.append(
                f"SELECT filename, file_pos, pos, {n} AS pat, regexp_extract(line[2:], '{p}', 1) AS name FROM changed WHERE regexp_matches(filename, '\\.({ext})$')"
            )
    words = ", ".join(repr(k) for k in diffs.KEYWORDS)
    return rf"""
changed AS (SELECT * FROM plines WHERE regexp_matches(line, '^[+-]') AND NOT regexp_matches(line, '^(\+\+\+|---)')),
found AS ({' UNION ALL '.join(arms)}),
fsyms AS (
  SELECT filename, file_pos, name, count(*) + CASE WHEN (filename LIKE '%.go' AND regexp_matches(name, '^[A-Z]')) OR (filename LIKE '%.py' AND name NOT LIKE '\_%' ESCAPE '\') THEN 2 ELSE 0 END AS score,
    min((pos, pat)) AS first FROM found WHERE length(name) >= 2 AND name NOT IN ({words}) GROUP BY filename, file_pos, name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY score DESC, first) AS r FROM fsyms QUALIFY r <= 5),
top AS (SELECT name, min((-score, file_pos, r)) AS place, max(score) AS score FROM ranked GROUP BY 1)"""


SYMBOLS_SQL = f"WITH {FILES_SQL}, {LINES_SQL}, {_symbols_sql()} "


def diff_trace_names(spark, folder):
    files = t.patch_files(spark, folder)
    return diffs.trace_names(files, diffs.changed_symbols(files), 50)


TRACE_NAMES_SQL = SYMBOLS_SQL + r""", best AS (SELECT CAST(row_number() OVER (ORDER BY place) AS BIGINT) AS pos, name FROM top ORDER BY place LIMIT 20),
names AS (SELECT (0, file_pos) AS place, regexp_replace(split_part(filename, '/', -1), '\.[^.]+$', '') AS name FROM files
  UNION ALL SELECT (1, pos), name FROM best),
once AS (SELECT name, min(place) AS place FROM names GROUP BY 1 ORDER BY place LIMIT 50)
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS pos, name FROM once"""


def diff_added_identifiers(spark, folder):
    return diffs.added_identifiers(t.patch_files(spark, folder)).select(
        "name", F.col("first.file_pos").alias("file_pos"), F.col("first.line_pos").cast("long").alias("line_pos"),
        F.col("first.word_pos").cast("long").alias("word_pos"),
    )


ADDED_SQL = rf"""WITH {FILES_SQL}, {LINES_SQL}, w AS (
  SELECT file_pos, pos, unnest(l) AS name, unnest(range(len(l))) AS word_pos FROM (
    SELECT file_pos, pos, list_filter(regexp_extract_all(line[2:], '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{{2,}}$')) AS l FROM plines WHERE line LIKE '+%' AND line NOT LIKE '+++%')),
m AS (SELECT name, min((file_pos, pos, word_pos)) AS f FROM w WHERE name NOT IN ('import', 'from', 'return', 'class', 'def', 'func') GROUP BY 1)
SELECT name, f[1] AS file_pos, f[2] AS line_pos, f[3] AS word_pos FROM m"""

BUDGET = 8000


def _sized(spark, folder):
    files = t.patch_files(spark, folder)
    return diffs.render_chunks(files).select(
        "source", "file_pos", F.length("chunk").alias("len")
    )


def diff_batch_packing(spark, folder):
    return packing.pack_batches(_sized(spark, folder), "len", "file_pos", "source", BUDGET).select(
        "source", "file_pos", "size", "batch"
    )


def diff_batch_packing_large(spark, folder):
    """The same packing over many narrow ranges, so that every group crosses bounds and batches are carried over them."""
    return packing.pack_batches(_sized(spark, folder), "len", "file_pos", "source", BUDGET, ranges=64).select(
        "source", "file_pos", "size", "batch"
    )


PACKING_SQL = f"""WITH RECURSIVE {FILES_SQL}, {LINES_SQL}, items AS (
  SELECT source, file_pos, CAST(least(length(chunk), {BUDGET}) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY file_pos) AS n FROM chunks),
packed AS (
  SELECT source, file_pos, size, n, CAST(1 AS BIGINT) AS batch, size AS used FROM items WHERE n = 1
  UNION ALL SELECT i.source, i.file_pos, i.size, i.n, CASE WHEN p.used + i.size > {BUDGET} THEN p.batch + 1 ELSE p.batch END,
    CASE WHEN p.used + i.size > {BUDGET} THEN i.size ELSE p.used + i.size END FROM packed p JOIN items i ON i.source = p.source AND i.n = p.n + 1)
SELECT source, file_pos, size, batch FROM packed"""


def diff_batch_texts(spark, folder):
    files = t.patch_files(spark, folder)
    chunks = materialise(
        diffs.render_chunks(files).select("source", "file_pos", "chunk", "truncated")
    )
    sized = chunks.select("source", "file_pos", F.length("chunk").alias("len"))
    packed = packing.pack_batches(sized, "len", "file_pos", "source", BUDGET)
    out = packing.batch_texts(chunks, packed, "source", "file_pos", BUDGET)
    return out.select("source", "batch", F.md5("body").alias("body_md5"), "bytes", "mode")


BATCH_TEXTS_SQL = PACKING_SQL.replace("SELECT source, file_pos, size, batch FROM packed", f""", texts AS (
  SELECT source, batch, string_agg(CASE WHEN length(chunk) > {BUDGET} THEN concat(left(chunk, {BUDGET}), {LF}, '... [truncated]', {LF}, '```', {LF}) ELSE chunk END, '' ORDER BY file_pos) AS body
  FROM packed JOIN chunks USING (source, file_pos) GROUP BY ALL),
modes AS (SELECT source, CASE WHEN max(batch) > 1 THEN 'batched' WHEN bool_or(truncated) THEN 'trunc' ELSE 'full' END AS mode FROM packed JOIN chunks USING (source, file_pos) GROUP BY 1)
SELECT source, batch, md5(body) AS body_md5, CAST(strlen(body) AS INTEGER) AS bytes, mode FROM texts JOIN modes USING (source)""")


def _reviews(spark, folder):
    """Conversation turns with verdict lines and comment blocks put in by turn and role."""
    turns = t.table(spark, folder, "conversations")
    word = F.element_at(
        F.array(*[F.lit(w) for w in ("approve", "request changes", "Comment", "request_changes", "none")]), (F.col("turn") % 5 + 1).cast("int")
    )
    head = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("**Verdict** — "), word, F.lit("\n"))).when(
        F.col("conv_id") % 3 == 1, F.concat(F.lit("intro\n  verdict: "), word, F.lit("\n"))
    ).otherwise("")
    block = F.concat(
        F.lit('\n```json\n[{"path": "src/a.py", "line": '), F.col("turn").cast("string"), F.lit(', "side": "LEFT", "body": "'),
        F.col("role"), F.lit('"}]\n```\n tail  '),
    )
    text = F.concat(head, "text", F.when(F.col("turn") % 2 == 0, block).otherwise(""))
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), text.alias("text"), "role", "turn")


REVIEWS_SQL = rf"""
reviews AS (
  SELECT concat(conv_id, '-', turn) AS id, role, turn, concat(
    CASE conv_id % 3 WHEN 0 THEN concat('**Verdict** — ', (['approve', 'request changes', 'Comment', 'request_changes', 'none'])[turn % 5 + 1], {LF})
      WHEN 1 THEN concat('intro', {LF}, '  verdict: ', (['approve', 'request changes', 'Comment', 'request_changes', 'none'])[turn % 5 + 1], {LF}) ELSE '' END,
    text, CASE WHEN turn % 2 = 0 THEN concat({LF}, '```json', {LF}, '[{{"path": "src/a.py", "line": ', turn, ', "side": "LEFT", "body": "', role, '"}}]', {LF}, '```', {LF}, ' tail  ') ELSE '' END) AS text
  FROM conversations)"""


def verdict_parse(spark, folder):
    name = diffs.verdict(F.col("text"))
    return _reviews(spark, folder).select("id", name.alias("verdict"), diffs.verdict_event(name).alias("event"))


VERDICT_SQL = rf"""WITH {REVIEWS_SQL}, v AS (
  SELECT id, regexp_replace(lower(regexp_extract(text, '(?i)(?:^|\n)\s*(?:\*\*Verdict\*\*|Verdict)[^\n]*?(approve|comment|request[_\s]?changes)', 1)), '\s', '_', 'g') AS raw FROM reviews)
SELECT id, CASE WHEN raw IN ('approve', 'request_changes') THEN raw ELSE 'comment' END AS verdict,
  upper(CASE WHEN raw IN ('approve', 'request_changes') THEN raw ELSE 'comment' END) AS event FROM v"""


def inline_block_split(spark, folder):
    rows = diffs.split_inline_block(_reviews(spark, folder))
    return rows.select("id", F.md5("review_body").alias("body_md5"), F.size("inline").alias("n_inline"))


INLINE_BLOCK_SQL = rf"""WITH {REVIEWS_SQL}
SELECT id, md5(rtrim(regexp_replace(text, '(?is)```(?:inline-comments|inline|json)\s*\n(.*?)\n```', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS body_md5,
  CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n_inline FROM reviews"""


def comments_without_bots(spark, folder):
    """First thirty turns per conversation, then without automated authors."""
    turns = t.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("pr"), F.col("turn").alias("pos"),
        F.when(F.col("role") == "system", F.lit("ci[bot]")).otherwise(F.col("role")).alias("author"), F.md5("text").alias("body"),
    )
    return pulls.human_comments(turns, 30)


BOTS_SQL = """
WITH c AS (SELECT conv_id AS pr, turn AS pos, CASE WHEN role = 'system' THEN 'ci[bot]' ELSE role END AS author, md5(text) AS body FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 30)
SELECT * FROM c WHERE NOT suffix(author, '[bot]')"""


def pull_coordinates(spark, folder):
    """Coordinates in their three spellings, built from customers and orders."""
    orders = t.table(spark, folder, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("https://GitHub.com/c"), cust, F.lit("/r.x/pull/"), key, F.lit("/files")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" c"), cust, F.lit("/repo#"), key))
        .when(F.col("o_orderkey") % 4 == 2, key)
        .otherwise(F.concat(F.lit("not-"), key))
    )
    rows = orders.select("o_orderkey", text.alias("input"), F.lit("git@github.com:me/mine.git").alias("remote"))
    return pulls.coordinates(rows).select("o_orderkey", "owner", "repo", "number")


COORDS_SQL = r"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('c', o_custkey) WHEN 1 THEN concat('c', o_custkey) WHEN 2 THEN 'me' END AS owner,
  CASE o_orderkey % 4 WHEN 0 THEN 'r.x' WHEN 1 THEN 'repo' WHEN 2 THEN 'mine' END AS repo,
  CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey END AS number FROM orders"""


def _listing(spark, folder):
    return t.doc_rows(spark, folder).select(
        F.col("source").alias("root"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), overlay.digest(F.col("text")).alias("digest")
    )


def content_key(spark, folder):
    return overlay.content_keys(_listing(spark, folder))


def content_key_wide(spark, folder):
    """All documents as one root."""
    return overlay.content_keys(_listing(spark, folder).withColumn("path", F.concat_ws("/", "root", "path")).withColumn("root", F.lit("all")))


def _content_sql(root: str, path: str) -> str:
    return f"""
WITH f AS (SELECT {root} AS root, {path} AS path, sha256(text) AS digest FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/')) AS n FROM f),
r AS (
  SELECT root, (n - 1) // 1000 AS r, sha256(string_agg(concat(path, chr(0), digest, chr(10)), '' ORDER BY n.n)) AS e FROM n GROUP BY ALL)
SELECT root, left(sha256(concat('v2', chr(10), 'hidden=0', chr(10), string_agg(concat(e, chr(10)), '' ORDER BY r.r))), 16) AS content_key FROM r GROUP BY root"""


CONTENT_SQL = _content_sql("source", "concat(lang, '/', doc_id)")
CONTENT_WIDE_SQL = _content_sql("'all'", "concat(source, '/', lang, '/', doc_id)")


def overlay_merge(spark, folder):
    """Documents overlaid by labels' text for labelled toxic ones; the lowest quality ones vanish."""
    base = t.table(spark, folder, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("content"))
    marks = t.table(spark, folder, "labels")
    changed = marks.filter("toxic = 1").select(F.col("doc_id").alias("path"), F.lit("changed").alias("content"))
    removed = marks.filter("toxic = 0 AND quality = 0").select(F.col("doc_id").alias("path"))
    return overlay.overlay(base, changed, removed)


OVERLAY_SQL = """
SELECT doc_id AS path, md5(text) AS content FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) USING (doc_id)
UNION ALL SELECT doc_id, 'changed' FROM labels WHERE toxic = 1"""


def lru_evict_budget(spark, folder):
    entries = t.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("used_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size")
    )
    out = overlay.evict_over_budget(entries, 500_000_000, order=["used_at", "o_orderkey"])
    return out.select("o_orderkey", "size", "evicted")


LRU_SQL = """
WITH e AS (SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders)
SELECT o_orderkey, size, (SELECT sum(size) FROM e) - coalesce(sum(size) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 500000000 AS evicted FROM e"""


def directory_sizes(spark, folder):
    return t.doc_rows(spark, folder).groupBy(F.col("source").alias("root")).agg(
        F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("files")
    )


def dirty_roots(spark, folder):
    """Users as roots and events as file changes, against a build time per root."""
    events = t.table(spark, folder, "events")
    feed = events.select(
        F.col("user_id").cast("string").alias("root"), "ts",
        F.concat(F.when(F.col("event_type") == "error", F.lit("node_modules/")).otherwise(F.lit("src/")), "event_type").alias("path"),
    )
    built = events.groupBy(F.col("user_id").cast("string").alias("root")).agg(
        F.min_by("ts", F.struct("event_type", "ts", "event_id")).alias("built_at")
    )
    return changes.dirty_roots(feed, built)


def _event_feed(rows):
    """Events as a feed: an error touches an ignored file, a purchase is a build, all others change a file."""
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").cast("string").alias("root"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", changes.BUILT).otherwise(changes.CHANGED).alias("event"),
        F.concat(F.when(kind == "error", F.lit("node_modules/")).otherwise(F.lit("src/")), kind).alias("path"),
    )


#: Longer than any feed.
ANY_ORDER = "36500 days"


def _flagged(spark, folder, feed_of):
    """The flag table after all events came in, in several batches."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/feed-{uuid.uuid4().hex}"
    events = t.table(spark, folder, "events").select("user_id", "ts", "event_type")
    files = max(6, events.rdd.getNumPartitions())
    events.repartition(files).write.parquet(f"{place}/events")
    # A batch is a third of the files, so batches grow with the table instead of their number.
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{place}/events")
    # Files come in any order, so no event is late and no root may be given up before the end.
    query = changes.watch(feed_of(stream), f"{place}/flags", f"{place}/state", late=ANY_ORDER, idle_ms=10**13, once=True)
    query.awaitTermination()
    return changes.FlagTable(spark, f"{place}/flags").read()


def dirty_consume_stream(spark, folder):
    """Roots with a change after their last build, from a stream of changes and builds; a build takes the flag back."""
    flags = _flagged(spark, folder, _event_feed)
    return flags.select("root", "changed_at", "built_at", changes.is_dirty().alias("dirty"))


CONSUME_SQL = """
SELECT CAST(user_id AS VARCHAR) AS root, max(ts) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS changed_at,
  max(ts) FILTER (WHERE event_type = 'purchase') AS built_at,
  coalesce(max(ts) FILTER (WHERE event_type NOT IN ('purchase', 'error')) > coalesce(max(ts) FILTER (WHERE event_type = 'purchase'), TIMESTAMP '1970-01-01'), false) AS dirty
FROM events WHERE event_type <> 'error' GROUP BY 1"""


def dirty_roots_stream(spark, folder):
    """The same answer as of the batch reading from the streaming change feed, every event but errors being a change."""
    newest = _flagged(spark, folder, lambda rows: _event_feed(rows).withColumn("event", F.lit(changes.CHANGED)))
    events = t.table(spark, folder, "events")
    built = events.groupBy(F.col("user_id").cast("string").alias("root")).agg(
        F.min_by(F.col("ts").cast("timestamp"), F.struct("event_type", "ts", "event_id")).alias("first_built")
    )
    late = built.join(newest, "root", "left")
    return late.select("root", F.coalesce(F.col("changed_at") > F.col("first_built"), F.lit(False)).alias("dirty"))


DIRTY_SQL = """
WITH built AS (SELECT user_id, arg_min(ts, (event_type, ts, event_id)) AS built_at FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS root, bool_or(event_type <> 'error' AND ts > built_at) AS dirty FROM events JOIN built USING (user_id) GROUP BY 1"""


def evidence_out_of_scope(spark, folder):
    sites = t.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("symbol")
    )
    changed = t.table(spark, folder, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").cast("string").alias("filename"))
    return evidence.outside_request(sites, changed)


SCOPE_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line, l_partkey AS symbol FROM lineitem
ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') o ON o.o_orderkey = l_orderkey"""


def json_props_lenient(spark, folder):
    """Event properties as model replies: plain, fenced, cut short, or prose."""
    events = t.table(spark, folder, "events")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("answer:\n```json\n"), "props", F.lit("\n```\nbye")))
        .when(kind == 2, F.expr("left(props, length(props) - 1)"))
        .otherwise(F.concat(F.lit("text "), "props"))
    )
    parsed = evidence.parse_object(F.col("text"), "k int")
    return events.select("event_id", text.alias("text")).select("event_id", parsed.isNotNull().alias("parse_ok"), parsed["k"].alias("k"))


JSON_SQL = """
SELECT event_id, event_id % 4 < 2 AS parse_ok, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events"""


QUERIES = {
    "diff_line_numbers": (
        diff_line_numbers, f"WITH {FILES_SQL}, {LINES_SQL} SELECT filename, CAST(pos AS INTEGER) AS pos, role, old_line, new_line FROM numbered",
    ),
    "diff_hunk_sets": (diff_hunk_sets, f"WITH {FILES_SQL}, {LINES_SQL} SELECT * FROM visible"),
    "diff_annotate": (diff_annotate, f"WITH {FILES_SQL}, {LINES_SQL} SELECT filename, md5(annotated) AS annotated_md5 FROM annotated"),
    "diff_render_chunks": (
        diff_render_chunks, f"WITH {FILES_SQL}, {LINES_SQL} SELECT filename, md5(chunk) AS chunk_md5, truncated FROM chunks",
    ),
    "diff_inline_validate": (diff_inline_validate, INLINE_SQL),
    "diff_file_symbols": (diff_file_symbols, SYMBOLS_SQL + "SELECT filename, name, score FROM fsyms"),
    "diff_changed_symbols": (
        diff_changed_symbols, SYMBOLS_SQL + "SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS pos, name, score FROM top ORDER BY place LIMIT 20",
    ),
    "diff_trace_names": (diff_trace_names, TRACE_NAMES_SQL),
    "diff_added_identifiers": (diff_added_identifiers, ADDED_SQL),
    "diff_batch_packing": (diff_batch_packing, PACKING_SQL),
    "diff_batch_packing_large": (diff_batch_packing_large, PACKING_SQL),
    "diff_batch_texts": (diff_batch_texts, BATCH_TEXTS_SQL),
    "verdict_parse": (verdict_parse, VERDICT_SQL),
    "inline_block_split": (inline_block_split, INLINE_BLOCK_SQL),
    "comments_without_bots": (comments_without_bots, BOTS_SQL),
    "pull_coordinates": (pull_coordinates, COORDS_SQL),
    "content_key": (content_key, CONTENT_SQL),
    "content_key_wide": (content_key_wide, CONTENT_WIDE_SQL),
    "overlay_merge": (overlay_merge, OVERLAY_SQL),
    "lru_evict_budget": (lru_evict_budget, LRU_SQL),
    "directory_sizes": (
        directory_sizes,
        "SELECT source AS root, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY 1",
    ),
    "dirty_roots": (dirty_roots, DIRTY_SQL),
    "dirty_roots_stream": (dirty_roots_stream, DIRTY_SQL),
    "dirty_consume_stream": (dirty_consume_stream, CONSUME_SQL),
    "evidence_out_of_scope": (evidence_out_of_scope, SCOPE_SQL),
    "json_props_lenient": (json_props_lenient, JSON_SQL),
}
