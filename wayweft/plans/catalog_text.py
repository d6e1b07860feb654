"""Registered text queries: full-text search, sections, links, path rules; with the same queries in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayweft.functions.porter import Dialect, stem_steps
from wayweft.functions.strings import glob_match
from wayweft.operators import links, search, sections
from wayweft.sources import scan
from wayweft.sources import tables as t
from wayweft.session import ensure_checkpoint_dir, shuffle_width
from wayweft.sinks import text_index

SPACES = r"[\t\x0b\x0c \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
TRIM_SET = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8239) || chr(12288)"
WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"

SYMBOLS_SQL = """
syms AS (
  SELECT concat('workflow_job:', n_nationkey) AS id, 'workflow_job' AS kind, n_name AS label, 1000000000000 + n_nationkey AS rowid FROM nation
  UNION ALL SELECT concat('script:', c_custkey), 'script', c_name, 2000000000000 + c_custkey FROM customer
  UNION ALL SELECT concat('target:', s_suppkey), 'target', s_name, 3000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT concat('module:', p_partkey), 'module', p_name, 4000000000000 + p_partkey FROM part
)"""


def bm25_sql(source: str, key: str, text: str, query: list[str], require_all: bool, words: str = WORDS, stem: bool = False) -> str:
    """CTEs ending in ``scored(<key>, score)`` for a source relation."""
    tests = " UNION ALL ".join(f"SELECT {i} AS slot, '{w}' AS prefix" for i, w in enumerate(query))
    having = f"HAVING count(*) = {len(query)}" if require_all else ""
    return f"""
toks AS (SELECT {key}, {words.format(text)} AS tokens FROM {source}),
corpus AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS mean FROM toks),
terms AS (SELECT {key}, len(tokens) AS dl, unnest(tokens) AS w FROM toks){', ' + stem_sql('terms', key + ', dl') if stem else ''},
hits AS (SELECT {key}, dl, slot, count(*) AS tf FROM {'stems' if stem else 'terms'} JOIN ({tests}) q ON starts_with(w, q.prefix) GROUP BY ALL),
spread AS (SELECT slot, count(*) AS m FROM hits GROUP BY 1),
idf AS (SELECT slot, CASE WHEN ln((n - m + 0.5) / (m + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - m + 0.5) / (m + 0.5)) END AS idf FROM spread, corpus),
scored AS (SELECT {key}, -sum(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM hits JOIN idf USING (slot), corpus GROUP BY {key} {having})"""


def stem_sql(source: str, keys: str) -> str:
    d = Dialect("regexp_matches({0}, '{1}')", "suffix({0}, '{1}')", "strlen({0})")
    steps, prev = [], f"(SELECT DISTINCT w AS w0, w FROM {source})"
    for i, step in enumerate(stem_steps(d, "w")):
        steps.append(f"stem{i} AS (SELECT w0, {step} AS w FROM {prev})")
        prev = f"stem{i}"
    steps.append(
        f"stems AS (SELECT {keys}, CASE WHEN strlen(w0) BETWEEN 3 AND 64 THEN v.w ELSE w0 END AS w FROM {source} s JOIN {prev} v ON v.w0 = s.w)"
    )
    return ", ".join(steps)


def _symbols(spark, folder):
    return search.tokenised(t.symbol_rows(spark, folder), "label")


def _symbol_search(spark, folder, query, kinds=None):
    rows = _symbols(spark, folder)
    scored = search.scan_scores(rows, "id", query, require_all=True)
    found = scored.join(rows.drop("tokens", "dl"), "id")
    if kinds:
        found = found.filter(F.col("kind").isin(*kinds))
    score = F.round("score", 6)
    return found.select("id", "kind", "label", score.alias("score"), "rowid").orderBy("score", "rowid").limit(200).drop("rowid")


def symbol_prefix_and_search(spark, folder):
    return _symbol_search(spark, folder, "re wid")


def symbol_search_kind_filter(spark, folder):
    return _symbol_search(spark, folder, "Customer 0000", ["script", "module"])


def _symbol_sql(query, kinds=None):
    where = f"WHERE kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    return f"""WITH {SYMBOLS_SQL}, {bm25_sql('syms', 'id', 'label', query, True)}
SELECT id, kind, label, round(score, 6) AS score FROM scored JOIN syms USING (id) {where} ORDER BY round(score, 6), rowid LIMIT 200"""


def symbol_substring_fallback(spark, folder):
    rows = t.symbol_rows(spark, folder)
    return rows.filter(F.contains(F.lower("label"), F.lit("idge")) | F.contains(F.lower("id"), F.lit("77"))).select("id", "label")


def symbol_postings(spark, folder):
    return search.postings(_symbols(spark, folder), "id").select("term", "id", "tf", F.col("dl").cast("long").alias("dl"))


def symbol_doc_freq(spark, folder):
    return search.document_frequency(search.postings(_symbols(spark, folder), "id"))


POSTINGS_SQL = f"""WITH {SYMBOLS_SQL}, toks AS (SELECT id, {WORDS.format('label')} AS tokens FROM syms)
SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY term, id"""

DOC_QUERY = "the tion eaux under"


def _docs(spark, folder):
    return search.tokenised(t.doc_rows(spark, folder).select("doc_id", "path", "text"), "text").drop("text")


def doc_bm25_scores(spark, folder):
    scored = search.scan_scores(_docs(spark, folder), "doc_id", DOC_QUERY, require_all=False)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


def doc_bm25_topk(spark, folder):
    scored = search.scan_scores(_docs(spark, folder), "doc_id", "schen lich thea eaux", require_all=False)
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(10)


def doc_bm25_porter(spark, folder):
    """Stemmed search straight over all documents."""
    scored = search.stem_scan_scores(_docs(spark, folder), "doc_id", PORTER_QUERY, require_all=False)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


PORTER_QUERY = "thes tioned eauxes"


def _index_place(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"


def index_roundtrip(spark, folder):
    """A stemmed index of all documents, stored, opened again and searched."""
    place = _index_place(spark)
    text_index.append(spark, place, _docs(spark, folder), "doc_id", stem=True)
    scored = text_index.TextIndex.open(spark, place).search([PORTER_QUERY], require_all=False)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


def _appended(spark, folder):
    """All documents in five parts, one after the other; the fourth merges the first four segments."""
    place, docs = _index_place(spark), _docs(spark, folder)
    for part in range(5):
        index = text_index.append(spark, place, docs.where(F.pmod("doc_id", F.lit(5)) == part), "doc_id")
    return index


def index_append(spark, folder):
    """Every word of the query, over an index that grew part by part."""
    scored = _appended(spark, folder).search([APPEND_QUERY], require_all=True)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


APPEND_QUERY = "the on an"


def index_top(spark, folder):
    """The ten best documents by the bounds of the blocks."""
    return _appended(spark, folder).top("schen lich thea eaux", 10).select("doc_id", F.round("score", 6).alias("score"))


def doc_stems(spark, folder):
    """Every distinct word of the documents with its stem."""
    from wayweft.functions.porter import stem_column

    vocabulary = _docs(spark, folder).select(F.explode_outer("tokens").alias("word")).filter("word IS NOT NULL").distinct()
    vocabulary = vocabulary.repartition(shuffle_width(spark))
    return stem_column(vocabulary.withColumn("stem", F.col("word")), "stem").select("word", "stem")


def doc_search_glob(spark, folder):
    rows = _docs(spark, folder)
    scored = search.scan_scores(rows, "doc_id", "the tion", require_all=False)
    paths = rows.select("doc_id", "path").filter(glob_match(F.col("path"), "src1[0-3]/*/*[02468].md"))
    return scored.join(paths, "doc_id").select("doc_id", "path", F.round("score", 6).alias("score"))


def doc_snippet(spark, folder):
    """Ten best documents with a marked extract."""
    from wayweft.functions.helpers import snippet

    docs = t.doc_rows(spark, folder)
    top = doc_bm25_topk(spark, folder)
    words = ["schen", "lich", "thea", "eaux"]
    texts = docs.select("doc_id", "text").join(F.broadcast(top), "doc_id")
    return texts.select("doc_id", "score", snippet("text", F.array(*[F.lit(w) for w in words])).alias("snippet"))


SCORES_SQL = "WITH {0} SELECT doc_id, round(score, 6) AS score FROM scored"
DOC_WORDS = DOC_QUERY.split()

GLOB_SQL = f"""WITH {bm25_sql('documents', 'doc_id', 'text', ['the', 'tion'], False)}
SELECT doc_id, concat(source, '/', lang, '/', doc_id, '.md') AS path, round(score, 6) AS score
FROM scored JOIN documents USING (doc_id) WHERE path GLOB 'src1[0-3]/*/*[02468].md'"""


def doc_sections(spark, folder):
    out = sections.split_sections(t.headed_docs(spark, folder))
    return out.select("doc_id", "start_line", "section", F.md5("body").alias("body_md5"), F.length("body").alias("body_len"))


SECTIONS_SQL = rf"""WITH marked AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE
    WHEN (i - 1) % 7 = 0 THEN concat('## ', x) WHEN (i - 1) % 11 = 3 THEN concat(x, chr(10), '=====')
    WHEN (i - 1) % 13 = 5 THEN concat(x, chr(10), '---', chr(10), '---') ELSE x END), chr(10)) AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n$', ''), chr(10)) AS l FROM marked)),
tagged AS (
  SELECT *, regexp_matches(line, '^#{{1,6}}{SPACES}+.+?{SPACES}*#*{SPACES}*$') AS atx,
    coalesce(regexp_matches(lead(line) OVER w, '^[=\-~^"''`*+]{{3,}}{SPACES}*$'), false) AS under_next,
    trim(line, {TRIM_SET}) <> '' AS filled FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cands AS (
  SELECT *, NOT atx AND filled AND under_next AS cand FROM tagged),
runs AS (
  SELECT *, i - coalesce(max(CASE WHEN NOT cand THEN i END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS off FROM cands),
heads AS (SELECT *, cand AND off % 2 = 1 AS setext FROM runs),
flagged AS (
  SELECT *, atx OR setext AS head, coalesce(lag(setext) OVER (PARTITION BY doc_id ORDER BY i), false) AS used FROM heads),
grouped AS (
  SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM flagged),
secs AS (
  SELECT doc_id, sec, max(CASE WHEN head THEN CASE WHEN atx THEN trim(regexp_extract(line, '^#{{1,6}}{SPACES}+(.+?){SPACES}*#*{SPACES}*$', 1), {TRIM_SET}) ELSE trim(line, {TRIM_SET}) END ELSE '' END) AS section,
    CAST(coalesce(max(CASE WHEN head THEN i END), 1) AS INTEGER) AS start_line,
    trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head AND NOT used), ''), {TRIM_SET}) AS body,
    count(*) FILTER (NOT head AND NOT used) AS n FROM grouped GROUP BY doc_id, sec)
SELECT doc_id, start_line, section, md5(body) AS body_md5, CAST(length(body) AS INTEGER) AS body_len FROM secs
WHERE (n > 0 OR sec = 0) AND (section <> '' OR body <> '')"""


def link_extract(spark, folder):
    """Local links of all pages: fragment-only and external ones are left out, fragments cut."""
    rows = t.page_links(spark, folder)
    return rows.filter(scan.is_local_link(F.col("target"))).select(
        "link_id", "source_file", F.substring_index("target", "#", 1).alias("target")
    ).filter("target <> ''")


PAGE_LINKS_SQL = r"""
plinks AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1) AS source_file, unnest(h) AS href, unnest(range(len(h))) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
links AS (
  SELECT concat(page_id, '#', pos) AS link_id, source_file, href, CASE length(href) % 4 WHEN 0 THEN href
    WHEN 1 THEN concat('../', href[2:], '#top') WHEN 2 THEN concat('./../../x/../', href[2:])
    ELSE CASE WHEN length(href) % 3 = 0 THEN concat('#', href[2:]) ELSE concat('//', href[2:]) END END AS target FROM plinks)"""

LINK_EXTRACT_SQL = f"""WITH {PAGE_LINKS_SQL}
SELECT link_id, source_file, split_part(target, '#', 1) AS target FROM links
WHERE NOT regexp_matches(lower(target), '^(https?://|mailto:|ftp://|//|#)') AND split_part(target, '#', 1) <> ''"""


def link_resolve(spark, folder):
    out = links.resolve_links(t.page_links(spark, folder).select("link_id", "source_file", "target"), t.known_paths(spark, folder))
    return out.select("link_id", "resolved", "canonical", "reason", F.array_join("candidates", "|").alias("candidates"))


LINK_RESOLVE_SQL = rf"""WITH {PAGE_LINKS_SQL}, known AS (
  SELECT DISTINCT CASE WHEN length(w) % 3 = 0 THEN concat(w, '/index.md') WHEN length(w) % 3 = 1 THEN concat(w, '.md') WHEN length(w) % 5 = 0 THEN w END AS path
  FROM (SELECT href[2:] AS w FROM plinks) UNION SELECT source_file FROM plinks
  UNION SELECT regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1) FROM pages),
bare AS (SELECT *, trim(split_part(target, '#', 1)) AS raw, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM links),
parts AS (
  SELECT link_id, raw, list_filter(string_split(CASE WHEN raw LIKE '/%' THEN raw ELSE concat(dir, '/', raw) END, '/'), lambda p: p NOT IN ('', '.')) AS p FROM bare),
folded AS (
  SELECT link_id, raw, array_to_string(list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[])), '/') AS path FROM parts),
cands AS (
  SELECT link_id, CASE WHEN raw = '' THEN [] WHEN contains(split_part(path, '/', -1), '.') THEN [path]
    ELSE [path, concat(path, '.md'), concat(path, '.mdx'), concat(path, '.rst'), concat(path, '/index.md')] END AS c FROM folded),
hit AS (
  SELECT link_id, c, list_filter(c, lambda x: x IN (SELECT path FROM known WHERE path IS NOT NULL))[1] AS canonical FROM cands)
SELECT link_id, canonical IS NOT NULL AS resolved, canonical, CASE WHEN len(c) = 0 THEN 'empty target' WHEN canonical IS NULL THEN 'no path matched' END AS reason,
  array_to_string(c, '|') AS candidates FROM hit"""
LINK_RESOLVE_SQL = LINK_RESOLVE_SQL.replace(
    """hit AS (
  SELECT link_id, c, list_filter(c, lambda x: x IN (SELECT path FROM known WHERE path IS NOT NULL))[1] AS canonical FROM cands)""",
    """tries AS (SELECT link_id, unnest(c) AS x, unnest(range(len(c))) AS n FROM cands),
found AS (SELECT link_id, arg_min(x, n) AS canonical FROM tries SEMI JOIN known ON known.path = tries.x GROUP BY 1),
hit AS (SELECT link_id, c, canonical FROM cands LEFT JOIN found USING (link_id))""",
)


def scan_prune_paths(spark, folder):
    """Paths of all pages and documents that survive the scan's pruning rules."""
    return _scan_paths(spark, folder).filter(~scan.is_pruned(F.col("path"))).select("path")


def _scan_paths(spark, folder):
    word = F.lower(F.regexp_extract("html", "<a href=\"/([A-Za-z]+)", 1))
    spelled = (
        F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("build/"), "path"))
        .when(F.col("page_id") % 7 == 1, F.concat(F.lit("."), word, F.lit("/"), "path"))
        .when(F.col("page_id") % 7 == 2, F.concat(F.lit(".github/"), "path"))
        .when(F.col("page_id") % 7 == 3, F.concat("path", F.lit("/.hidden")))
        .otherwise(F.col("path"))
    )
    pages = t.page_paths(spark, folder).select(spelled.alias("path"))
    return pages.unionByName(t.doc_rows(spark, folder).select("path"))


SCAN_PATHS_SQL = r"""
paths AS (
  SELECT CASE page_id % 7 WHEN 0 THEN concat('build/', p) WHEN 1 THEN concat('.', w, '/', p) WHEN 2 THEN concat('.github/', p)
    WHEN 3 THEN concat(p, '/.hidden') ELSE p END AS path FROM (
    SELECT page_id, regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1) AS p, lower(regexp_extract(html, '<a href="/([A-Za-z]+)', 1)) AS w FROM pages)
  UNION ALL SELECT concat(source, '/', lang, '/', doc_id, '.md') FROM documents)"""

PRUNE_SQL = f"""WITH {SCAN_PATHS_SQL}
SELECT path FROM paths WHERE len(list_filter(string_split(path, '/'), lambda p: p IN ({', '.join(repr(d) for d in scan.IGNORED)})
  OR (p LIKE '.%' AND p <> '.github'))) = 0"""


def scan_limit_warning(spark, folder):
    """Sizes against the read cap and the number of files against the scan limit, as warning rows."""
    files = t.doc_rows(spark, folder).select("path", F.octet_length("text").cast("long").alias("size"))
    return scan.limit_warnings(files, max_files=150, max_bytes=4_000).select("path", "message")


LIMIT_SQL = """
WITH f AS (SELECT concat(source, '/', lang, '/', doc_id, '.md') AS path, strlen(text) AS size FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) AS k FROM f)
SELECT path, concat('read error ', path, ': file too large') AS message FROM n WHERE k <= 150 AND size > 4000
UNION ALL SELECT '' AS path, 'scan limit reached at 150 files' FROM n WHERE k = 151"""


def scan_format_dispatch(spark, folder):
    """Which parsers take a file, over all page paths and documents under many names."""
    names = F.array(*[F.lit(n) for n in scan.SAMPLE_NAMES])
    rows = _scan_paths(spark, folder).select(F.posexplode(names).alias("n", "name"), "path")
    named = rows.select(F.concat_ws("/", "path", "name").alias("path"))
    return named.select("path", F.explode_outer(scan.parsers_for(F.col("path"))).alias("parser")).filter("parser IS NOT NULL")


DISPATCH_SQL = f"""WITH {SCAN_PATHS_SQL},
named AS (SELECT concat(path, '/', n) AS path, lower(n) AS name, lower(regexp_extract(n, '^.+(\\.[^.]+)$', 1)) AS ext
  FROM paths, (SELECT unnest([{', '.join(repr(n) for n in scan.SAMPLE_NAMES)}]) AS n)),
tagged AS (SELECT path, unnest([
  CASE WHEN ext IN ('.py', '.js', '.jsx', '.ts', '.tsx', '.go', '.rs', '.java', '.c', '.cc', '.cpp', '.cxx', '.h', '.hpp') THEN 'code' END,
  CASE WHEN ext IN ('.sh', '.bash', '.zsh') THEN 'shell' END,
  CASE WHEN ext IN ('.md', '.markdown') THEN 'markdown' END,
  CASE WHEN name IN ('makefile', 'gnumakefile') THEN 'makefile' END,
  CASE WHEN path LIKE '.github/workflows/%' AND ext IN ('.yml', '.yaml') THEN 'github_actions' END,
  CASE WHEN name = '.gitlab-ci.yml' THEN 'gitlab_ci' END,
  CASE WHEN name = 'jenkinsfile' THEN 'jenkins' END,
  CASE WHEN name = 'cmakelists.txt' THEN 'cmake' END,
  CASE WHEN name IN ('build', 'build.bazel') THEN 'bazel' END,
  CASE WHEN name = 'dockerfile' THEN 'dockerfile' END,
  CASE WHEN name IN ('docker-compose.yml', 'docker-compose.yaml', 'compose.yml', 'compose.yaml') THEN 'compose' END]) AS parser FROM named)
SELECT path, parser FROM tagged WHERE parser IS NOT NULL"""


QUERIES = {
    "symbol_prefix_and_search": (symbol_prefix_and_search, _symbol_sql(["re", "wid"])),
    "symbol_search_kind_filter": (symbol_search_kind_filter, _symbol_sql(["customer", "0000"], ["script", "module"])),
    "symbol_substring_fallback": (
        symbol_substring_fallback,
        f"WITH {SYMBOLS_SQL} SELECT id, label FROM syms WHERE contains(lower(label), 'idge') OR contains(lower(id), '77')",
    ),
    "symbol_postings": (symbol_postings, POSTINGS_SQL),
    "symbol_doc_freq": (
        symbol_doc_freq,
        f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ({POSTINGS_SQL}) GROUP BY 1",
    ),
    "doc_bm25_scores": (doc_bm25_scores, SCORES_SQL.format(bm25_sql("documents", "doc_id", "text", DOC_WORDS, False))),
    "doc_bm25_topk": (
        doc_bm25_topk,
        SCORES_SQL.format(bm25_sql("documents", "doc_id", "text", ["schen", "lich", "thea", "eaux"], False))
        + " ORDER BY round(score, 6), doc_id LIMIT 10",
    ),
    "doc_bm25_porter": (
        doc_bm25_porter,
        SCORES_SQL.format(bm25_sql("documents", "doc_id", "text", ["the", "tion", "eaux"], False, stem=True)),
    ),
    "index_roundtrip": (
        index_roundtrip,
        SCORES_SQL.format(bm25_sql("documents", "doc_id", "text", ["the", "tion", "eaux"], False, stem=True)),
    ),
    "index_append": (index_append, SCORES_SQL.format(bm25_sql("documents", "doc_id", "text", APPEND_QUERY.split(), True))),
    "index_top": (
        index_top,
        SCORES_SQL.format(bm25_sql("documents", "doc_id", "text", ["schen", "lich", "thea", "eaux"], False))
        + " ORDER BY round(score, 6), doc_id LIMIT 10",
    ),
    "doc_stems": (
        doc_stems,
        f"WITH toks AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS w FROM documents), {stem_sql('toks', 's.w AS word')} SELECT word, w AS stem FROM stems",
    ),
    "doc_search_glob": (doc_search_glob, GLOB_SQL),
    "doc_snippet": (doc_snippet, None),
    "doc_sections": (doc_sections, SECTIONS_SQL),
    "link_extract": (link_extract, LINK_EXTRACT_SQL),
    "link_resolve": (link_resolve, LINK_RESOLVE_SQL),
    "scan_prune_paths": (scan_prune_paths, PRUNE_SQL),
    "scan_limit_warning": (scan_limit_warning, LIMIT_SQL),
    "scan_format_dispatch": (scan_format_dispatch, DISPATCH_SQL),
}
