"""Search, stemming, snippets and sections against SQLite and against a line-by-line reader."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from wayweft.functions.helpers import _extract
from wayweft.functions.porter import stem_column
from wayweft.functions.strings import glob_match
from wayweft.operators import search, sections

WORDS = "running runs ran nation national nationalism caresses ponies hopping hoped sky syzygy adoption relational Élan café o_x a.b 42".split()


def corpus(n=120, seed=7):
    rnd = random.Random(seed)
    return [
        (i, f"{rnd.choice(WORDS)} {rnd.choice(WORDS)}", ". ".join(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 30))) for _ in range(3)))
        for i in range(n)
    ]


def fts(rows, tokenizer):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, section, line UNINDEXED, body, tokenize='{tokenizer}')")
    con.executemany("INSERT INTO t(rowid, section, body) VALUES (?, ?, ?)", rows)
    return con


@pytest.mark.parametrize("stem", [False, True])
@pytest.mark.parametrize("query,both", [("nation run", False), ("run ca", True), ("hop hop sky", False), ("zzz", False)])
def test_scores_equal_sqlite(spark, stem, query, both):
    rows = corpus()
    con = fts(rows, "porter unicode61" if stem else "unicode61")
    terms = " ".join(f"{w}*" for w in query.split()) if both else " OR ".join(f"{w}*" for w in query.split())
    want = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (terms,)))
    tok = search.tokenised(spark.createDataFrame(rows, "id int, section string, body string"), "section", "body")
    post, stats = search.postings(tok, "id", stem=stem), search.CorpusStats.of(tok)
    got = {r.id: r.score for r in search.search_index(post, "id", [query], stats, both, stem).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if not stem:
        scan = {r.id: r.score for r in search.scan_scores(tok, "id", query, both).collect()}
        assert scan.keys() == want.keys() and all(abs(scan[k] - want[k]) < 1e-9 for k in want)


def test_stems_equal_sqlite(spark):
    rnd = random.Random(3)
    tails = ["", "s", "ies", "eed", "ed", "ing", "ational", "ization", "fulness", "icate", "ative", "ement", "ion", "ize", "e", "ll", "y"]
    pool = sorted({"".join(rnd.choice("aeiouybcdlstz") for _ in range(rnd.randint(1, 8))) + rnd.choice(tails) for _ in range(4000)} | {"x" * 70})
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(pool)))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    want = dict(con.execute("SELECT doc, term FROM v"))
    got = {r.i: r.w for r in stem_column(spark.createDataFrame(list(enumerate(pool)), "i int, w string"), "w").collect()}
    assert got == want


def test_snippets_equal_sqlite():
    rows = corpus(200, 11)
    con = fts(rows, "unicode61")
    for query in ("nation run", "sky", "cafe adoption hop", "42"):
        terms = query.split()
        found = con.execute(
            "SELECT rowid, body, snippet(t, 3, '<mark>', '</mark>', '...', 16) FROM t WHERE t MATCH ?", (" OR ".join(f"{w}*" for w in terms),)
        )
        for rowid, body, want in found:
            assert _extract(body, terms, None) == want, (rowid, query)


def read_sections(text):
    """Line-by-line reader, as plain as possible."""
    lines, out, title, start, body, i = text.splitlines(), [], "", 1, [], 0
    found = []
    while i < len(lines):
        atx = re.match(r"^(#{1,6})\s+(.+?)\s*#*\s*$", lines[i])
        under = i + 1 < len(lines) and lines[i].strip() and re.match(r"^[=\-~^\"'`*+]{3,}\s*$", lines[i + 1])
        if atx or under:
            found.append((title, start, body))
            title, start, body = (atx[2] if atx else lines[i]).strip(), i + 1, []
            i += 1 if atx else 2
        else:
            body.append(lines[i])
            i += 1
    found.append((title, start, body))
    for n, (title, start, body) in enumerate(found):
        text = "\n".join(body).strip()
        if (body or n == 0) and (text or title):
            out.append((title, start, text))
    return out


def test_sections_equal_a_plain_reader(spark):
    rnd = random.Random(5)
    parts = ["# a", "## b ##", "text", "===", "---", "```", "", "  ", "#no", "# ", "#  ", "####### seven", "x\ty", "+++ ", "\x0b", "é\u2028z", "\r\n", "***"]
    docs = [(i, rnd.choice(["\n", "\r\n", "\n"]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(3000)]
    rows = sections.split_sections(spark.createDataFrame(docs, "id int, text string")).orderBy("id", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.section, r.start_line, r.body))
    for i, text in docs:
        assert got.get(i, []) == read_sections(text), repr(text)


def test_glob(spark):
    paths = ["docs/a.md", "docs/a/b.md", "Docs/a.md", "docs/[x].md", "docs/b.md"]
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for glob in ("docs/*.md", "docs/?.md", "docs/[a-b].md", "docs/[^a].md", "*[[]x*", "docs/a.m[", "d*"):
        want = [p for p in paths if con.execute("SELECT ? GLOB ?", (p, glob)).fetchone()[0]]
        assert [r.p for r in df.filter(glob_match(F.col("p"), glob)).collect()] == want, glob


def test_marks_are_folded_as_in_the_index(spark):
    from wayweft.functions.tokens import words

    row = spark.createDataFrame([("\u1e3f\u1e03\u1ea1 \u01d6 caf\u00e9",)], "t string").select(words(F.col("t")).alias("w")).first()
    assert row.w == ["mba", "\u01d6", "cafe"]


def test_stems_are_made_of_distinct_words_only(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "the things tied, the Things untied"), (2, "other words")], "id long, text string")
    plans, store = [], search.materialise
    monkeypatch.setattr(search, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df))
    got = search.stem_scan_scores(search.tokenised(rows, "text"), "id", "thing tie", False)
    assert [r.id for r in got.collect()] == [1]
    # Below the grouping of the words no step of the stemmer is left.
    above, _, below = plans[0].partition("Aggregate [word")
    assert "octet_length(word" in above and below and "octet_length(word" not in below
