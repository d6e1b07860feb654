"""Localizer evidence: lenient JSON reading, shaping, out-of-request filter, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayweft.functions.strings import strip

SITE = "symbol:string,file:string,line:int"
EVIDENCE_TYPE = (
    f"struct<verified_callsites:array<struct<{SITE},snippet:string>>,"
    f"verified_tests:array<struct<{SITE}>>,verified_configs:array<struct<{SITE}>>,"
    "verified_docs:array<struct<source:string,target_path:string,target_section:string,line:int,"
    "kind:string,snippet:string>>,"
    "symbol_summary:array<struct<symbol:string,total_refs:int,out_of_pr_files:int>>,notes:string>"
)
# How many entries of each kind the markdown shows.
CAPS = {"symbol_summary": 20, "verified_callsites": 30, "verified_tests": 20, "verified_configs": 20, "verified_docs": 20}


def json_candidate(text: Column) -> Column:
    """The fenced JSON block of a text, or the text itself; null unless it is an object."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)\n```", 1)
    picked = strip(F.when(text.rlike(r"(?s)```(?:json)?\s*\n.*?\n```"), fenced).otherwise(text))
    return F.when(picked.startswith("{"), picked)


def parse_object(text: Column, fields: str) -> Column:
    """Fields of a lenient JSON object as a struct, null when it does not parse."""
    raw = json_candidate(text)
    return F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, fields))


def evidence_rows(replies: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, parse_ok, kind, pos, item``: one row per evidence entry, missing lists are empty."""
    shaped = replies.select(key, parse_object(F.col(text), EVIDENCE_TYPE).alias("ev"))
    return shaped.withColumn("parse_ok", F.col("ev").isNotNull())


def outside_request(rows: DataFrame, changed: DataFrame, path: str = "file") -> DataFrame:
    """Rows whose file is not among the changed files."""
    return rows.join(changed.select(F.col("filename").alias(path)).distinct(), path, "left_anti").select(*rows.columns)


def clip(text: Column, cap: int = 8192) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(cap)), F.lit("\n... [truncated]"))).otherwise(text)


def evidence_markdown(shaped: DataFrame, tools: str = "tools") -> DataFrame:
    """Add ``markdown`` to rows ``ev, parse_ok, tools`` (``tools``: array of tool names in call order)."""

    def bullets(field: str, title: str, line) -> Column:
        items = F.slice(F.col("ev")[field], 1, CAPS[field])
        text = F.array_join(F.transform(items, line), "\n")
        return F.coalesce(F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n{title}\n"), text)), F.lit(""))

    def site(s):
        return F.concat(F.lit("- `"), s["symbol"], F.lit("` at `"), s["file"], F.lit(":"), s["line"].cast("string"), F.lit("`"))

    def snippet(s):
        short = F.coalesce(s["snippet"], F.lit(""))
        return F.when(short != "", F.concat(F.lit(" — `"), F.left(short, F.lit(80)), F.lit("`"))).otherwise("")

    def doc(d):
        kind = F.when(d["kind"].isin("anchor", "term"), d["kind"]).otherwise("related")
        at = F.coalesce(F.concat(F.lit(":"), d["line"].cast("string")), F.lit(""))
        part = F.when(F.coalesce(d["target_section"], F.lit("")) != "", F.concat(F.lit(" § "), d["target_section"])).otherwise("")
        return F.concat(
            F.lit("- ["), kind, F.lit("] `"), F.coalesce(d["source"], F.lit("")), F.lit("` → `"),
            F.coalesce(d["target_path"], F.lit("")), at, F.lit("`"), part, snippet(d),
        )

    calls = F.size(tools)
    used = F.array_join(F.array_distinct(F.filter(tools, lambda t: t != "")), ", ")
    notes = strip(F.coalesce(F.col("ev.notes"), F.lit("")))
    text = F.concat(
        F.lit("**Localizer evidence** (tools used: "), F.when(used == "", "NONE").otherwise(used),
        F.lit("; tool calls: "), calls.cast("string"), F.lit(")"),
        F.when(~F.col("parse_ok"), "\n\n> WARNING: localizer output failed JSON validation — fields below may be empty.").otherwise(""),
        F.when(
            calls == 0,
            "\n\n> NOTE: localizer made ZERO tool calls. Cross-file claims below are NOT verified against the repo.",
        ).otherwise(""),
        bullets(
            "symbol_summary", "Per-symbol reference counts (repo-wide, from tools):",
            lambda s: F.concat(
                F.lit("- `"), s["symbol"], F.lit("`: total_refs="), s["total_refs"].cast("string"),
                F.lit(", out_of_pr_files="), s["out_of_pr_files"].cast("string"),
            ),
        ),
        bullets("verified_callsites", "Out-of-PR call-sites (verified):", lambda s: F.concat(site(s), snippet(s))),
        bullets("verified_tests", "Tests referencing changed symbols (verified):", site),
        bullets("verified_configs", "Configs referencing changed symbols (verified):", site),
        bullets("verified_docs", "Doc cross-references (verified):", doc),
        F.when(notes != "", F.concat(F.lit("\n\nNotes: "), F.left(notes, F.lit(500)))).otherwise(""),
    )
    return shaped.withColumn("markdown", text)

