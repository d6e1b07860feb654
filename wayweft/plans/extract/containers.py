"""Facts of image definitions and compose files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.functions.strings import basename, strip
from wayweft.model import node_id
from wayweft.plans.extract.ci import as_text, field, is_empty, is_list, is_object, items, members, with_yaml, yaml_warnings
from wayweft.plans.extract.facts import emit, fact, one, union, warning


def dockerfile(files: DataFrame, turn: int) -> DataFrame:
    """Base images, stage names, stage references and copied paths, one instruction per logical line."""
    file_id = node_id("file", "path")
    no_notes = F.regexp_replace("text", r"(?m)^[ \t]*+#[^\n]*+\n?", "")
    joined = F.regexp_replace(no_notes, r"\\[ \t]*\r?\n[ \t]*", " ")
    lines = files.select("path", F.posexplode_outer(F.split(joined, r"\r?\n", -1)).alias("_l", "_line")).filter("_l IS NOT NULL")
    parts = lines.select("path", "_l", F.filter(F.split(strip(F.col("_line")), r"\s+"), lambda w: w != "").alias("w"))
    verb = F.upper(F.get("w", 0))
    flags = F.filter("w", lambda x: x.startswith("--"))
    rest = F.filter(F.expr("slice(w, 2, size(w))"), lambda x: ~x.startswith("--"))
    rows = parts.filter(F.size("w") > 1).select("path", "_l", verb.alias("verb"), flags.alias("flags"), rest.alias("args"))

    def image(at, label, ekind=None):
        return fact(at, node_id("container_image", label), "container_image", label, None, None, file_id if ekind else None, ekind)

    base = F.get("args", 0)
    alias = F.when(F.upper(F.get("args", 1)) == "AS", F.get("args", 2))
    from_rows = emit(
        rows.filter((F.col("verb") == "FROM") & (F.size("args") > 0)),
        F.array_compact(
            F.array(
                image([turn, 1, F.col("_l"), 0], base, "builds_from"),
                F.when(alias.isNotNull(), image([turn, 1, F.col("_l"), 1], alias)),
            )
        ),
    )
    copies = rows.filter(F.col("verb").isin("COPY", "ADD"))
    stage = F.regexp_extract(F.get(F.filter("flags", lambda x: x.startswith("--from=")), 0), r"^--from=(.*)$", 1)
    json_form = F.get("args", 0).startswith("[")
    sources = F.when(json_form, F.array().cast("array<string>")).when(
        F.size("args") >= 2, F.expr("slice(args, 1, size(args) - 1)")
    ).otherwise(F.col("args"))
    staged = copies.withColumn("stage", F.coalesce(stage, F.lit("")))
    stage_rows = one(staged.filter("stage <> ''"), image([turn, 1, F.col("_l"), 0], F.col("stage"), "depends_on"))
    copy_rows = emit(
        staged.filter("stage = ''"),
        F.transform(
            sources,
            lambda s, i: fact([turn, 1, F.col("_l"), i], node_id("artifact", s), "artifact", s, None, None, file_id, "consumes"),
        ),
    )
    own = one(files, fact([turn, 0], file_id, "file", basename(F.col("path")), F.col("path")))
    return union(own, from_rows, stage_rows, copy_rows)


def compose(files: DataFrame, turn: int) -> DataFrame:
    loaded = with_yaml(files)
    docs = loaded.filter(F.col("json").isNotNull()).select("path", field(F.col("json"), "services").alias("services"))
    bad = docs.filter(~is_empty(F.col("services")) & ~is_object(F.col("services")))
    message = F.concat(F.lit("parse error "), "path", F.lit(": compose: `services` must be a mapping"))
    services = docs.filter(is_object(F.col("services"))).select(
        "path", F.posexplode_outer(members(F.col("services"))).alias("_s", "_e")
    ).filter("_s IS NOT NULL").select("path", "_s", F.col("_e.key").alias("name"), F.col("_e.value").alias("spec"))
    own_id = node_id("service", F.col("name"))
    spec = F.col("spec")
    needs = field(spec, "depends_on")
    none = F.array().cast("array<string>")
    names = F.when(is_object(needs), F.transform(members(needs), lambda e: e["key"])).when(is_list(needs), F.transform(items(needs), as_text)).otherwise(none)
    deps = F.transform(
        names,
        lambda d, i: fact([turn, F.col("_s"), 1, i], node_id("service", d), "service", d, F.col("path"), None, own_id, "depends_on"),
    )
    raw = field(spec, "image")
    image = as_text(raw)
    runs_in = F.when(
        ~is_empty(raw),
        fact([turn, F.col("_s"), 2, 0], node_id("container_image", image), "container_image", image, None, None, own_id, "runs_in"),
    )
    own = fact([turn, F.col("_s"), 0, 0], own_id, "service", F.col("name"), F.col("path"))
    return union(
        yaml_warnings(loaded, turn, "compose"),
        one(bad, warning([turn], message)),
        emit(services, F.array_compact(F.concat(F.array(own), deps, F.array(runs_in)))),
    )
