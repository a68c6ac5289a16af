"""Recipe, chemical and paper notes as text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.functions.text import file_name
from paperloom.functions.urls import link

FENCE = "paperloom-recipe-json"
#: How a status is shown.
STATUS = {"PASSED": "✅ PASSED", "CORRECTED": "⚠️ CORRECTED", "FAILED": "❌ FAILED", "PENDING": "⏳ PENDING"}


def amount(q: Column) -> Column:
    return F.coalesce(F.concat_ws(" ", q["value"].cast("string"), q["unit"]), F.lit("-"))


def shown(value: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(value.cast("string"), F.lit(suffix)), F.lit("unknown"))


def field(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or a field of a column, that the rows may lack."""
    schema = rows.schema
    for part in name.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return F.lit(None).cast(kind)
        schema = schema[part].dataType
    return F.col(name)


def warning_lines(warnings: Column) -> Column:
    """A line for each finding (error_type, field_path, message)."""
    one = lambda w: F.concat(F.lit("- **"), F.coalesce(w["error_type"], F.lit("WARNING")), F.lit("** (`"), F.coalesce(w["field_path"], F.lit("unknown field")), F.lit("`): "), F.trim(F.regexp_replace(F.coalesce(w["message"], F.lit("")), r"\s+", " ")))
    return lines_or(F.transform(warnings, one), "No validation warnings.")


def lines_or(lines: Column, nothing: str) -> Column:
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(nothing)


def method_lines(methods: Column) -> Column:
    """A line for each step and how it was done, by step."""
    steps = F.array_sort(F.map_entries(methods))
    return lines_or(F.transform(steps, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "No extraction method metadata.")


def recipe_notes(rows: DataFrame) -> DataFrame:
    """(note_type, file_name, content) of recipe rows (recipe_id, validation_status, entities, conditions).

    Rows may have title, source_paper_title, source_paper_doi, source_paper_url, source_text_completeness,
    source_acquisition_method, validation_warnings and node_extraction_methods, too.
    """
    get = lambda name, kind="string": field(rows, name, kind)
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    said = lambda c, otherwise: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(otherwise))
    shown_amount = lambda q: F.when(q.isNull(), "-").otherwise(amount(q))
    cell = lambda e: F.concat(F.lit("| [["), e["name"], F.lit("]] | "), shown_amount(e["quantity"]), F.lit(" | "), shown_amount(e["moles"]), F.lit(" | "), e["role"], F.lit(" |"))
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    number, warnings = F.col("recipe_id").cast("string"), get("validation_warnings", "array<struct<error_type:string,field_path:string,message:string>>")
    technique, atmosphere = get("conditions.technique"), get("conditions.atmosphere")
    paper = said(get("source_paper_title"), "Unknown source")
    tag = lambda c: F.concat(F.lit("#"), F.replace(said(c, "unknown"), F.lit(" "), F.lit("_")))
    kept = [c for c in ("recipe_id", "validation_status", "entities", "conditions", "validation_warnings", "node_extraction_methods") if c in rows.columns]
    parts = [
        F.lit("---"), F.concat(F.lit("recipe_id: "), number), F.concat(F.lit("validation_status: "), "validation_status"), F.concat(F.lit("warning_count: "), F.greatest(F.coalesce(F.size(warnings), F.lit(0)), F.lit(0)).cast("string")), F.lit("---"), F.lit(""),
        F.concat(F.lit("# "), F.coalesce(F.nullif(get("title"), F.lit("")), F.concat(F.lit("Reaction "), number))), F.lit(""),
        F.concat(F.lit("**Status:** "), F.coalesce(F.try_element_at(status, F.col("validation_status")), F.col("validation_status"))), F.concat(F.lit("**Source:** [["), F.substring(paper, 1, 60), F.lit("]]")), F.lit(""),
        F.lit("## Reactants"), F.lit("| Chemical | Quantity | Moles | Role |"), F.lit("|---|---|---|---|"), F.array_join(F.transform("entities", cell), "\n"), F.lit(""),
        F.lit("## Reaction Conditions"), F.lit("| Parameter | Value |"), F.lit("|---|---|"), row("Temperature", shown(get("conditions.temperature_celsius", "double"), "°C")), row("Duration", shown(get("conditions.duration_hours", "double"), " hours")),
        row("Technique", said(technique, "unknown")), row("Atmosphere", said(atmosphere, "unknown")), row("Pressure", shown(get("conditions.pressure_atm", "double"), " atm")), F.lit(""),
        F.lit("## Source Text"), F.concat(F.lit("Paper: "), paper), F.concat(F.lit("DOI: "), said(get("source_paper_doi"), "unknown")), F.concat(F.lit("URL: "), link(get("source_paper_url"))), F.lit(""),
        F.lit("## Validation Warnings"), warning_lines(warnings), F.lit(""),
        F.lit("## Extraction Provenance"), F.concat(F.lit("**Source text completeness:** "), said(get("source_text_completeness"), "unknown")), F.concat(F.lit("**Source acquisition method:** "), said(get("source_acquisition_method"), "unknown")), F.lit(""),
        F.lit("### Node Extraction Methods"), method_lines(get("node_extraction_methods", "map<string,string>")), F.lit(""),
        F.lit(f"```{FENCE}"), F.to_json(F.struct(*kept)), F.lit("```"), F.lit(""), F.lit("## Tags"), F.concat_ws(" ", F.lit("#reaction"), tag(technique), tag(atmosphere)), F.lit(""),
    ]
    return rows.select(F.lit("recipe").alias("note_type"), F.concat(file_name(F.concat(F.lit("rxn_"), number)), F.lit(".md")).alias("file_name"), F.concat_ws("\n", *parts).alias("content"))


def chemical_notes(entities: DataFrame) -> DataFrame:
    """One note per chemical with its reactions, each once."""
    line = F.concat(F.lit("- [["), F.col("recipe_id").cast("string"), F.lit("]] as "), "role")
    lines = entities.groupBy(F.trim("name").alias("name")).agg(F.array_sort(F.collect_set(line)).alias("lines"))
    content = F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.lit(""), F.lit("## Appears In Reactions"), F.array_join("lines", "\n"))
    return lines.select(F.lit("chemical").alias("note_type"), F.concat(file_name(F.col("name")), F.lit(".md")).alias("file_name"), content.alias("content"))


def reverse_links(entities: DataFrame) -> DataFrame:
    """(name, recipe_id, role), each once."""
    return entities.select(F.trim("name").alias("name"), "recipe_id", "role").distinct()


def paper_notes(papers: DataFrame) -> DataFrame:
    """A note per paper; what isn't known says so."""
    said = lambda label, c: F.concat(F.lit(f"**{label}:** "), F.coalesce(c.cast("string"), F.lit("unknown")))
    url = link(F.col("open_access_url")) if "open_access_url" in papers.columns else link(F.lit(None).cast("string"))
    content = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), said("DOI", F.col("doi")), said("Year", F.col("year")), said("Source DB", F.col("source_db")), F.concat(F.lit("**URL:** "), url))
    return papers.select(F.lit("paper").alias("note_type"), F.concat(file_name(F.substring("title", 1, 60)), F.lit(".md")).alias("file_name"), content.alias("content"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def first_number(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


#: What a note's payload holds.
AMOUNT = "struct<value:double,unit:string>"
PAYLOAD = (
    f"recipe_id string, validation_status string, entities array<struct<name:string,formula:string,role:string,quantity:{AMOUNT},moles:{AMOUNT},notes:string>>, "
    "conditions struct<temperature_celsius:double,duration_hours:double,pressure_atm:double,technique:string,atmosphere:string>, "
    "validation_warnings array<struct<error_type:string,field_path:string,message:string>>, node_extraction_methods map<string,string>"
)


def read_amount(cell: Column) -> Column:
    """A number that isn't negative and a unit behind it; else nothing."""
    part = lambda k: F.regexp_extract(F.coalesce(cell, F.lit("")), r"(?s)^(\d+(?:\.\d+)?)\s+(.+)", k)
    return F.when(part(2) != "", F.struct(part(1).cast("double").alias("value"), part(2).alias("unit")))


def parsed_notes(notes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """recipe_id, status, entities with their amounts, conditions, warnings and methods of each note, and whether it could be read; then the columns to keep.

    The embedded payload counts; without a good one, front matter and tables do.
    """
    body = F.regexp_extract("content", rf"(?s)```{FENCE}\s*\n(.*?)\n```", 1)
    data = F.from_json(F.nullif(body, F.lit("")), PAYLOAD)
    lines = F.col("lines")  # a column, so that a note is split once
    row = lambda name: F.get(F.filter(lines, lambda x: x.startswith(f"| {name} |")), 0)
    head = lambda k: F.nullif(F.regexp_extract("content", rf"(?s)^---.*?\n{k}: ([^\n]*)\n.*?---", 1), F.lit(""))
    value = lambda name: F.trim(F.get(F.split(row(name), r"\|"), 2))
    told = lambda name: F.when(~F.lower(value(name)).isin("", "unknown", "-"), value(name))
    cells = F.transform(F.filter(lines, lambda x: x.startswith("| [[")), lambda x: F.split(x, r"\s*\|\s*"))
    table = F.transform(cells, lambda c: F.struct(
        F.regexp_replace(F.get(c, 1), r"^\[\[|\]\]$", "").alias("name"), F.lit(None).cast("string").alias("formula"), F.get(c, 4).alias("role"), read_amount(F.get(c, 2)).alias("quantity"), read_amount(F.get(c, 3)).alias("moles"), F.lit(None).cast("string").alias("notes")))
    found = F.transform(F.filter(lines, lambda x: x.rlike(r"^- \*\*[^*]+\*\* \(`")), lambda x: F.struct(*[F.regexp_extract(x, r"^- \*\*([^*]+)\*\* \(`([^`]*)`\): (.*)$", k + 1).alias(n) for k, n in enumerate(("error_type", "field_path", "message"))]))
    rows = notes.withColumns({"data": data, "lines": F.split("content", "\n")})
    good = F.col("data.recipe_id").isNotNull()
    either = lambda name, otherwise: F.when(good, F.col(f"data.{name}")).otherwise(otherwise)
    out = rows.select(
        F.coalesce("data.recipe_id", head("recipe_id")).alias("recipe_id"), F.coalesce("data.validation_status", head("validation_status"), F.lit("PASSED")).alias("validation_status"), either("entities", table).alias("entities"),
        *[either(f"conditions.{c}", first_number(row(n))).alias(c) for c, n in (("temperature_celsius", "Temperature"), ("duration_hours", "Duration"), ("pressure_atm", "Pressure"))],
        *[either(f"conditions.{c}", told(n)).alias(c) for c, n in (("technique", "Technique"), ("atmosphere", "Atmosphere"))],
        either("validation_warnings", found).alias("validation_warnings"), F.col("data.node_extraction_methods").alias("node_extraction_methods"), *keep,
    )
    return out.withColumn("ok", F.col("recipe_id").isNotNull())


def safe_ids(recipes: DataFrame) -> DataFrame:
    """Recipes whose id can be a file name as it is."""
    return recipes.where(file_name(F.col("recipe_id").cast("string")) == F.col("recipe_id").cast("string"))
