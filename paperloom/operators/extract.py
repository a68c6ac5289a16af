"""Deterministic extraction of entities, amounts and conditions from chunk text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import chem
from paperloom.functions.text import title_case

#: The default dictionary, in order; terms of the first part are written in title case.
SOLVENTS = ("methanol", "ethanol", "water", "acetone", "dmf", "dmso", "toluene", "hexane")
NAMED = (
    ("Zinc acetate dihydrate", "REACTANT"), ("Zinc acetate", "REACTANT"), ("KOH", "CATALYST"), ("potassium hydroxide", "CATALYST"), ("ZnO", "PRODUCT"), ("zinc oxide", "PRODUCT"),
)


def dictionary_entities(text: Column, solvents: Sequence[str] = SOLVENTS, named: Sequence[tuple[str, str]] = NAMED) -> Column:
    """array<struct<name, role>> of terms found as whole words in any case, in dictionary order, each lower-case name once."""
    parts = [F.when(text.rlike(rf"(?iU)\b{t}\b"), F.struct(title_case(F.lit(t)).alias("name"), F.lit("SOLVENT").alias("role"))) for t in solvents]
    for t, role in named:
        hit = F.regexp_extract(text, rf"(?iU)\b({t})\b", 1)
        parts.append(F.when(hit != "", F.struct(hit.alias("name"), F.lit(role).alias("role"))))
    found = F.array_compact(F.array(*parts))
    keys = F.transform(found, lambda e: F.lower(e["name"]))
    return F.filter(found, lambda e, i: F.array_position(keys, F.lower(e["name"])) == i + 1)


def term_matches(chunks: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, term) for a large dictionary of single words (column `term`): words of the text meet it by equality."""
    words = chunks.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\w+"), F.lit(0)))).alias("term"))
    return words.join(terms.select(F.lower("term").alias("term")).distinct(), "term").select(id_col, "term")


def extracted(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds entities with amounts and the conditions of each chunk."""
    text = F.col(text_col)
    rows = chunks.withColumn("entities", dictionary_entities(text))
    amounts = lambda e: chem.aligned(chem.window_after(text, e["name"]))
    rows = rows.withColumn("entities", F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["role"].alias("role"), amounts(e)["quantity"].alias("quantity"), amounts(e)["moles"].alias("moles"))))
    return rows.withColumn("conditions", conditions(text))


def conditions(text: Column) -> Column:
    return F.struct(
        chem.temperature(text).alias("temperature_celsius"), chem.duration(text).alias("duration_hours"), chem.pressure(text).alias("pressure_atm"),
        chem.atmosphere(text).alias("atmosphere"), chem.technique(text).alias("technique"), F.lit(None).cast("double").alias("yield_percent"),
    )


def recipe_title(technique: Column, entities: Column) -> Column:
    """{Technique} synthesis of {first product}."""
    product = F.get(F.filter(entities, lambda e: e["role"] == "PRODUCT"), 0)["name"]
    return F.concat_ws(" ", title_case(technique), F.lit("synthesis of"), F.coalesce(product, F.lit("unknown product")))
