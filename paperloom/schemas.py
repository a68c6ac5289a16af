"""Declared table schemas and the value checks of each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAPERS = (
    "ord long, title string, doi string, arxiv_id string, pubmed_id string, pubmed_central_id string, semantic_scholar_id string,"
    " openalex_id string, authors array<string>, year int, abstract string, source_db string, open_access boolean,"
    " open_access_url string, citation_count int, relevance_score double, has_experimental_section boolean"
)
QUANTITY = "struct<value:double,unit:string>"
ENTITY = f"struct<name:string,formula:string,role:string,quantity:{QUANTITY},moles:{QUANTITY},notes:string>"
CONDITIONS = "struct<temperature_celsius:double,duration_hours:double,pressure_atm:double,atmosphere:string,technique:string,yield_percent:double,additional_conditions:map<string,string>>"
RECIPES = (
    "recipe_id string, title string, source_paper_title string, source_paper_doi string, source_paper_url string, source_chunk_id string,"
    f" entities array<{ENTITY}>, conditions {CONDITIONS}, validation_status string, validation_errors array<string>,"
    " total_tokens int, cost_usd double, latency_seconds double, node_latencies map<string,double>, node_tokens map<string,int>, extracted_at timestamp"
)
RUNS = (
    "recipe_id string, validation_status string, correction_count int, total_tokens int, cost_usd double, latency_seconds double, llm_model string,"
    " error_types array<string>, warning_types array<string>, node_latencies map<string,double>, node_tokens map<string,int>, extracted_at timestamp"
)
EVENTS = ("ts timestamp, event string, stage string, job_id string, recipe_id string, agent string, detail string, raw_output string, chunks int, status string, message string")
FINDING = "struct<rule_no:int,error_type:string,severity:string,responsible_agent:string,field_path:string,entity_name:string,actual_value:string,message:string>"

#: Roles and statuses that records may hold, and names that are no names.
ROLES = ("REACTANT", "SOLVENT", "CATALYST", "PRODUCT", "ADDITIVE", "UNKNOWN")
STATUSES = ("PENDING", "PASSED", "FAILED", "CORRECTED")
PLACEHOLDERS = ("unknown", "n/a", "na", "none", "")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def paper_faults() -> Column:
    """Reasons why a paper row is rejected; empty if it isn't."""
    year, cites, score = F.col("year"), F.col("citation_count"), F.col("relevance_score")
    return F.array_compact(
        F.array(
            F.when(F.col("title").isNull() | (F.trim("title") == ""), "title"),
            F.when(year.isNotNull() & ~year.between(1900, 2100), "year"),
            F.when(cites < 0, "citation_count"),
            F.when(score.isNotNull() & ~(finite(score) & score.between(0, 1)), "relevance_score"),
        )
    )


def chunk_faults(text: Column, density: Column) -> Column:
    """A chunk needs 50 characters before it is trimmed, and something after."""
    return F.array_compact(F.array(F.when(text.isNull() | (F.length(text) < 50), "text_short"), F.when(F.trim(text) == "", "text_blank"), F.when(~density.between(0, 1), "density")))


def placeholder_name(name: Column) -> Column:
    return name.isNull() | F.lower(F.trim(name)).isin(*PLACEHOLDERS)
