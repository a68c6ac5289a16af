"""Validation and correction routing over orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import validate
from paperloom.plans.registry import CONDITIONS, ENTITIES, RECIPES, having, query
from paperloom.sources import surrogates as tables

FOUND = """
found AS (
  SELECT recipe_id, 1 AS rule_no, 'NO_ENTITIES' AS error_type, 'BLOCKING' AS severity, 'ENTITY_AGENT' AS responsible_agent, 'entities' AS field_path, NULL::VARCHAR AS entity_name, -1 AS pos FROM recipes WHERE recipe_id NOT IN (SELECT recipe_id FROM ents)
  UNION ALL SELECT r.recipe_id, 2, 'NO_PRIMARY_REACTANT', 'BLOCKING', 'ENTITY_AGENT', 'entities', NULL, -1 FROM recipes r JOIN (SELECT recipe_id FROM ents GROUP BY 1 HAVING count(*) FILTER (role = 'REACTANT') = 0) e USING (recipe_id)
  UNION ALL SELECT recipe_id, 3, 'DUPLICATE_ENTITY_NAMES', 'BLOCKING', 'ENTITY_AGENT', 'entities[' || pos || '].name', name, pos FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id, lower(trim(name)) ORDER BY pos) AS k FROM ents) WHERE k > 1
  UNION ALL SELECT recipe_id, 4, 'ENTITY_NAME_TOO_SHORT', 'BLOCKING', 'ENTITY_AGENT', 'entities[' || pos || '].name', name, pos FROM ents WHERE length(trim(name)) < 2
  UNION ALL SELECT recipe_id, 5, 'UNIT_MISSING', CASE role WHEN 'SOLVENT' THEN 'WARNING' ELSE 'BLOCKING' END, 'QUANTITY_AGENT', 'entities[' || pos || '].quantity', name, pos FROM ents WHERE role IN ('REACTANT', 'SOLVENT') AND (value IS NULL OR unit IS NULL)
  UNION ALL SELECT recipe_id, 6, 'UNIT_INVALID', 'BLOCKING', 'QUANTITY_AGENT', 'entities[' || pos || '].quantity.unit', name, pos FROM ents WHERE value IS NOT NULL AND unit = 'stone'
  UNION ALL SELECT recipe_id, 7, 'QUANTITY_NEGATIVE', 'BLOCKING', 'QUANTITY_AGENT', 'entities[' || pos || '].quantity.value', name, pos FROM ents WHERE value <= 0
  UNION ALL SELECT recipe_id, 7, 'QUANTITY_NEGATIVE', 'BLOCKING', 'QUANTITY_AGENT', 'entities[' || pos || '].moles.value', name, pos FROM ents WHERE moles_value <= 0
  UNION ALL SELECT recipe_id, 8, 'SOLVENT_IS_REACTANT', 'BLOCKING', 'ENTITY_AGENT', 'entities', lower(name), -1 FROM ents WHERE role IN ('SOLVENT', 'REACTANT') GROUP BY recipe_id, lower(name) HAVING count(DISTINCT role) = 2
  UNION ALL SELECT recipe_id, 9, 'PRODUCT_QUANTITY_AS_INPUT', 'WARNING', 'ENTITY_AGENT', 'entities[' || pos || '].quantity', name, pos FROM ents WHERE role = 'PRODUCT' AND value IS NOT NULL
  UNION ALL SELECT recipe_id, 10, 'TEMPERATURE_OUT_OF_RANGE', 'BLOCKING', 'CONDITION_AGENT', 'conditions.temperature_celsius', NULL, -1 FROM conds WHERE temperature_celsius NOT BETWEEN -200 AND 3000
  UNION ALL SELECT recipe_id, 11, 'DURATION_OUT_OF_RANGE', 'BLOCKING', 'CONDITION_AGENT', 'conditions.duration_hours', NULL, -1 FROM conds WHERE duration_hours NOT BETWEEN 0.001 AND 720
  UNION ALL SELECT recipe_id, 12, 'PRESSURE_OUT_OF_RANGE', 'BLOCKING', 'CONDITION_AGENT', 'conditions.pressure_atm', NULL, -1 FROM conds WHERE pressure_atm NOT BETWEEN 0.0001 AND 1000
  UNION ALL SELECT recipe_id, 13, 'YIELD_OUT_OF_RANGE', 'BLOCKING', 'CONDITION_AGENT', 'conditions.yield_percent', NULL, -1 FROM conds WHERE yield_percent NOT BETWEEN 0 AND 100
  UNION ALL SELECT recipe_id, 14, 'NO_CONDITIONS', 'WARNING', 'CONDITION_AGENT', 'conditions', NULL, -1 FROM recipes WHERE recipe_id NOT IN (SELECT recipe_id FROM conds)
  UNION ALL SELECT recipe_id, 15, 'MOLES_MASS_INCONSISTENT', 'WARNING', 'QUANTITY_AGENT', 'entities[' || pos || '].quantity', name, pos FROM ents
    WHERE unit = 'g' AND value IS NOT NULL AND moles_value > 0 AND value / (moles_value * 0.001::DOUBLE) NOT BETWEEN 1.0 AND 100000.0),
kept AS (SELECT found.* FROM found JOIN recipes USING (recipe_id)),
summed AS (
  SELECT recipe_id, count(f.rule_no) FILTER (severity = 'BLOCKING') AS n_blocking, count(f.rule_no) FILTER (severity = 'WARNING') AS n_warning,
    15 - count(DISTINCT f.rule_no) FILTER (severity = 'BLOCKING') AS rules_passed,
    min(CASE WHEN severity = 'BLOCKING' THEN CASE responsible_agent WHEN 'ENTITY_AGENT' THEN 0 WHEN 'QUANTITY_AGENT' THEN 1 ELSE 2 END END) AS agent
  FROM recipes LEFT JOIN found f USING (recipe_id) GROUP BY 1)"""
BASE = (ENTITIES, RECIPES, CONDITIONS, FOUND)
AGENT = "CASE agent WHEN 0 THEN 'ENTITY_AGENT' WHEN 1 THEN 'QUANTITY_AGENT' WHEN 2 THEN 'CONDITION_AGENT' END"


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = tables.recipes(spark, sf_dir).select("recipe_id", "validation_status")
    return validate.with_findings(validate.assemble(recipes, tables.entities(spark, sf_dir), tables.conditions(spark, sf_dir)))


@query(having(*BASE, select="SELECT recipe_id, rule_no, error_type, severity, responsible_agent, field_path, entity_name FROM kept"))
def validate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked(spark, sf_dir).select("recipe_id", F.explode("findings").alias("f"))
    return rows.select("recipe_id", "f.rule_no", "f.error_type", "f.severity", "f.responsible_agent", "f.field_path", "f.entity_name")


@query(having(*BASE, select=f"SELECT recipe_id, n_blocking = 0 AS passed, n_blocking, n_warning, rules_passed, {AGENT} AS primary_agent FROM summed"))
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.summary(checked(spark, sf_dir))
    return rows.select("recipe_id", "passed", F.size("blocking").cast("long").alias("n_blocking"), F.size("warnings").cast("long").alias("n_warning"), F.col("rules_passed").cast("long").alias("rules_passed"), "primary_agent")


@query(having(*BASE, select=f"SELECT {AGENT} AS primary_agent, count(*) AS recipes FROM summed GROUP BY 1"))
def route_primary_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(checked(spark, sf_dir)).groupBy("primary_agent").agg(F.count("*").alias("recipes"))


@query(having(*BASE, select=f"""
, routed AS (SELECT k.*, {AGENT} AS primary_agent FROM kept k JOIN summed USING (recipe_id) WHERE severity = 'BLOCKING' AND responsible_agent = {AGENT}),
firsts AS (SELECT recipe_id, min(rule_no) AS rule_no FROM routed GROUP BY 1)
SELECT r.recipe_id, primary_agent, error_type, string_agg(field_path, '; ' ORDER BY pos, field_path DESC, entity_name) AS fields, count(*) AS n_findings
FROM routed r JOIN firsts USING (recipe_id, rule_no) GROUP BY 1, 2, 3"""))
def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.error_groups(validate.summary(checked(spark, sf_dir)))
    return out.select("recipe_id", "primary_agent", "error_type", "fields", F.col("n_findings").cast("long").alias("n_findings"))


@query(having(ENTITIES, select="""
, firsts AS (SELECT recipe_id, min(pos + 1) FILTER (coalesce(value, 0) >= 20) AS f, max(pos + 1) AS l FROM ents WHERE pos < 3 GROUP BY 1)
SELECT recipe_id AS chunk_id, CASE WHEN f = 1 THEN 'PASSED' WHEN f > 1 THEN 'CORRECTED' ELSE 'FAILED' END AS status, coalesce(f, l) AS attempts_used,
  CASE WHEN f IS NOT NULL THEN f - 1 ELSE least(l, 2) END AS n_corrections FROM firsts"""))
def resolve_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for attempts; an amount of 20 or more passes."""
    attempts = tables.entities(spark, sf_dir).select(F.col("recipe_id").alias("chunk_id"), (F.col("pos") + 1).cast("long").alias("attempt"), (F.coalesce("value", F.lit(0.0)) >= 20).alias("passed"))
    return validate.resolve_attempts(attempts)


@query(having(ENTITIES, select="SELECT recipe_id, pos, name FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id, lower(trim(name)) ORDER BY pos) AS k FROM ents) WHERE k > 1"))
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.second_names(tables.entities(spark, sf_dir)).select("recipe_id", F.col("pos").cast("long").alias("pos"), "name")


@query(having(*BASE, select="SELECT recipe_id, entity_name FROM kept WHERE rule_no = 8"))
def solvent_is_reactant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_findings(spark, sf_dir).where("rule_no = 8").select("recipe_id", "entity_name")


@query(having(*BASE, select="SELECT recipe_id, entity_name, field_path FROM kept WHERE rule_no = 15"))
def moles_mass_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_findings(spark, sf_dir).where("rule_no = 15").select("recipe_id", "entity_name", "field_path")


@query(having(*BASE, select=f"""SELECT recipe_id, {AGENT} AS primary_agent FROM summed WHERE n_blocking > 0"""))
def correction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request texts of failed recipes; the SQL gives the recipes that get one."""
    summed = validate.summary(checked(spark, sf_dir))
    payload = summed.select("recipe_id", F.lit(1).alias("attempt"), F.to_json("conditions").alias("payload"))
    return validate.correction_requests(validate.error_groups(summed), payload).where(F.length("request") > 0).select("recipe_id", "primary_agent")
