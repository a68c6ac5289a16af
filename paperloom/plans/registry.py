"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The engine's tables over the star schema, as SQL.
ENTITIES = """
ents AS (
  SELECT l_orderkey AS recipe_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS pos,
    p_name AS name, CASE l_returnflag WHEN 'A' THEN 'REACTANT' WHEN 'N' THEN 'SOLVENT' ELSE 'PRODUCT' END AS role,
    CASE WHEN l_linenumber <> 7 THEN l_quantity - 1 END AS value, CASE WHEN l_linenumber = 5 THEN 'stone' WHEN l_linenumber <> 3 THEN 'g' END AS unit,
    l_discount AS moles_value, 'chem::' || replace(trim(lower(p_name)), ' ', '_') AS chem, 'rxn::' || l_orderkey AS rxn
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
RECIPES = """
recipes AS (
  SELECT o_orderkey AS recipe_id, CASE o_orderstatus WHEN 'F' THEN 'CORRECTED' WHEN 'O' THEN 'PASSED' ELSE 'FAILED' END AS validation_status,
    o_totalprice AS cost_usd, o_orderdate AS extracted_at, o_orderpriority AS title, o_custkey AS paper_key FROM orders)"""
CONDITIONS = """
conds AS (
  SELECT l_orderkey AS recipe_id, max(l_extendedprice) / 20 - 200 AS temperature_celsius, sum(l_quantity) * 3 AS duration_hours,
    count(*) * 250.0 AS pressure_atm, count(*) * 20.0 AS yield_percent FROM lineitem GROUP BY 1)"""
ROLE_EDGES = """
redges AS (
  SELECT CASE WHEN role = 'PRODUCT' THEN rxn ELSE chem END AS source, CASE WHEN role = 'PRODUCT' THEN chem ELSE rxn END AS target, recipe_id,
    CASE arg_max(role, pos) WHEN 'PRODUCT' THEN 'PRODUCES' WHEN 'SOLVENT' THEN 'IS_SOLVENT_IN' ELSE 'IS_REACTANT_IN' END AS relationship_type, count(*) AS writes
  FROM ents GROUP BY 1, 2, 3)"""
CO_EDGES = """
pairs AS (
  SELECT a.chem AS source, b.chem AS target, a.recipe_id, count(*) AS writes FROM ents a JOIN ents b ON a.recipe_id = b.recipe_id AND a.pos < b.pos AND a.chem <> b.chem
  WHERE a.role <> 'PRODUCT' AND b.role <> 'PRODUCT' GROUP BY 1, 2, 3),
cedges AS (
  SELECT source, target, count(*)::DOUBLE AS weight, CASE WHEN sum(writes) = 1 THEN 1.0::DOUBLE ELSE count(*)::DOUBLE / 2 END AS width, count(*) AS n_recipes FROM pairs GROUP BY 1, 2)"""
NODES = """
nodes AS (
  SELECT chem AS node_id, arg_max(name, (recipe_id * 1000 + pos)) AS label, arg_max(role, (recipe_id * 1000 + pos)) AS role, count(DISTINCT recipe_id) AS reaction_count FROM ents GROUP BY 1)"""
RUNS = """
steps AS (SELECT l_orderkey, l_linestatus AS node, sum(l_tax) AS latency, CAST(sum(l_quantity) AS BIGINT) AS tokens, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1, 2),
byrun AS (SELECT l_orderkey, CAST(sum(returned) AS BIGINT) AS correction_count, CAST(sum(tokens) AS BIGINT) AS total_tokens, sum(latency) AS latency_seconds FROM steps GROUP BY 1),
runs AS (
  SELECT o_orderkey AS recipe_id, CASE o_orderstatus WHEN 'F' THEN 'CORRECTED' WHEN 'O' THEN 'PASSED' ELSE 'FAILED' END AS validation_status, o_totalprice AS cost_usd,
    o_orderdate AS extracted_at, o_orderpriority AS error, correction_count, total_tokens, latency_seconds FROM orders JOIN byrun ON o_orderkey = l_orderkey)"""
PAPERS = """
papers AS (
  SELECT doc_id AS ord, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS doi, CAST(n_chars AS INTEGER) AS citation_count,
    CAST(doc_id % 30 + 1995 AS INTEGER) AS year, source AS source_db, text AS abstract, doc_id % 2 = 0 AS open_access, doc_id % 5 = 0 AS has_experimental_section FROM documents)"""


def having(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"
