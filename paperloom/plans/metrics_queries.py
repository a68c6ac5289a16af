"""Run metrics, recipe lists, upserts, comparisons and job status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import metrics, reconcile, validate
from paperloom.plans.registry import CONDITIONS, ENTITIES, PAPERS, RECIPES, RUNS, having, query
from paperloom.plans.validate_queries import FOUND
from paperloom.sources import events as log
from paperloom.sources import notes as note_files
from paperloom.sources import surrogates as tables


@query(having(RUNS, select="""
SELECT count(*) AS total_recipes, count(*) FILTER (validation_status = 'PASSED' AND correction_count = 0) AS passed_first_try, count(*) FILTER (validation_status = 'CORRECTED') AS passed_after_correction,
  count(*) FILTER (validation_status = 'FAILED') AS failed_unresolvable,
  round(count(*) FILTER (validation_status = 'CORRECTED' OR validation_status = 'PASSED' AND correction_count = 0) * 100.0::DOUBLE / count(*), 1) AS success_rate_percent,
  round(count(*) FILTER (validation_status = 'CORRECTED') * 100.0::DOUBLE / count(*), 1) AS self_correction_rate_percent, CAST(sum(total_tokens) AS BIGINT) AS total_tokens_used, round(sum(cost_usd), 2) AS total_cost_usd,
  round(sum(latency_seconds) / count(*), 2) AS avg_latency_seconds, round(sum(total_tokens)::DOUBLE / count(*), 0) AS avg_tokens_per_recipe, CAST(sum(correction_count) AS BIGINT) AS total_corrections_made,
  round(sum(correction_count)::DOUBLE / count(*), 2) AS avg_corrections_per_recipe FROM runs"""))
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.snapshot(tables.runs(spark, sf_dir))


@query(having(RUNS, select="""
, errors AS (SELECT error AS error_type, count(*) AS count FROM runs WHERE correction_count > 0 GROUP BY 1)
SELECT error_type, count, round(count * 100.0::DOUBLE / sum(count) OVER (), 1) AS percentage FROM errors"""))
def error_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_frequency(tables.runs(spark, sf_dir))


@query(having(RUNS, select="SELECT node AS node_name, round(avg(latency), 3) AS avg_latency_seconds, count(*) AS total_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM steps JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"))
def node_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.node_timings(tables.runs(spark, sf_dir))


@query("""WITH merged AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'purchase' UNION ALL SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM merged) WHERE k = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    old, new = rows.where("event_type <> 'purchase'").drop("event_type"), rows.where("event_type = 'purchase'").drop("event_type")
    return metrics.upsert_latest(old, new, "user_id", "event_id")


@query("""SELECT o_orderkey AS recipe_id, o_orderstatus AS status, NULL::VARCHAR AS warning FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1""")
def schema_evolution_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders stand for the old table, which lacks a column, odd ones for the new; together they are all."""
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("warning"))
    old, new = rows.where("recipe_id % 2 = 0").drop("warning"), rows.where("recipe_id % 2 = 1")
    return old.unionByName(new, allowMissingColumns=True)


@query(having(RECIPES, select="SELECT recipe_id, validation_status, cost_usd FROM recipes WHERE validation_status = 'CORRECTED' ORDER BY cost_usd DESC, recipe_id LIMIT 50"))
def recipe_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recipe_list(tables.recipes(spark, sf_dir), "CORRECTED", 50, "cost_usd", True).select("recipe_id", "validation_status", "cost_usd")


@query(having(ENTITIES, RECIPES, CONDITIONS, FOUND, RUNS, select="""
SELECT r.recipe_id, r.title, r.validation_status, coalesce(e.n, 0) AS entity_count, n.correction_count, s.n_warning AS warning_count, c.temperature_celsius, c.duration_hours,
  coalesce(e.products, '') AS product_names, round(n.latency_seconds, 6) AS latency_seconds, r.cost_usd, strftime(r.extracted_at, '%Y-%m-%dT%H:%M:%S') AS extracted_at
FROM recipes r JOIN runs n USING (recipe_id) JOIN summed s USING (recipe_id) LEFT JOIN conds c USING (recipe_id)
LEFT JOIN (SELECT recipe_id, count(*) AS n, string_agg(name, ',' ORDER BY pos) FILTER (role = 'PRODUCT') AS products FROM ents GROUP BY 1) e USING (recipe_id)"""))
def recipe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = tables.runs(spark, sf_dir).select("recipe_id", "correction_count", F.round("latency_seconds", 6).alias("latency_seconds"))
    rows = validate.assemble(tables.recipes(spark, sf_dir), tables.entities(spark, sf_dir), tables.conditions(spark, sf_dir))
    out = metrics.recipe_summary(validate.summary(validate.with_findings(rows)).join(run, "recipe_id"))
    return out.withColumns({"product_names": F.array_join("product_names", ",")} | {c: F.col(c).cast("long") for c in ("entity_count", "correction_count", "warning_count")})


@query(having(RECIPES, select="SELECT recipe_id, title FROM recipes WHERE contains(lower(title), 'urgent') AND validation_status = 'PASSED'"))
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.recipes(spark, sf_dir).where(F.lower(F.coalesce("title", F.lit(""))).contains("urgent") & (F.col("validation_status") == "PASSED"))
    return rows.select("recipe_id", "title")


@query("SELECT count(*) AS chunks, count(DISTINCT CASE WHEN doc_id % 3 <> 0 THEN md5(text) ELSE text END) AS papers, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").withColumn("key", F.when(F.col("doc_id") % 3 != 0, F.md5("text")).otherwise(F.col("text")))
    return metrics.run_summary(docs, "key", "source")


@query("""WITH b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'), a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS added, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS removed""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem")
    return metrics.snapshot_delta(rows.where("l_shipdate < timestamp '2000-01-01'"), rows.where("l_returnflag <> 'R'"), ["l_partkey", "l_suppkey"])


@query("""WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000)
SELECT *, 'stored' AS missing_from FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'expected' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def reconcile_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders")
    return metrics.differences(rows.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderstatus"), rows.where("o_totalprice > 100000").select("o_custkey", "o_orderstatus"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 500 <> 3 OR l_linenumber > 2 THEN l_returnflag END AS said FROM lineitem WHERE l_orderkey % 700 <> 1), b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS said FROM lineitem)
SELECT *, 'stored' AS missing_from FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'expected' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def reconcile_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against a copy with a few rows lost and changed: only ranges whose hash sums differ are compared."""
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("said"))
    changed = F.when((F.col("l_orderkey") % 500 != 3) | (F.col("l_linenumber") > 2), F.col("said"))
    copy = rows.where("l_orderkey % 700 <> 1").withColumn("said", changed)
    return reconcile.differences(copy, rows, ["l_orderkey"])


@query(having(ENTITIES, select="SELECT name AS product, count(*) AS n FROM ents WHERE role = 'PRODUCT' GROUP BY 1"))
def products_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.entities(spark, sf_dir).where("role = 'PRODUCT'").withColumn("formula", F.lit(None).cast("string"))
    return rows.groupBy(F.coalesce(F.nullif("formula", F.lit("")), "name").alias("product")).agg(F.count("*").alias("n"))


JOBS = "ev AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'stored' WHEN 'signup' THEN 'complete' ELSE event_type END AS stage FROM events)"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as those of jobs: a purchase is a stored chunk, a signup a completion."""
    stage = F.when(F.col("event_type") == "purchase", "stored").when(F.col("event_type") == "signup", "complete").otherwise(F.col("event_type"))
    return tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", stage.alias("stage"))


@query(having(JOBS, select="""
SELECT job_id, count(*) FILTER (stage = 'stored') AS chunks_done, count(*) FILTER (stage = 'error') AS errors,
  coalesce(arg_max(CASE stage WHEN 'error' THEN 'failed' ELSE 'completed' END, event_id) FILTER (stage IN ('error', 'complete')), 'running') AS status, max(ts) AS last_ts FROM ev GROUP BY 1"""))
def job_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.job_status(job_events(spark, sf_dir))


@query(having(JOBS, select="SELECT stage, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT job_id) AS jobs FROM ev GROUP BY 1"))
def event_log_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.by_stage(job_events(spark, sf_dir))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS stage, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage")
    return rows.groupBy(F.window("ts", "1 hour"), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "stage", "n")


@query(having(ENTITIES, RECIPES, select="""
SELECT 'recipe' AS note_type, 'rxn_' || r.recipe_id || '.md' AS file_name, count(e.recipe_id) AS n_rows FROM recipes r LEFT JOIN ents e USING (recipe_id) GROUP BY r.recipe_id"""))
def note_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of all recipes: name and the number of table rows in the text."""
    rows = validate.assemble(tables.recipes(spark, sf_dir), tables.entities(spark, sf_dir), tables.conditions(spark, sf_dir))
    return note_files.recipe_notes(rows).select("note_type", "file_name", F.regexp_count("content", F.lit(r"(?m)^\| \[\[")).cast("long").alias("n_rows"))


@query(having(ENTITIES, RECIPES, CONDITIONS, select="""
SELECT CAST(r.recipe_id AS VARCHAR) AS recipe_id, validation_status, count(e.recipe_id) AS n_entities, coalesce(string_agg(name || ':' || role, ',' ORDER BY pos), '') AS entities,
  temperature_celsius, duration_hours FROM recipes r LEFT JOIN ents e USING (recipe_id) LEFT JOIN conds c USING (recipe_id) GROUP BY r.recipe_id, validation_status, temperature_celsius, duration_hours"""))
def note_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes are written as text and parsed back."""
    rows = validate.assemble(tables.recipes(spark, sf_dir), tables.entities(spark, sf_dir), tables.conditions(spark, sf_dir))
    back = note_files.parsed_notes(note_files.recipe_notes(rows))
    entities = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["name"], e["role"])), ",")
    return back.select("recipe_id", "validation_status", F.size("entities").cast("long").alias("n_entities"), entities.alias("entities"), "temperature_celsius", "duration_hours")


#: Amounts of an entity as they come back from a payload, and from a table's cells.
AMOUNTS = """
said AS (SELECT recipe_id, pos, name || '/' || coalesce(CASE WHEN value IS NOT NULL THEN CAST(value AS DOUBLE) || ' ' || coalesce(unit, '') END, '-') || '/' || moles_value::DOUBLE || ' mmol' AS whole,
  name || '/' || coalesce(CASE WHEN value >= 0 AND unit IS NOT NULL THEN CAST(value AS DOUBLE) || ' ' || unit END, '-') || '/' || moles_value::DOUBLE || ' mmol' AS cells FROM ents)"""


@query(having(ENTITIES, RECIPES, AMOUNTS, select="""
SELECT CAST(r.recipe_id AS VARCHAR) AS recipe_id, coalesce(string_agg(whole, ',' ORDER BY pos), '') AS payload, coalesce(string_agg(cells, ',' ORDER BY pos), '') AS cells FROM recipes r LEFT JOIN said s ON s.recipe_id = r.recipe_id GROUP BY r.recipe_id"""))
def note_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and moles of notes read back, from the payload, and from the tables of notes that have lost it."""
    rows = validate.assemble(tables.recipes(spark, sf_dir), tables.entities(spark, sf_dir), tables.conditions(spark, sf_dir))
    written = note_files.recipe_notes(rows)
    amount = lambda q: F.coalesce(F.concat(q["value"].cast("string"), F.lit(" "), F.coalesce(q["unit"], F.lit(""))), F.lit("-"))
    said = F.array_join(F.transform("entities", lambda e: F.concat_ws("/", e["name"], amount(e["quantity"]), amount(e["moles"]))), ",")
    bare = F.regexp_replace("content", rf"(?s)```{note_files.FENCE}.*?```", "")
    whole = note_files.parsed_notes(written, ("content",)).select(F.col("recipe_id").alias("id"), said.alias("payload"), bare.alias("content"))
    return note_files.parsed_notes(whole, ("id", "payload")).where("recipe_id = id").select("recipe_id", "payload", said.alias("cells"))


@query(having(ENTITIES, RECIPES, select="""
, cells AS (SELECT recipe_id, string_agg('| [[' || name || ']] | ' || CASE WHEN value IS NULL THEN '-' ELSE concat_ws(' ', CAST(value AS DOUBLE), unit) END || ' | ' || moles_value::DOUBLE || ' mmol | ' || role || ' |', chr(10) ORDER BY pos) AS t FROM ents GROUP BY 1)
SELECT recipe_id, '# ' || title || chr(10) || chr(10) || '**Status:** ' || CASE validation_status WHEN 'PASSED' THEN '✅ PASSED' WHEN 'CORRECTED' THEN '⚠️ CORRECTED' ELSE '❌ FAILED' END || chr(10) || '**Source:** [[Unknown source]]' || chr(10) || chr(10)
  || '## Reactants' || chr(10) || '| Chemical | Quantity | Moles | Role |' || chr(10) || '|---|---|---|---|' || chr(10) || coalesce(t, '') || chr(10) || chr(10) AS body FROM recipes LEFT JOIN cells USING (recipe_id)"""))
def note_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of notes from the title to the end of the table of reactants."""
    rows = validate.assemble(tables.recipes(spark, sf_dir), tables.entities(spark, sf_dir), tables.conditions(spark, sf_dir))
    body = F.regexp_extract("content", r"(?s)(# .*?)## Reaction Conditions", 1)
    number = F.regexp_extract("file_name", r"(\d+)", 1).cast("long")
    return note_files.recipe_notes(rows).select(number.alias("recipe_id"), body.alias("body"))


@query(having(PAPERS, select="""
SELECT ord, list_filter([CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' END, CASE WHEN year NOT BETWEEN 1900 AND 2100 THEN 'year' END, CASE WHEN citation_count < 0 THEN 'citation_count' END], lambda x: x IS NOT NULL)[1] AS fault FROM papers"""))
def paper_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.schemas import paper_faults as faults

    rows = tables.papers(spark, sf_dir).withColumn("relevance_score", F.lit(None).cast("double"))
    return rows.select("ord", F.get(faults(), 0).alias("fault"))
