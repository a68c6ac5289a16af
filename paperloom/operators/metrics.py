"""Run metrics: one global aggregate per snapshot, frequencies, step timings, upserts, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import words


def snapshot(runs: DataFrame) -> DataFrame:
    """One row, zeros for an empty table."""
    status = F.col("validation_status")
    total = F.count("*")
    first = F.count_if((status == "PASSED") & (F.col("correction_count") == 0))
    fixed = F.count_if(status == "CORRECTED")
    share = lambda n, d, k: F.coalesce(F.round(F.try_divide(n, d), k), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return runs.agg(
        total.alias("total_recipes"), first.alias("passed_first_try"), fixed.alias("passed_after_correction"), F.count_if(status == "FAILED").alias("failed_unresolvable"),
        share((first + fixed) * 100.0, total, 1).alias("success_rate_percent"), share(fixed * 100.0, total, 1).alias("self_correction_rate_percent"),
        zero(F.sum("total_tokens")).alias("total_tokens_used"), F.coalesce(F.round(F.sum("cost_usd"), 2), F.lit(0.0)).alias("total_cost_usd"),
        share(F.sum("latency_seconds"), total, 2).alias("avg_latency_seconds"), share(F.sum("total_tokens"), total, 0).alias("avg_tokens_per_recipe"),
        zero(F.sum("correction_count")).alias("total_corrections_made"), share(F.sum("correction_count"), total, 2).alias("avg_corrections_per_recipe"),
    )


def error_frequency(runs: DataFrame) -> DataFrame:
    """error_type, count, percentage of all errors; most frequent first."""
    counts = runs.select(F.explode("error_types").alias("error_type")).groupBy("error_type").agg(F.count("*").alias("count"))
    share = F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()), 1)  # a row per error type
    return counts.withColumn("percentage", share).orderBy(F.desc("count"), "error_type")


def node_timings(runs: DataFrame) -> DataFrame:
    """Per step: mean latency, calls and tokens. Only steps with a latency are listed; both maps are read in one pass."""
    steps = runs.select(F.explode(F.transform(F.map_entries("node_latencies"), lambda e: F.struct(e["key"].alias("node_name"), e["value"].alias("latency"), F.lit(None).cast("long").alias("tokens")))).alias("s"))
    tokens = runs.select(F.explode(F.transform(F.map_entries("node_tokens"), lambda e: F.struct(e["key"].alias("node_name"), F.lit(None).cast("double").alias("latency"), e["value"].cast("long").alias("tokens")))).alias("s"))
    out = steps.unionByName(tokens).groupBy("s.node_name").agg(F.round(F.avg("s.latency"), 3).alias("avg_latency_seconds"), F.count("s.latency").alias("total_calls"), F.coalesce(F.sum("s.tokens"), F.lit(0)).alias("total_tokens"))
    return out.where("total_calls > 0")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the latest of each key; columns that only the new rows have are null in old ones."""
    both = old.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def run_summary(chunks: DataFrame, key: str, source: str) -> DataFrame:
    """Chunks, distinct papers and the sorted list of sources, in one row."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct(key).alias("papers"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows in one table only, with multiplicity, and the side they are missing from."""
    lost, extra = expected.exceptAll(stored), stored.exceptAll(expected)
    return lost.withColumn("missing_from", F.lit("stored")).unionByName(extra.withColumn("missing_from", F.lit("expected")))


#: Rows whose keys a task of snapshot_delta() holds.
DELTA_ROWS = 1_000_000


def snapshot_delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys added and removed between two snapshots. Tasks grow in number with the rows, not in size."""
    both = before.select(*key).withColumn("_b", F.lit(1)).unionByName(after.select(*key).withColumn("_a", F.lit(1)), allowMissingColumns=True)
    sides = both.repartition(-(-both.count() // DELTA_ROWS) or 1, *key).groupBy(*key).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    return sides.agg(F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_a").isNull()).alias("removed"))


def job_status(events: DataFrame) -> DataFrame:
    """Per job, from (job_id, ts, event_id, stage): chunks done, errors, and the status after the last event that sets one."""
    at = F.struct("ts", "event_id")
    sets = F.when(F.col("stage") == "error", "failed").when(F.col("stage") == "complete", "completed")
    return events.groupBy("job_id").agg(
        F.count_if(F.col("stage") == "stored").alias("chunks_done"), F.count_if(F.col("stage") == "error").alias("errors"),
        F.coalesce(F.max_by(sets, F.when(sets.isNotNull(), at)), F.lit("running")).alias("status"), F.max("ts").alias("last_ts"),
    )


def recipe_list(recipes: DataFrame, status: str | None = None, limit: int = 50, by: str = "recipe_id", descending: bool = False) -> DataFrame:
    """The first 1 to 500 recipes of a status, by a column; ties by id."""
    rows = recipes.where(F.col("validation_status") == status) if status else recipes
    return rows.orderBy(F.desc(by) if descending else F.asc(by), "recipe_id").limit(max(1, min(limit, 500)))


def recipe_summary(rows: DataFrame) -> DataFrame:
    """The twelve facts of a recipe row that a list shows; rows have entities, conditions, warnings and n_corrections."""
    products = F.transform(F.filter("entities", lambda e: e["role"] == "PRODUCT"), lambda e: e["name"])
    return rows.select(
        "recipe_id", "title", "validation_status", F.size("entities").alias("entity_count"), "correction_count", F.size("warnings").alias("warning_count"),
        "conditions.temperature_celsius", "conditions.duration_hours", products.alias("product_names"), "latency_seconds", "cost_usd", F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"),
    )


def note_counts(notes: DataFrame) -> DataFrame:
    """Notes and their words by type."""
    return notes.groupBy("note_type").agg(F.count("*").alias("notes"), F.sum(F.size(words(F.col("content")))).cast("long").alias("words"))


def cleaned_list(values: Column) -> Column:
    """A list that is kept: trimmed, without blanks, each once."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
