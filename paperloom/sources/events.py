"""The append-only event log as JSON lines, and the recipe store as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.schemas import EVENTS


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events; unknown fields are left out, missing ones are null, broken lines are dropped."""
    return spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def by_stage(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("job_id").alias("jobs"))


def write_recipes(recipes: DataFrame, path: str) -> None:
    """Full refresh of the store."""
    recipes.write.mode("overwrite").parquet(path)


def recipe(spark: SparkSession, path: str, recipe_id: str) -> DataFrame:
    """One recipe; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("recipe_id") == recipe_id)


def split_persist(recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes to the graph (passed or corrected), and what goes to run metrics (all)."""
    return recipes.where(F.col("validation_status").isin("PASSED", "CORRECTED")), recipes
