"""Rejects counted in flight: one pass writes good rows and rejected ones apart, and counts both on the way.

Nothing is read twice to know how many rows were rejected and why: the counts are observed while the
rows are written, so they are those of the tables, also where a task was repeated.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.session import scratch_path


class Sorted(NamedTuple):
    """Good rows, rejected rows with their `faults` (`row_faults` if rows have a column of that name), and numbers: `rows`, `good`, and of each fault."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def set_aside(rows: DataFrame, faults: Column, kinds: list[str], folder: str | None = None) -> Sorted:
    """`faults` lists the kinds of faults of a row (array<string>), empty or null if it is good. A row may have several."""
    folder = folder or scratch_path(rows.sparkSession, "sorted")
    long = "_" * max(map(len, ["x", *rows.columns]))  # names that no column has
    found, bad = long + "faults", long + "bad"
    marked = rows.withColumn(found, F.coalesce(faults, F.array().cast("array<string>"))).withColumn(bad, F.size(found) > 0)
    seen = Observation()
    each = [F.count_if(F.array_contains(found, k)).alias(f"fault {k}") for k in kinds]
    marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(bad)).alias("good"), *each).write.partitionBy(bad).parquet(folder)
    back = rows.sparkSession.read.schema(marked.schema).parquet(folder)
    counts = {"rows": seen.get["rows"], "good": seen.get["good"]} | {k: seen.get[f"fault {k}"] for k in kinds}
    return Sorted(back.where(~F.col(bad)).select(*rows.columns), back.where(bad).withColumnRenamed(found, "faults" if "faults" not in rows.columns else "row_faults").drop(bad), counts)


def sorted_papers(papers: DataFrame, folder: str | None = None) -> Sorted:
    return set_aside(papers, schemas.paper_faults(), ["title", "year", "citation_count", "relevance_score"], folder)


def sorted_chunks(chunks: DataFrame, text_col: str = "text", density_col: str = "density", folder: str | None = None) -> Sorted:
    return set_aside(chunks, schemas.chunk_faults(F.col(text_col), F.col(density_col)), ["text_short", "text_blank", "density"], folder)


def sorted_events(spark: SparkSession, path: str, folder: str | None = None) -> Sorted:
    """Events of a log of JSON lines; a line that is no JSON is kept as it came, in `line`, and so is one without a time or an event."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", f"{schemas.EVENTS}, line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"})
    rows = lines.select(read.alias("e"), "value").select("e.*", "value")
    broken = F.col("line").isNotNull() | ~F.startswith(F.trim("value"), F.lit("{"))
    faults = F.array_compact(F.array(F.when(broken, "json"), F.when(~broken & F.col("ts").isNull(), "ts"), F.when(~broken & F.col("event").isNull() & F.col("stage").isNull(), "event")))
    out = set_aside(rows, faults, ["json", "ts", "event"], folder)
    return Sorted(out.good.drop("line", "value"), out.rejected.drop("line").withColumnRenamed("value", "line"), out.counts)
