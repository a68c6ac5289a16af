"""The engine's tables derived from the star schema and the text tables.

recipes are orders, their entities are line items with part names, conditions are sums
over an order, papers and chunks are documents, runs are orders with their line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, pos, name, role, quantity and moles: a line item each, numbered in a fixed order; some amounts have faults."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    # Names come first, so that rows stay where the numbering puts them: together by recipe.
    items = table(spark, sf_dir, "lineitem").join(names, "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    role = F.when(F.col("l_returnflag") == "A", "REACTANT").when(F.col("l_returnflag") == "N", "SOLVENT").otherwise("PRODUCT")
    return items.select(
        F.col("l_orderkey").alias("recipe_id"), (F.row_number().over(order) - 1).alias("pos"), role.alias("role"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") - 1).alias("value"), F.when(F.col("l_linenumber") == 5, "stone").when(F.col("l_linenumber") != 3, "g").alias("unit"),
        F.col("l_discount").alias("moles_value"), F.lit("mmol").alias("moles_unit"), "name",
    )


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "CORRECTED").when(F.col("o_orderstatus") == "O", "PASSED").otherwise("FAILED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("recipe_id"), status.alias("validation_status"), F.col("o_totalprice").alias("cost_usd"), F.col("o_orderdate").alias("extracted_at"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("paper_key"),
    )


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("recipe_id")).agg(F.max("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
    return sums.select("recipe_id", (F.col("price") / 20 - 200).alias("temperature_celsius"), (F.col("quantity") * 3).alias("duration_hours"), (F.col("n") * 250.0).alias("pressure_atm"), (F.col("n") * 20.0).alias("yield_percent"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("ord"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.when(F.col("doc_id") % 3 != 0, F.md5("text")).alias("doi"),
        F.col("n_chars").cast("int").alias("citation_count"), (F.col("doc_id") % 30 + 1995).cast("int").alias("year"), F.col("source").alias("source_db"), F.col("text").alias("abstract"),
        (F.col("doc_id") % 2 == 0).alias("open_access"), (F.col("doc_id") % 5 == 0).alias("has_experimental_section"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per order: corrections are returned lines, step latencies and tokens are sums by line status."""
    items = table(spark, sf_dir, "lineitem")
    by_step = items.groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_tax").alias("latency"), F.sum("l_quantity").cast("long").alias("tokens"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    by_run = by_step.groupBy("l_orderkey").agg(
        F.sum("returned").alias("correction_count"), F.sum("tokens").alias("total_tokens"), F.sum("latency").alias("latency_seconds"),
        F.map_from_entries(F.collect_list(F.struct("l_linestatus", "latency"))).alias("node_latencies"), F.map_from_entries(F.collect_list(F.struct("l_linestatus", "tokens"))).alias("node_tokens"),
    )
    found = recipes(spark, sf_dir).drop("paper_key").join(by_run, F.col("recipe_id") == F.col("l_orderkey")).drop("l_orderkey")
    # What an order's priority says stands for the error types of a run.
    return found.withColumn("error_types", F.when(F.col("correction_count") > 0, F.array("title")).otherwise(F.array().cast("array<string>"))).drop("title")
