"""Shared helpers of the training-data operators: table reads and lineage cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom import session
from paperloom.session import ARROW_ROWS, text_batches  # noqa: F401

_written: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, which purge() will delete."""
    path = session.scratch_path(spark, kind)
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._paperloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in tables:
        path = df._paperloom_path
        _written.remove(path)
        delete(df.sparkSession, path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` makes, materialized; all other tables that it wrote on the way are deleted."""
    before = len(_written)
    out = materialize(build())
    for path in _written[before:-1]:
        delete(out.sparkSession, path)
    del _written[before:-1]
    return out


def purge(spark: SparkSession) -> None:
    """Delete what is left of the scratch paths. For the caller, once results that read them are written."""
    while _written:
        delete(spark, _written.pop())
