"""A session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def build(app: str = "paperloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution; everything else is the cluster's or the caller's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where it is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _own.get(sc.applicationId)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/paperloom-{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A lineage cut that outlives executors: a table in the shared folder, read back."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that go to a Python worker at once. Texts can be long, and a worker holds some copies of a batch.
ARROW_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """`df`, with Arrow batches of at most ARROW_ROWS rows in its session."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df
