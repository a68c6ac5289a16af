"""Chunk streams to recipes and events, job progress as state, and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.functions.text import gate
from paperloom.operators.extract import extracted

PROGRESS = "job_id long, chunks_done long, errors long, status string, last_ts timestamp"
STATE = "chunks_done long, errors long, status string, at timestamp, last_ts timestamp"


def chunk_events(chunks: DataFrame, accept: Column | None = None) -> DataFrame:
    """Each chunk (batch or stream) with its stage: skipped by the gate, else extracting, with entities and conditions. No state."""
    passed = gate(F.col("text")) if accept is None else accept
    return extracted(chunks).withColumn("stage", F.when(passed, "extracting").otherwise("skipped"))


def progress(events: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """Per job, updated with every batch: chunks stored, errors, and the status of the last event that sets one.

    An error marks a job failed, a later completion overrides. State of a job that is idle for `timeout_ms` is dropped.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, errors, status, at, last = state.get if state.exists else (0, 0, "running", None, None)
        for rows in parts:
            done += int((rows.stage == "stored").sum())
            errors += int((rows.stage == "error").sum())
            ends = rows[rows.stage.isin(["error", "complete"])].sort_values(["ts", "event_id"])
            if len(ends) and (at is None or ends.ts.iloc[-1] >= at):
                at = ends.ts.iloc[-1].to_pydatetime()
                status = "failed" if ends.stage.iloc[-1] == "error" else "completed"
            if len(rows):
                last = max(x for x in (last, rows.ts.max().to_pydatetime()) if x is not None)
        state.update((done, errors, status, at, last))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"job_id": [key[0]], "chunks_done": [done], "errors": [errors], "status": [status], "last_ts": [last]})

    return events.groupBy("job_id").applyInPandasWithState(update, PROGRESS, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by stage in windows of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "stage", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a job: runs of events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "job_id").agg(F.count("*").alias("n")).select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(recipes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Recipes of a stream (recipe_id, ts), each once though it may be delivered again."""
    return recipes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["recipe_id"])


def upsert_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch writes its latest row of each key to a folder of its own, so a repeated batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest_rows(batch, key, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is greatest in `order`."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def upserted(spark: SparkSession, path: str, schema: StructType, key: str, order: str) -> DataFrame:
    """What upsert_sink() has written so far: the latest row of each key over all batches."""
    kept = spark.read.schema(StructType([*schema, StructField("epoch", LongType())])).parquet(path)
    return latest_rows(kept, key, order).drop("epoch")


def run_once(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], folder: str, one_batch: bool = False) -> None:
    """All that is there now goes through the stream in batches; offsets and state lie in the shared folder.

    Streams with timeouts by the clock ask for batches without end, so theirs is one batch.
    """
    how = {"once": True} if one_batch else {"availableNow": True}
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(**how).foreachBatch(sink).start()
    run.awaitTermination()


def batches_to(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of each batch in a folder of its own; a repeated batch replaces itself."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def timed_out(attempts: DataFrame, limit_seconds: float) -> DataFrame:
    """Adds `outcome`: a chunk beyond its time budget counts as failed, others go on."""
    return attempts.withColumn("outcome", F.when(F.col("latency_seconds") > limit_seconds, "chunk_timeout").otherwise("ok"))


def word_chunk_udtf():
    """word_chunks(text, size, overlap) for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="part int, chunk string", useArrow=True)
    class WordChunks:
        def eval(self, text: str, size: int, overlap: int):
            words = (text or "").split()
            if len(words) <= size:
                yield 1, text
                return
            for part, start in enumerate(range(0, max(1, len(words) - overlap), size - overlap), 1):
                yield part, " ".join(words[start : start + size])

    return WordChunks
