"""Streams over the given tables, each with the SQL of its batch twin. All that is there goes through the stream once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.operators import chunking, section_table
from paperloom.plans import text_queries as texts
from paperloom.plans.metrics_queries import JOBS, job_events
from paperloom.plans.registry import ORACLE, RUNS, having, query
from paperloom.session import scratch_path
from paperloom.sources import events as log
from paperloom.sources import surrogates as tables
from paperloom.streaming import jobs, progress


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: streams take a single file by a pattern only."""
    whole = tables.table(spark, sf_dir, name)
    return spark.readStream.schema(whole.schema).parquet(f"{sf_dir}/{name}.parque[t]")


def through(spark: SparkSession, stream: DataFrame, mode: str, one_batch: bool = False) -> DataFrame:
    """All rows that the stream gives, with the batch (`epoch`) that gave them."""
    folder = scratch_path(spark, "stream")
    jobs.run_once(stream, mode, jobs.batches_to(f"{folder}/rows"), folder, one_batch)
    schema = StructType([*stream.schema]).add("epoch", "long")
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def staged(events: DataFrame) -> DataFrame:
    stage = F.when(F.col("event_type") == "purchase", "stored").when(F.col("event_type") == "signup", "complete").otherwise(F.col("event_type"))
    return events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", stage.alias("stage"))


@query(ORACLE["job_status_fold"])
def stream_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job fold with state kept per job; its last rows per job. Same as job_status_fold."""
    rows = through(spark, jobs.progress(staged(stream_of(spark, sf_dir, "events"))), "update", one_batch=True)
    order = F.struct("epoch", F.col("chunks_done") + F.col("errors"), "last_ts")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("chunks_done", "errors", "status", "last_ts"), order).alias("s")).select("job_id", "s.*")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of runs, on a clock that runs 600 times as fast, so that gaps lie about the limits."""
    rows = tables.table(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000).cast("long")
    status = F.element_at(F.array(F.lit("PASSED"), F.lit("CORRECTED"), F.lit("FAILED")), (F.col("event_id") % 3 + 1).cast("int"))
    return rows.select(
        F.col("user_id").cast("long").alias("job_id"), F.timestamp_millis(at).alias("ts"), F.col("event_id").cast("long").alias("event_id"), progress.stage_of(F.col("event_type")).alias("stage"),
        (F.col("event_id") % 50).cast("long").alias("chunks_total"), status.alias("validation_status"), F.concat(F.lit("failed in "), F.col("event_id").cast("string")).alias("message"),
    )


@query("""
WITH RECURSIVE ev AS (
  SELECT user_id AS job_id, CAST(epoch_us(ts) // 600000 AS BIGINT) AS t, event_id, CASE event_type WHEN 'purchase' THEN 'stored' WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'error' WHEN 'click' THEN 'fetched' ELSE 'extracting' END AS stage FROM events
), e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, event_id) AS k, stage IN ('error', 'complete') AS ends FROM ev),
f AS (
  SELECT job_id, k, t, event_id, stage, t AS started, CASE WHEN ends THEN t END AS closed, CASE WHEN ends THEN stage END AS closed_by FROM e WHERE k = 1
  UNION ALL
  SELECT job_id, k, t, event_id, stage, CASE WHEN gone THEN t ELSE started END, CASE WHEN before IS NOT NULL AND NOT gone THEN before WHEN ends THEN t END, CASE WHEN before IS NOT NULL AND NOT gone THEN why WHEN ends THEN stage END
  FROM (SELECT *, before IS NOT NULL AND t > before + 300000 AS gone FROM (
    SELECT e.*, f.started, coalesce(f.closed, CASE WHEN e.t > f.t + 120000 THEN f.t + 120000 END) AS before, coalesce(f.closed_by, CASE WHEN e.t > f.t + 120000 THEN 'idle' END) AS why FROM f JOIN e ON e.job_id = f.job_id AND e.k = f.k + 1))
), mark AS (SELECT max(t) - 60000 AS w FROM ev),
lives AS (
  SELECT job_id, started, max(t) AS last_t, count(*) AS events, arg_max(event_id % 50, k) FILTER (stage = 'fetched') AS chunks_total, count(*) FILTER (stage = 'stored') AS chunks_done, count(*) FILTER (stage = 'stored' AND event_id % 3 < 2) AS recipes_passed,
    coalesce(arg_max(CASE stage WHEN 'error' THEN 'failed' ELSE 'complete' END, k) FILTER (stage IN ('error', 'complete')), 'running') AS status, arg_max('failed in ' || event_id, k) FILTER (stage = 'error') AS message,
    arg_max(closed, k) FILTER (closed IS NOT NULL) AS closed, arg_max(closed_by, k) FILTER (closed IS NOT NULL) AS closed_by, count(*) FILTER (stage = 'extracting') AS extracting, lead(started) OVER (PARTITION BY job_id ORDER BY started) AS next_t
  FROM f GROUP BY job_id, started
), ended AS (SELECT *, coalesce(closed, CASE WHEN next_t IS NOT NULL OR last_t + 120001 <= w THEN last_t + 120000 END) AS c FROM lives, mark)
SELECT job_id, started, events, chunks_total, chunks_done, chunks_done AS recipes_extracted, recipes_passed, status, message, extracting, c AS closed,
  CASE WHEN closed_by IS NOT NULL THEN closed_by WHEN c IS NOT NULL THEN 'idle' END AS closed_by, next_t IS NOT NULL OR coalesce(c + 300001 <= w, false) AS removed FROM ended""")
def stream_job_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives of jobs with their counters, closed by an end or an idle time and removed by timers; the events come in three parts, each by a run that goes on from the state of the one before."""
    folder = scratch_path(spark, "lives")
    rows = run_events(spark, sf_dir)
    third = rows.agg(F.max("event_id")).first()[0] or 0
    for k in range(3):
        part = rows.where((F.col("event_id") > third * k // 3) & (F.col("event_id") <= third * (k + 1) // 3) | (F.lit(k == 0) & (F.col("event_id") <= 0)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events")
        stream = progress.lives(spark.readStream.schema(rows.schema).parquet(f"{folder}/events"))
        jobs.run_once(stream, "update", jobs.batches_to(f"{folder}/rows"), folder)
    last = progress.latest(spark.read.schema(stream.schema).parquet(f"{folder}/rows"))
    shown = ("job_id", "started", "events", "chunks_total", "chunks_done", "recipes_extracted", "recipes_passed", "status", "message")
    return last.select(*shown, F.coalesce(F.col("stages")["extracting"], F.lit(0)).alias("extracting"), "closed", "closed_by", "removed")


@query("SELECT user_id AS job_id, count(*) AS n FROM events GROUP BY 1")
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are delivered twice, the second time to a run that goes on from the first one's state; each passes once."""
    folder = scratch_path(spark, "deliveries")
    for _ in range(2):
        run_events(spark, sf_dir).write.mode("append").parquet(f"{folder}/events")
        stream = progress.delivered_once(spark.readStream.schema(run_events(spark, sf_dir).schema).parquet(f"{folder}/events"))
        jobs.run_once(stream, "append", jobs.batches_to(f"{folder}/rows"), folder, one_batch=True)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").groupBy("job_id").agg(F.count("*").alias("n"))


@query(having(texts.GATED, select=f"""
SELECT doc_id, CASE WHEN coalesce(({texts.hits(texts.VOCABULARY)} > 0 OR {texts.hits(texts.UNITS)} > 0 OR formulas > 0 OR ({texts.hits(texts.NOUNS)} >= 2 AND {texts.hits(texts.OFF)} = 0)) AND NOT ({texts.hits(texts.OFF)} > 3 AND score < 1.0) AND score >= 5, false) THEN 'extracting' ELSE 'skipped' END AS stage FROM s"""))
def stream_chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk of a stream with the stage it comes to: skipped by the gate, or extracted."""
    accept = texts.text.gate(F.col("text"), 5.0, texts.VOCABULARY, texts.UNITS, texts.VERBS, texts.NOUNS, texts.OFF)
    return through(spark, jobs.chunk_events(stream_of(spark, sf_dir, "documents"), accept).select("doc_id", "stage"), "append").select("doc_id", "stage")


@query(having(JOBS, select="SELECT date_trunc('hour', ts) AS window_start, stage, count(*) AS n FROM ev GROUP BY 1, 2"))
def stream_stage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by stage and hour; of a window that several batches update the last row counts."""
    rows = through(spark, jobs.stage_counts(staged(stream_of(spark, sf_dir, "events"))), "update")
    return rows.groupBy("window_start", "stage").agg(F.max_by("n", "epoch").alias("n"))


@query(having(JOBS, select="""
, marked AS (SELECT job_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
numbered AS (SELECT job_id, ts, sum(new) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT job_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM numbered GROUP BY job_id, s"""))
def job_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of jobs; the batch form of the same definition."""
    return jobs.sessions(job_events(spark, sf_dir))


@query("SELECT DISTINCT user_id AS recipe_id FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes that are delivered again and again pass once."""
    recipes = stream_of(spark, sf_dir, "events").select(F.col("user_id").alias("recipe_id"), F.col("ts").cast("timestamp").alias("ts"))
    return through(spark, jobs.once(recipes, "3650 days"), "append").select("recipe_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, by a sink that writes each batch once; the first batch is delivered twice."""
    folder = scratch_path(spark, "upserts")
    sink = jobs.upsert_sink(f"{folder}/rows", "user_id", "event_id")

    def twice(batch: DataFrame, epoch: int) -> None:
        sink(batch, epoch)
        if epoch == 0:
            sink(batch, epoch)

    rows = stream_of(spark, sf_dir, "events").select("user_id", "event_id", "value")
    jobs.run_once(rows, "append", twice, folder)
    return jobs.upserted(spark, f"{folder}/rows", rows.schema, "user_id", "event_id")


@query(having(JOBS, select="SELECT job_id, stage, count(*) AS n FROM ev GROUP BY 1, 2"))
def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log: events are appended as JSON lines in two parts, and read as a stream."""
    folder = scratch_path(spark, "log")
    rows = job_events(spark, sf_dir).select("ts", "stage", F.col("job_id").cast("string").alias("job_id"), F.col("event_id").alias("e"))
    for part in (0, 1):
        log.append_events(rows.where(F.col("e") % 2 == part).drop("e"), f"{folder}/events")
    got = through(spark, log.stream_events(spark, f"{folder}/events", 3).select("job_id", "stage"), "append")
    return got.groupBy(F.col("job_id").cast("long").alias("job_id"), "stage").agg(F.count("*").alias("n"))


@query(having(RUNS, select="SELECT recipe_id, CASE WHEN round(latency_seconds, 6) > 0.2 THEN 'chunk_timeout' ELSE 'ok' END AS outcome FROM runs"))
def attempt_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts beyond their time budget fail, the others go on."""
    runs = tables.runs(spark, sf_dir).select("recipe_id", F.round("latency_seconds", 6).alias("latency_seconds"))
    return jobs.timed_out(runs, 0.2).select("recipe_id", "outcome")


@query(ORACLE["word_chunks_overlap"])
def sql_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word windows by a table function that SQL can call. Same as word_chunks_overlap."""
    spark.udtf.register("word_chunks", jobs.word_chunk_udtf())
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = spark.sql(f"SELECT doc_id, CAST(part AS BIGINT) AS part, chunk FROM {{docs}}, LATERAL word_chunks(text, {chunking.CHUNK_WORDS}, {chunking.OVERLAP})", docs=docs)
    words = texts.text.words(F.col("chunk"))
    return out.select("doc_id", "part", F.size(words).cast("long").alias("n_words"), F.get(words, 0).alias("first_word"), F.get(words, F.size(words) - 1).alias("last_word"))


@query(ORACLE["document_sections"])
def sql_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents by a table function over their lines. Same as document_sections."""
    section_table.register(spark)
    lines = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return spark.sql(r"SELECT * FROM section_lines(TABLE({lines}) PARTITION BY doc_id ORDER BY (k), 50, r'^(?:The|Der|Les|La)\b')", lines=lines)
