"""Progress of jobs as typed state with event-time timers, and deliveries that repeat as state that expires.

A job's life begins with its first event. `fetched` sets how many chunks there are, `stored` counts a
chunk, its recipe, and whether that passed; `complete` and `error` set the status, the last one by event
time holding. A life is closed by its first `complete` or `error`, or by `idle_ms` without an event; what
comes after still counts, until the state is removed `keep_ms` after the close. Later events begin a new
life. Gaps and removals follow event time alone, so batches and restarts don't change the outcome; events
behind the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a run of the engine says it does.
STAGES = ("starting", "fetching", "fetched", "extracting", "skipped", "stored", "error", "complete")
ENDS = {"complete": "complete", "error": "failed"}
#: Times in milliseconds. `ended` is the time of the event that set the status.
LIFE = "chunks_total long, chunks_done long, recipes_extracted long, recipes_passed long, status string, message string, ended long, started long, last long, closed long, closed_by string, events long"
NAMES = [f.split()[0] for f in LIFE.split(", ")]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Typed state needs this store; it keeps state on the executors' disks and its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Progress(StatefulProcessor):
    """`job`: the life as it is now. `stages`: how often each stage came. One timer: the next close or removal."""

    def __init__(self, idle_ms: int, keep_ms: int) -> None:
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", LIFE)
        self.stages = handle.getValueState("stages", "names array<string>, n array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        life = dict(zip(NAMES, self.job.get())) if self.job.exists() else None
        counts = self.counts() if life else {}
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if life and not life["closed"] and r.at > life["last"] + self.idle_ms:
                self.shut(life, life["last"] + self.idle_ms, "idle")
            if life and life["closed"] and r.at > life["closed"] + self.keep_ms:
                yield self.row(key, life, counts, True)
                life, counts = None, {}
            life = life or dict.fromkeys(NAMES) | dict.fromkeys(("chunks_done", "recipes_extracted", "recipes_passed", "events"), 0) | {"status": "running", "started": r.at, "last": r.at}
            self.take(life, counts, r)
        self.stages.update((list(counts), list(counts.values())))
        yield from self.kept(key, life, counts)

    def counts(self) -> dict[str, int]:
        """How often each stage came, by one call to the store."""
        return dict(zip(*self.stages.get())) if self.stages.exists() else {}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.job.exists():
            return
        life = dict(zip(NAMES, self.job.get()))
        if not life["closed"]:
            self.shut(life, life["last"] + self.idle_ms, "idle")
        if life["closed"] + self.keep_ms < timerValues.getCurrentWatermarkInMs():
            yield self.row(key, life, self.counts(), True)
            self.job.clear()
            self.stages.clear()
        else:
            yield from self.kept(key, life, self.counts())

    def take(self, life: dict, counts: dict, r: Row) -> None:
        life["events"] += 1
        life["last"] = max(life["last"], r.at)
        counts[r.stage] = counts.get(r.stage, 0) + 1
        if r.stage == "fetched":
            life["chunks_total"] = r.chunks_total
        elif r.stage == "stored":
            life["chunks_done"] += 1
            life["recipes_extracted"] += 1
            life["recipes_passed"] += r.validation_status in ("PASSED", "CORRECTED")
        elif r.stage in ENDS:
            if life["ended"] is None or r.at >= life["ended"]:
                life |= {"status": ENDS[r.stage], "message": r.message if r.stage == "error" else life["message"], "ended": r.at}
            if not life["closed"]:
                self.shut(life, r.at, r.stage)

    @staticmethod
    def shut(life: dict, at: int, why: str) -> None:
        life |= {"closed": at, "closed_by": why}

    def kept(self, key: Any, life: dict, counts: dict) -> Iterator[Row]:
        """Stores the life, sets its timer and gives its row."""
        self.job.update(tuple(life[n] for n in NAMES))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        # A millisecond more: an event just at the limit is in time.
        self.handle.registerTimer((life["closed"] + self.keep_ms if life["closed"] else life["last"] + self.idle_ms) + 1)
        yield self.row(key, life, counts, False)

    def row(self, key: Any, life: dict, counts: dict, removed: bool) -> Row:
        return Row(job_id=key[0], **life, stages=dict(counts), removed=removed)


def lives(events: DataFrame, idle_ms: int = 120_000, keep_ms: int = 300_000, late: str = "1 minute") -> DataFrame:
    """A row for each change of a job's life: job_id, the life's fields, counts of its stages, and whether it was removed.

    events: job_id long, ts timestamp, event_id long, stage, chunks_total long, validation_status and message.
    """
    use_state_store(events.sparkSession)
    rows = events.withWatermark("ts", late).select("job_id", "ts", F.unix_millis("ts").alias("at"), "event_id", "stage", F.col("chunks_total").cast("long").alias("chunks_total"), "validation_status", "message")
    return rows.groupBy("job_id").transformWithState(Progress(idle_ms, keep_ms), f"job_id long, {LIFE}, stages map<string,long>, removed boolean", "Update", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The last row of each life (job_id, started)."""
    order = F.struct("events", F.col("closed").isNotNull(), "removed")
    return changes.groupBy("job_id", "started").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


class Deliveries(StatefulProcessor):
    """Lets each event of a job pass once; an id is forgotten `ttl_ms` after it came."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "event_id long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # The ids of a job are read and added at once: a call to the store for each event costs far more.
        seen, new = {x[0] for x in self.seen.get()}, []
        for r in rows:
            if r.event_id not in seen:
                seen.add(r.event_id)
                new.append((r.event_id,))
                yield r
        if new:
            self.seen.appendList(new)


def delivered_once(events: DataFrame, key: str = "job_id", ttl_ms: int = 3_600_000) -> DataFrame:
    """Events (with an event_id) of an at-least-once source, each once within the time that its id is kept."""
    use_state_store(events.sparkSession)
    return events.groupBy(key).transformWithState(Deliveries(ttl_ms), events.schema, "Append", "ProcessingTime")


def stage_of(event_type: Column) -> Column:
    """Stages that stand for the given table's types of events."""
    pairs = {"purchase": "stored", "signup": "complete", "error": "error", "click": "fetched"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), event_type), F.lit("extracting"))
